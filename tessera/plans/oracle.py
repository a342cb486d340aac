"""DuckDB oracle SQL, one per registered query with a SQL equivalent.

Each is written from the operator's definition (plain global windows,
``count(*) FILTER``, unions), not from the Spark plan it checks.
"""

from __future__ import annotations

from .. import fixed_values as fv
from . import oracle_fixtures as ofx

ORACLE: dict[str, str] = {}

TAGS = fv.ALL_TAGS
TAG_CELLS = [f"{t}_{s}" for t in TAGS for s in ("r1", "r2")]

COERCED_ANNOT = ("SELECT doc_id, id, text, rtnl, " + ", ".join(f"{ofx.coerce_sql(c)} AS {c}" for c in TAG_CELLS)
                 + " FROM fx_annot")


def _kappa_sql(long_view: str, by: list[str]) -> str:
    g = ", ".join(by + ["tag"])
    on = " AND ".join(f"t.{c} IS NOT DISTINCT FROM p.{c}" for c in by + ["tag"])
    return f"""
    , marg_a AS (SELECT {g}, a AS k, count(*) AS na FROM {long_view} GROUP BY {g}, a)
    , marg_b AS (SELECT {g}, b AS k, count(*) AS nb FROM {long_view} GROUP BY {g}, b)
    , pe AS (SELECT {', '.join('ma.' + c for c in by + ['tag'])}, sum(na * nb) AS pe
             FROM marg_a ma JOIN marg_b mb ON {' AND '.join(f'ma.{c} = mb.{c}' for c in by + ['tag'])} AND ma.k = mb.k
             GROUP BY {', '.join('ma.' + c for c in by + ['tag'])})
    , tot AS (SELECT {g}, count(*) AS n, count(*) FILTER (WHERE a = b) AS agree FROM {long_view} GROUP BY {g})
    SELECT {', '.join('t.' + c for c in by + ['tag'])}, t.n,
           round(CAST(t.n * t.agree - coalesce(p.pe, 0) AS DOUBLE)
                 / nullif(CAST(t.n * t.n - coalesce(p.pe, 0) AS DOUBLE), 0), 6) AS kappa
    FROM tot t LEFT JOIN pe p ON {on}"""


def _long_pairs(src: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}'{t}' AS tag, {t}_r1 AS a, {t}_r2 AS b FROM {src}" for t in TAGS)


ORACLE["cohen_kappa"] = ofx.with_fixtures(
    f"SELECT * FROM (WITH c AS ({COERCED_ANNOT}), long AS ({_long_pairs('c')})" + _kappa_sql("long", []) + ")",
    fx_annot=ofx.fx_annot())

_U = "('0x' || substr(md5(concat('boot:56:', CAST(rep // 8 AS VARCHAR), ':', CAST(doc_id AS VARCHAR))), 4 * (rep % 8) + 1, 4))::INTEGER"
# Poisson(1) by inversion of 16 bits: 65,536 times the distribution function at 0 to 7
_POISSON = [24109, 48218, 60273, 64291, 65296, 65497, 65530, 65535]
_KI = dict(fx_annot=ofx.fx_annot(), c=COERCED_ANNOT, wt="SELECT doc_id, rep, " + " + ".join(f"CAST(u >= {s} AS INTEGER)" for s in _POISSON)
           + f" AS w FROM (SELECT doc_id, rep, {_U} AS u FROM c, range(100) r(rep))",
           long=f"SELECT w.rep, p.tag, p.a, p.b, w.w FROM wt w JOIN ({_long_pairs('c', 'doc_id, ')}) p USING (doc_id) WHERE w.w > 0",
           ma="SELECT rep, tag, a AS k, sum(w) AS na FROM long GROUP BY rep, tag, a", mb="SELECT rep, tag, b AS k, sum(w) AS nb FROM long GROUP BY rep, tag, b",
           pe="SELECT rep, tag, sum(na * nb) AS pe FROM ma JOIN mb USING (rep, tag, k) GROUP BY rep, tag",
           kr="SELECT rep, tag, CASE WHEN n * n - coalesce(pe, 0) <> 0 THEN round(CAST(n * o - coalesce(pe, 0) AS DOUBLE) / "
              "CAST(n * n - coalesce(pe, 0) AS DOUBLE), 6) END AS kappa FROM (SELECT rep, tag, sum(w) AS n, coalesce(sum(w) FILTER "
              "(WHERE a = b), 0) AS o FROM long GROUP BY rep, tag) LEFT JOIN pe USING (rep, tag)")
ORACLE["kappa_intervals"] = ofx.with_fixtures(
    "SELECT k.*, lo, hi, se, n_reps FROM (" + ORACLE["cohen_kappa"] + ") k LEFT JOIN (SELECT tag, round(quantile_cont(kappa, 0.025), 6) AS lo, "
    "round(quantile_cont(kappa, 0.975), 6) AS hi, round(stddev_samp(kappa), 6) AS se, count(kappa) AS n_reps FROM kr GROUP BY tag) USING (tag)", **_KI)

ORACLE["kappa_corrections"] = ORACLE["cohen_kappa"]

ORACLE["kappa_multiclass"] = """
WITH long AS (SELECT 'event_type' AS tag, event_type AS a,
    CASE WHEN substr(md5(concat('kmc:', CAST(event_id AS VARCHAR))),1,1) < 'c' THEN event_type ELSE 'view' END AS b
  FROM events)""" + _kappa_sql("long", [])

ORACLE["pair_annotators"] = ofx.with_fixtures(
    "SELECT a.doc_id, " + ", ".join(f"a.{t}_r1 AS {t}_r1" for t in TAGS) + ", a.rtnl AS rtnl_r1, "
    + ", ".join(f"b.{t}_r2 AS {t}_r2" for t in TAGS) + ", b.rtnl AS rtnl_r2 "
    "FROM fx_annot a JOIN fx_annot b ON a.doc_id = b.doc_id", fx_annot=ofx.fx_annot())

ORACLE["tags_coerce"] = ofx.with_fixtures(
    f"SELECT doc_id, {', '.join(TAG_CELLS)} FROM ({COERCED_ANNOT})", fx_annot=ofx.fx_annot())


def _strict(c: str) -> str:
    m = f"CASE WHEN {c} = '1.0' THEN '1' WHEN {c} = 'x' THEN '0' ELSE {c} END"
    return f"CASE WHEN {c} IS NULL OR trim({m}) = '' THEN 0 ELSE CAST(trim({m}) AS BIGINT) END"


ORACLE["tags_strict"] = ofx.with_fixtures(
    "SELECT doc_id, " + ", ".join(f"{_strict(c)} AS {c}" for c in TAG_CELLS) + " FROM fx_annot",
    fx_annot=ofx.fx_annot())

ORACLE["disagreements"] = ofx.with_fixtures(
    "SELECT doc_id, " + ", ".join(f"CASE WHEN {t}_r1 <> {t}_r2 THEN 1 ELSE 0 END AS {t}_dis" for t in TAGS)
    + f" FROM ({COERCED_ANNOT})", fx_annot=ofx.fx_annot())

ORACLE["value_counts"] = ofx.with_fixtures(
    f"SELECT value, " + ", ".join(f"nullif(count(*) FILTER (WHERE col = '{c}'), 0) AS {c}" for c in TAG_CELLS)
    + " FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value FROM c" for c in TAG_CELLS)
    + ") GROUP BY value",
    fx_annot=ofx.fx_annot(), c=COERCED_ANNOT)

_CYCLE = "CAST(('0x' || substr(md5(concat('cycle:', id)),1,1))::INTEGER % 4 AS INTEGER)"
ORACLE["reliability_trend"] = ofx.with_fixtures(
    "SELECT *, coalesce(kappa > 0.75, false) AS meets_benchmark FROM ("
    f"WITH cc AS (SELECT *, {_CYCLE} AS cycle FROM c), long AS ({_long_pairs('cc', 'cycle, ')})"
    + _kappa_sql("long", ["cycle"]) + ")",
    fx_annot=ofx.fx_annot(), c=COERCED_ANNOT)


# --------------------------------------------------------------------------
# sources, projections, filters
# --------------------------------------------------------------------------

def lit(s: str) -> str:
    """A SQL string literal (quotes doubled; newlines kept as they are)."""
    return "'" + s.replace("'", "''") + "'"


ORACLE["read_responses"] = "SELECT doc_id AS row_id, text, lang, source, n_chars FROM documents"

_DOC_TYPES = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
              ("n_chars", "bigint")]
ORACLE["profile"] = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, count(*) AS n_rows "
    f"FROM documents" for i, (c, t) in enumerate(_DOC_TYPES))

ORACLE["drop_columns"] = ofx.with_fixtures(
    'SELECT row_id, "EmailPairID", "WithinPatientID", "FirstInPair", "MHP ID", "Unique ID", "Cleaned Message" '
    "FROM fx_sheet", fx_sheet=ofx.FX_SHEET)

ORACLE["suffix_columns"] = ofx.with_fixtures(
    "SELECT doc_id, " + ", ".join(f"{t}_r2" for t in TAGS) + ", rtnl AS rtnl_r2 FROM fx_annot",
    fx_annot=ofx.fx_annot())

ORACLE["blank_tags"] = ofx.with_fixtures(
    "SELECT doc_id, text, " + ", ".join(f"' ' AS {c}" for c in fv.CYCLE_TAG_COLUMNS) + " FROM fx_annot",
    fx_annot=ofx.fx_annot())

ORACLE["drop_sentinel"] = ofx.with_fixtures(
    """SELECT row_id, "Unique ID" FROM fx_sheet WHERE "Unique ID" IS DISTINCT FROM '___'""", fx_sheet=ofx.FX_SHEET)


def _round_id(c: str) -> str:
    return f'CAST(round_even(coalesce("{c}", 0), 0) AS BIGINT)'


ORACLE["normalize_ids"] = ofx.with_fixtures(
    f'SELECT row_id, {_round_id("EmailPairID")} AS "EmailPairID", {_round_id("WithinPatientID")} AS "WithinPatientID", '
    f'{_round_id("MHP ID")} AS "MHP ID" FROM fx_sheet', fx_sheet=ofx.FX_SHEET)

ORACLE["condense_responses"] = ofx.with_fixtures(
    f'SELECT row_id, {_round_id("EmailPairID")} AS "EmailPairID", {_round_id("WithinPatientID")} AS "WithinPatientID", '
    f'"FirstInPair", {_round_id("MHP ID")} AS "MHP ID", "Unique ID", 1 AS pilot, "Cleaned Message" AS text '
    """FROM fx_sheet WHERE "Unique ID" IS NULL OR "Unique ID" <> '___'""", fx_sheet=ofx.FX_SHEET)

ORACLE["theme_subset"] = ofx.with_fixtures(
    f"SELECT doc_id, {', '.join(fv.THEMES)} FROM fx_train WHERE "
    + " OR ".join(f"{t} = 1" for t in fv.THEMES), fx_train=ofx.fx_train())

ORACLE["head_by"] = ofx.with_fixtures(
    "SELECT doc_id, afrm, trgt FROM fx_train ORDER BY doc_id LIMIT 899", fx_train=ofx.fx_train())

ORACLE["composite_indicator"] = ofx.with_fixtures(
    f"SELECT doc_id, {', '.join(fv.TARGETS)}, trgt FROM fx_train", fx_train=ofx.fx_train())

# Python str.strip(): Unicode whitespace and the separators \x1c-\x1f
PY_WS = r"[\t\n\x0B\f\r\x1c-\x1f \x85\p{Z}]"


def pystrip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_WS}+|{PY_WS}+$', '', 'g')"


PARSED = f"""SELECT doc_id, alias,
  CASE WHEN reply IS NULL OR reply = 'error' THEN NULL
       WHEN contains(reply, alias || '_1') THEN 1 ELSE 0 END AS decision,
  CASE WHEN reply IS NULL OR reply = 'error' THEN NULL
       WHEN contains(reply, alias || '_1') AND contains(reply, alias || '_rationale:')
       THEN {pystrip_sql("split_part(split_part(reply, alias || '_rationale:', 2), alias || '_explanation:', 1)")}
       END AS rationale,
  CASE WHEN reply IS NULL OR reply = 'error' THEN NULL
       WHEN contains(reply, alias || '_explanation:')
       THEN {pystrip_sql("split_part(reply, alias || '_explanation:', 2)")} END AS explanation
FROM fx_reply"""

ORACLE["parse_responses"] = ofx.with_fixtures("SELECT * FROM parsed", fx_reply=ofx.fx_reply(), parsed=PARSED)

_TRI = ofx.with_fixtures(
    "SELECT h.*, " + ", ".join(
        f"CAST(p_{c}.decision AS DOUBLE) AS {c}_gpt, p_{c}.rationale AS {c}_rtnl_gpt, "
        f"p_{c}.explanation AS {c}_expl_gpt, "
        f"CASE WHEN h.{c} = 1 AND p_{c}.decision = 1 THEN 1 ELSE 0 END AS {c}_triangulate"
        for c in fv.LLM_CODES)
    + " FROM fx_train h " + " ".join(
        f"LEFT JOIN parsed p_{c} ON p_{c}.doc_id = h.doc_id AND p_{c}.alias = '{c}'" for c in fv.LLM_CODES),
    fx_annot=ofx.fx_annot(), fx_train=ofx.fx_train(), fx_reply=ofx.fx_reply(), parsed=PARSED)

ORACLE["triangulate"] = (f"SELECT doc_id, "
                         + ", ".join(f"{c}, {c}_gpt, {c}_triangulate" for c in fv.LLM_CODES)
                         + f" FROM ({_TRI})")

# rater errors: expectation maximisation on the counts of answer combinations, one CTE an iteration
_ANS = "CASE WHEN {c} = 1 THEN '1' WHEN {c} = 0 THEN '0' ELSE '-' END"


def _em_views(iterations: int) -> dict[str, str]:
    pat = " UNION ALL ".join(
        f"SELECT a.doc_id, '{c}' AS code, " + " || ".join(_ANS.format(c=x) for x in (f"a.{c}_r1", f"a.{c}_r2", f"t.{c}_gpt"))
        + " AS pattern FROM ca a JOIN tri t USING (doc_id)" for c in fv.LLM_CODES)
    v = {"ca": COERCED_ANNOT.replace("fx_annot", f"({ofx.fx_annot()})"), "tri": _TRI, "pats": pat,
         "pc": "SELECT code, pattern, CAST(count(*) AS DOUBLE) AS n FROM pats GROUP BY code, pattern",
         "ans": "SELECT code, pattern, n, k, substr(pattern, k, 1) AS a FROM pc, (VALUES (1), (2), (3)) r(k)",
         "p0": "SELECT code, pattern, n, CASE WHEN count(*) FILTER (WHERE a <> '-') > 0 THEN count(*) FILTER (WHERE a = '1') / "
               "CAST(count(*) FILTER (WHERE a <> '-') AS DOUBLE) ELSE 0.5 END AS ch FROM ans GROUP BY code, pattern, n"}
    for t in range(iterations):
        v[f"v{t}"] = f"SELECT code, (sum(n * ch) + 1) / (sum(n) + 2) AS prev FROM p{t} GROUP BY code"
        v[f"r{t}"] = ("SELECT code, k, (sum(n * ch) FILTER (WHERE a = '1') + 1) / (sum(n * ch) FILTER (WHERE a <> '-') + 2) AS se, "
                      "(sum(n * (1 - ch)) FILTER (WHERE a = '0') + 1) / (sum(n * (1 - ch)) FILTER (WHERE a <> '-') + 2) AS sp "
                      f"FROM ans JOIN p{t} USING (code, pattern, n) GROUP BY code, k")
        v[f"p{t + 1}"] = (
            "SELECT code, pattern, n, x / (x + y) AS ch FROM (SELECT code, pattern, n, any_value(prev) * product(CASE a WHEN '1' THEN se "
            "WHEN '0' THEN 1 - se ELSE 1.0 END) AS x, (1 - any_value(prev)) * product(CASE a WHEN '0' THEN sp WHEN '1' THEN 1 - sp ELSE 1.0 END) "
            f"AS y FROM ans JOIN r{t} USING (code, k) JOIN v{t} USING (code) GROUP BY code, pattern, n)")
    return v


_EM = "WITH " + ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in _em_views(20).items())
ORACLE["rater_errors"] = _EM + """
SELECT code, CASE k WHEN 1 THEN 'r1' WHEN 2 THEN 'r2' ELSE 'gpt' END AS rater, round(prev, 6) AS prevalence, round(se, 6) AS sensitivity,
       round(sp, 6) AS specificity, CAST((SELECT sum(n) FROM ans a WHERE a.code = r19.code AND a.k = r19.k AND a.a <> '-') AS BIGINT) AS n
FROM r19 JOIN v19 USING (code)"""
ORACLE["triangulate_by_error"] = _EM + " SELECT doc_id, " + ", ".join(
    f"max(p) FILTER (WHERE code = '{c}') AS {c}_p_yes, max(CAST(p > 0.5 AS INTEGER)) FILTER (WHERE code = '{c}') AS {c}_triangulate"
    for c in fv.LLM_CODES) + " FROM (SELECT doc_id, code, round(ch, 6) AS p FROM pats JOIN p20 USING (code, pattern)) GROUP BY doc_id"

ORACLE["redact_terms_large"] = (
    "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{8,}')) AS t FROM benchmark), "
    "l AS (SELECT list(t ORDER BY md5(t), t) AS ts FROM w) SELECT doc_id, CASE WHEN len(ts) > 0 THEN list_reduce(ts, lambda acc, x: "
    "replace(acc, x, '_'), text) ELSE text END AS text FROM documents, l")

_REST = [t for t in TAGS if t not in fv.LLM_CODES]
ORACLE["finalize_triangulated"] = (f"SELECT doc_id, {', '.join(_REST)}, "
                                   + ", ".join(f"{c}_triangulate AS {c}" for c in fv.LLM_CODES)
                                   + f" FROM ({_TRI})")


def _fill(c: str) -> str:
    return f"CASE WHEN {c} = ' ' THEN '.' ELSE coalesce({c}, '.') END"


ORACLE["fill_placeholders"] = ofx.with_fixtures(
    f"SELECT doc_id, {_fill('afrm_r1')} AS note, {_fill('rtnl')} AS rtnl FROM fx_annot", fx_annot=ofx.fx_annot())


# --------------------------------------------------------------------------
# text
# --------------------------------------------------------------------------

def nested_replace(x: str, terms, token: str) -> str:
    out = x
    for t in terms:
        out = f"replace({out}, {lit(t)}, {lit(token)})"
    return out


_TERMS = list(fv.MANUAL_MARKERS) + list(fv.CLIENT_NAMES)
_TAIL = f"SELECT doc_id, {ofx.SPLICE_SQL} AS text, {ofx.SPLICED_RTNL} AS rtnl FROM documents"
ORACLE["redact_terms"] = ofx.with_fixtures(
    f"SELECT doc_id, {nested_replace('text', _TERMS, ' ')} AS text, {nested_replace('rtnl', _TERMS, ' ')} AS rtnl "
    f"FROM tail", fx_text=ofx.FX_TEXT, tail=_TAIL)

ORACLE["strip_numerals"] = r"SELECT doc_id, regexp_replace(text, '[\p{Nd}\r\n]+', ' ', 'g') AS text FROM documents"

ORACLE["strip_tokens"] = ofx.with_fixtures(
    f"SELECT doc_id, {nested_replace('text', fv.SALIENCE_TOKENS, ' ')} AS text FROM fx_text", fx_text=ofx.FX_TEXT)

# recogniser, written for RE2: left boundary consumed, entity in group 2
_NAMES = sorted(fv.CLIENT_NAMES, key=lambda t: (-len(t), t))
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_PHONE = r"[0-9]{3}-[0-9]{4}"
_PAT = "(^|[^A-Za-z0-9])(" + "|".join([_EMAIL, _PHONE] + _NAMES) + ")"
_M = f"""SELECT doc_id, text, regexp_extract_all(text, '{_PAT}', 0) AS w, regexp_extract_all(text, '{_PAT}', 2) AS e,
           regexp_split_to_array(text, '{_PAT}') AS p FROM fx_text"""
_NAME_SET = "(" + ", ".join(lit(n) for n in fv.CLIENT_NAMES) + ")"
_LABEL = (f"CASE WHEN regexp_full_match(ent, '{_EMAIL}') THEN 'EMAIL' WHEN regexp_full_match(ent, '{_PHONE}') "
          f"THEN 'PHONE' WHEN ent IN {_NAME_SET} THEN 'PERSON' END")
_SPANS = f"""SELECT doc_id, k, ent, CAST(start AS INTEGER) AS start, CAST(start + length(ent) AS INTEGER) AS "end",
       {_LABEL} AS label
FROM (SELECT doc_id, k, e[k] AS ent, text,
             sum(length(p[k]) + length(w[k])) OVER (PARTITION BY doc_id ORDER BY k) - length(e[k]) AS start
      FROM (SELECT doc_id, text, w, e, p, unnest(range(1, len(w) + 1)) AS k FROM m))
WHERE NOT regexp_matches(substr(text, CAST(start + length(ent) + 1 AS BIGINT), 1), '[A-Za-z0-9]')"""
ORACLE["detect_entities"] = ofx.with_fixtures(
    """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS span_no,
              start, "end", label, ent AS span_text FROM spans""", fx_text=ofx.FX_TEXT, m=_M, spans=_SPANS)

_TOKEN = r"'[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]+|[\n!-/:-@\[-`{-~]'"


def _tokens_tagged(sql: str, label: str | None) -> str:
    first = f"'B-{label}'" if label else "'O'"
    more = f"'I-{label}'" if label else "'O'"
    return (f"list_transform(regexp_extract_all({sql}, {_TOKEN}), lambda t, i: "
            f"{{'token': t, 'tag': CASE WHEN i = 1 THEN {first} ELSE {more} END}})")


_SEQ = ("SELECT doc_id, list_concat(" + _tokens_tagged("body", None) + ", coalesce(" + ofx.sentence_case(
    lambda parts: "flatten([[{'token': chr(10), 'tag': 'O'}], " + ", ".join(_tokens_tagged(ofx.part_sql(p), lab) for p, lab in parts)
    + "])") + f", [])) AS s FROM ({ofx.NAMED_BASE})").replace("AS STRING", "AS VARCHAR")
_OBS = r"""CASE WHEN known.w IS NOT NULL THEN {t} WHEN regexp_matches({t}, '^[\n!-/:-@\[-`{{-~]$') THEN {t}
  WHEN regexp_matches({t}, '^[0-9]{{1,2}}$') THEN '<d>' WHEN regexp_matches({t}, '^[0-9]{{3,4}}$') THEN '<dd>'
  WHEN regexp_matches({t}, '^[0-9]+$') THEN '<ddd>' WHEN regexp_matches({t}, '^[A-Z]$') THEN '<X>'
  WHEN regexp_matches({t}, '^[A-Z]+$') THEN '<XX>' WHEN regexp_matches({t}, '^[A-Z][^A-Z]+$') THEN '<Xx>'
  WHEN regexp_matches({t}, '[A-Z]') THEN '<xX>' ELSE '<x>' END"""
ORACLE["tagger_counts"] = ofx.with_fixtures(
    f"""SELECT 'emission' AS kind, CAST(NULL AS VARCHAR) AS prev, tag, CASE WHEN known.w IS NULL AND pt IN ('.', '!', '?', ':', chr(10)) AND regexp_matches(t, '^[A-Z][^A-Z]*$')
          THEN CASE WHEN length(t) = 1 THEN '<^X>' ELSE '<^Xx>' END ELSE {_OBS.format(t="p.t")} END AS seen, CAST(count(*) AS BIGINT) AS n
        FROM p LEFT JOIN known ON p.t = known.w GROUP BY ALL
        UNION ALL
        SELECT 'transition', prev, tag, {_OBS.format(t="p.pt")}, count(*) FROM p LEFT JOIN known ON p.pt = known.w GROUP BY ALL""",
    seqs=_SEQ,
    p="""SELECT s[i].token AS t, s[i].tag AS tag, CASE WHEN i = 1 THEN chr(10) ELSE s[i - 1].token END AS pt,
                CASE WHEN i = 1 THEN 'O' ELSE s[i - 1].tag END AS prev
         FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM seqs)""",
    known=r"""SELECT t AS w FROM p WHERE regexp_matches(t, '^[A-Za-z0-9\x{80}-\x{10FFFF}]') GROUP BY t HAVING count(*) >= 5
             ORDER BY count(*) DESC, t LIMIT 20000""")

_KEEP = "(" + ", ".join(lit(x) for x in fv.REDACT_LABELS) + ")"


def _kept_k(k: str) -> str:
    # match k is an entity to redact: its label is kept and the character after
    # it (first of the next piece) is not a letter or digit
    ent = f"e[{k}]"
    lab = _LABEL.replace("ent", ent)
    return f"(({lab}) IN {_KEEP} AND NOT regexp_matches(left(p[{k} + 1], 1), '[A-Za-z0-9]'))"


ORACLE["redact_spans"] = ofx.with_fixtures(
    "SELECT doc_id, CASE WHEN len(w) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(w) + 1), "
    f"lambda k: p[k] || CASE WHEN {_kept_k('k')} THEN left(w[k], length(w[k]) - length(e[k])) || ' ' ELSE w[k] END), '')"
    " || p[len(w) + 1] END AS text FROM m", fx_text=ofx.FX_TEXT, m=_M)

ORACLE["redact_entities"] = ofx.with_fixtures(
    "SELECT doc_id, list_reduce(list_filter(list_transform(range(1, len(w) + 1), "
    f"lambda k: CASE WHEN {_kept_k('k')} THEN e[k] END), lambda x: x IS NOT NULL), "
    "lambda acc, x: replace(acc, x, '<|PII|>'), text) AS text FROM m", fx_text=ofx.FX_TEXT, m=_M)


# --------------------------------------------------------------------------
# LLM tables
# --------------------------------------------------------------------------

def _codebook_values(aliases=None) -> str:
    rows = [r for r in fv.CODEBOOK if aliases is None or r[0] in aliases]
    return "(VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows) + \
        ") AS cb(alias, name, definition, clarification, examples)"


_PROMPT = (f"{lit(fv.CODEBOOK_ROLE)} || chr(10) || 'Definition of \"' || name || '\": ' || definition || chr(10) || "
           f"replace(replace({lit(fv.INSTRUCTION_TEMPLATE)}, '{{name}}', name), '{{alias}}', alias) || "
           "clarification || examples")

ORACLE["request_table"] = (f"SELECT item_id, alias, {_PROMPT} AS system_prompt, text AS user_text "
                           f"FROM benchmark CROSS JOIN {_codebook_values()}")
ORACLE["build_prompts"] = (f"SELECT alias, {_PROMPT} AS system_prompt, count(*) AS n_requests, CAST(sum(length(text)) AS BIGINT) AS n_user_chars "
                           f"FROM benchmark CROSS JOIN {_codebook_values(fv.LLM_CODES)} GROUP BY ALL")
ORACLE["codebook"] = ofx.with_fixtures(
    f"SELECT cb.*, coalesce(r.n, 0) AS n_replies, CAST(coalesce(r.yes, 0) AS BIGINT) AS n_positive FROM {_codebook_values()} "
    "LEFT JOIN (SELECT alias, count(*) AS n, count(*) FILTER (WHERE reply <> 'error' AND contains(reply, alias || '_1')) AS yes "
    "FROM fx_reply GROUP BY alias) r ON r.alias = cb.alias",
    fx_reply=ofx.fx_reply())


# --------------------------------------------------------------------------
# sampling, splits, augmentation
# --------------------------------------------------------------------------

def _h(seed, key: str) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


_FXT = dict(fx_annot=ofx.fx_annot(), fx_train=ofx.fx_train())

ORACLE["sample_n"] = ofx.with_fixtures(
    f"SELECT doc_id, position, trgt FROM (SELECT doc_id, trgt, row_number() OVER (ORDER BY {_h(56, 'doc_id')}, doc_id) - 1 "
    "AS position FROM fx_train) WHERE position < 50", **_FXT)

ORACLE["shuffle"] = (f"SELECT doc_id, row_number() OVER (ORDER BY {_h(56, 'doc_id')}, doc_id) - 1 AS position "
                     "FROM documents")

_CONDENSED = ORACLE["condense_responses"]
ORACLE["reindex"] = (f"SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS index FROM ({_CONDENSED})")

ORACLE["seeded_rank"] = ofx.with_fixtures(
    f"SELECT doc_id, trgt, row_number() OVER (PARTITION BY trgt ORDER BY {_h(7, 'doc_id')}, doc_id) AS rank "
    "FROM fx_train", **_FXT)

ORACLE["sample_strata"] = ofx.with_fixtures(
    f"SELECT doc_id, agnt, row_number() OVER (ORDER BY {_h(42, 'doc_id')}, doc_id) - 1 AS position FROM ("
    f"SELECT doc_id, agnt, row_number() OVER (PARTITION BY agnt ORDER BY {_h(42, 'doc_id')}, doc_id) AS r FROM fx_train)"
    " WHERE r <= CASE agnt WHEN 1 THEN 5 WHEN 0 THEN 95 ELSE 0 END", **_FXT)

_HOLD = (f"SELECT doc_id, CASE WHEN (SELECT count(*) FROM fx_train) > 200 AND row_number() OVER "
         f"(ORDER BY {_h(56, 'doc_id')}, doc_id) <= 200 THEN 'calibrate' ELSE 'train' END AS split FROM fx_train")
ORACLE["holdout"] = ofx.with_fixtures(_HOLD, **_FXT)
ORACLE["holdout_rest"] = ofx.with_fixtures(f"SELECT doc_id FROM ({_HOLD}) WHERE split = 'train'", **_FXT)


def _split_sql(src: str, key: str, extra: str = "") -> str:
    """Stratified 80:20 split of ``src`` by trgt, written from the quota rule."""
    return f"""(WITH cls AS (SELECT trgt, count(*) AS n_c FROM {src} GROUP BY trgt),
  tot AS (SELECT sum(n_c) AS n, CAST(ceil(0.2 * sum(n_c)) AS BIGINT) AS n_test FROM cls),
  q0 AS (SELECT trgt, (n_test * n_c) // n AS base, (n_test * n_c) % n AS rem, n_test FROM cls, tot),
  q AS (SELECT trgt, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, trgt)
                                  <= n_test - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q0),
  r AS (SELECT *, row_number() OVER (PARTITION BY trgt ORDER BY {_h(56, key)}, {key}) AS rk FROM {src})
  SELECT r.* EXCLUDE (rk), CASE WHEN rk <= quota THEN 'test' ELSE 'train' END AS split
  FROM r JOIN q USING (trgt))"""


ORACLE["stratified_split"] = ofx.with_fixtures(
    f"SELECT doc_id, trgt, split FROM {_split_sql('(SELECT doc_id, trgt FROM fx_train)', 'doc_id')}", **_FXT)

ORACLE["stratified_folds"] = ofx.with_fixtures(
    f"""SELECT doc_id, trgt, CAST((off + rk - 1) % 5 AS INTEGER) AS fold FROM (
      SELECT doc_id, trgt, row_number() OVER (PARTITION BY trgt ORDER BY {_h(56, 'doc_id')}, doc_id) AS rk,
             (SELECT count(*) FROM fx_train f2 WHERE f2.trgt < f.trgt) AS off FROM fx_train f)""", **_FXT)


def _aug(clear: bool) -> str:
    return ("SELECT doc_id, text, rtnl, trgt, 0 AS seq, CAST(NULL AS BIGINT) AS parent_id, 0 AS agmt FROM fx_train "
            "UNION ALL SELECT doc_id, rtnl AS text, " + ("' '" if clear else "rtnl") +
            " AS rtnl, trgt, 1 AS seq, doc_id AS parent_id, 1 AS agmt FROM fx_train WHERE trgt > 0")


ORACLE["augment"] = ofx.with_fixtures(
    "SELECT doc_id, seq, parent_id, agmt, text, rtnl, row_number() OVER (ORDER BY doc_id, seq) - 1 AS position "
    "FROM aug", **_FXT, aug=_aug(True))

_FLAG = ("SELECT doc_id, seq, CAST(coalesce(text = lag(rtnl) OVER (ORDER BY doc_id, seq), false) AS INTEGER) "
         "AS agmt_flag FROM aug")
ORACLE["flag_augmented"] = ofx.with_fixtures(_FLAG, **_FXT, aug=_aug(False))
ORACLE["parent_of"] = ofx.with_fixtures(
    "SELECT doc_id, seq, agmt_flag, CASE WHEN agmt_flag = 1 THEN last_value(CASE WHEN agmt_flag = 0 THEN doc_id END "
    "IGNORE NULLS) OVER (ORDER BY doc_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent_key "
    "FROM flagged", **_FXT, aug=_aug(False), flagged=_FLAG)

_ORIG_SPLIT = _split_sql("(SELECT * FROM aug WHERE agmt = 0)", "doc_id")
ORACLE["semi_augmented"] = ofx.with_fixtures(
    f"SELECT doc_id, seq, parent_id FROM aug WHERE agmt = 1 AND parent_id IN "
    f"(SELECT doc_id FROM {_ORIG_SPLIT} WHERE split = 'train')", **_FXT, aug=_aug(True))
_ASSEMBLED = (f"SELECT doc_id, seq, split FROM {_ORIG_SPLIT} UNION ALL SELECT doc_id, seq, 'train' AS split "
              f"FROM aug WHERE agmt = 1 AND parent_id IN (SELECT doc_id FROM {_ORIG_SPLIT} WHERE split = 'train')")
ORACLE["assemble_train"] = ofx.with_fixtures(_ASSEMBLED, **_FXT, aug=_aug(True))
ORACLE["split_report"] = ofx.with_fixtures(
    "SELECT split, count(*) AS n_rows FROM assembled GROUP BY split", **_FXT, aug=_aug(True), assembled=_ASSEMBLED)

ORACLE["concat_rows"] = ("SELECT doc_id, text, lang, source, CAST(NULL AS BIGINT) AS conv_id, CAST(NULL AS BIGINT) AS turn, "
                         "CAST(NULL AS VARCHAR) AS role FROM documents UNION ALL SELECT NULL, text, NULL, NULL, conv_id, "
                         "turn, role FROM conversations")
ORACLE["replicate"] = ("SELECT doc_id, quality, toxic, CAST(r.range AS INTEGER) AS rep, "
                       "concat(doc_id, ':', r.range) AS rep_id FROM labels CROSS JOIN "
                       "range(0, CAST(ceil(1600 / (SELECT count(*) FROM labels)) AS BIGINT)) r")

ORACLE["sample_by_cycle"] = (
    f'SELECT row_id, "MHP ID", "Unique ID", pilot, text, index, '
    + ", ".join(f"' ' AS {c}" for c in fv.CYCLE_TAG_COLUMNS) + ", 1 AS cycle FROM ("
    f"SELECT *, row_number() OVER (ORDER BY {_h(56, 'row_id')}, row_id) - 1 AS index FROM ({_CONDENSED})) "
    "WHERE index < 80")

ORACLE["masked_copy"] = ofx.with_fixtures(
    "SELECT doc_id, text, " + ", ".join(f"' ' AS {c}" for c in fv.CYCLE_TAG_COLUMNS) + " FROM ("
    f"SELECT doc_id, text FROM fx_train ORDER BY {_h(42, 'doc_id')}, doc_id LIMIT 100)", **_FXT)


# --------------------------------------------------------------------------
# metrics, weights, grids, encoding
# --------------------------------------------------------------------------

_SC = dict(fx_scores=ofx.FX_SCORES)
ORACLE["decide"] = ofx.with_fixtures(
    "SELECT doc_id, target, round(1 / (1 + exp(-logit)), 6) AS p, CAST(1 / (1 + exp(-logit)) > 0.5 AS INTEGER) "
    "AS decision FROM fx_scores", **_SC)

_PREV = fv.TARGETS + fv.THEMES
ORACLE["prevalence"] = ofx.with_fixtures(" UNION ALL ".join(
    f"SELECT '{t}' AS tag, CAST(sum({t}) AS BIGINT) AS n_pos, count(*) AS n_total, "
    f"round(100.0 * sum({t}) / count(*), 6) AS pct FROM fx_train" for t in _PREV), **_FXT)


def _pw(src: str, targets, by: str = "") -> str:
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {sel}'{t}' AS target, CAST(sum({t}) AS BIGINT) AS n_pos, CAST(count(*) - sum({t}) AS BIGINT) AS n_neg, "
        f"round(CASE WHEN sum({t}) > 0 THEN (count(*) - sum({t})) / sum({t}) ELSE 1.0 END, 6) AS pos_weight "
        f"FROM {src}{grp}" for t in targets)


ORACLE["pos_weights"] = ofx.with_fixtures(_pw("fx_train", fv.TARGETS), **_FXT)

_TRAIN_FOLDS = (f"SELECT f.*, CAST((off + rk - 1) % 5 AS INTEGER) AS fold FROM (SELECT *, row_number() OVER "
                f"(PARTITION BY trgt ORDER BY {_h(56, 'doc_id')}, doc_id) AS rk, (SELECT count(*) FROM fx_train f2 "
                f"WHERE f2.trgt < f1.trgt) AS off FROM fx_train f1) f")
ORACLE["pos_weights_by_fold"] = ofx.with_fixtures(
    "SELECT k.fold, x.target, CAST(x.n_pos AS BIGINT) AS n_pos, CAST(x.n_neg AS BIGINT) AS n_neg, x.pos_weight FROM "
    "(SELECT DISTINCT fold FROM folded) k, LATERAL (" + " UNION ALL ".join(
        f"SELECT '{t}' AS target, sum({t}) AS n_pos, count(*) - sum({t}) AS n_neg, round(CASE WHEN sum({t}) > 0 "
        f"THEN (count(*) - sum({t})) / sum({t}) ELSE 1.0 END, 6) AS pos_weight FROM folded WHERE fold <> k.fold"
        for t in fv.TARGETS) + ") x", **_FXT, folded=_TRAIN_FOLDS)

# metrics written from their textbook definitions
_CONF = ("SELECT {g}, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp, "
         "count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp, "
         "count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, "
         "count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn FROM {src} GROUP BY {g}")


def _f1(g: str, src: str) -> str:
    return (f"SELECT {g}, 'f1_macro' AS metric, round(((CASE WHEN tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) "
            f"ELSE 0 END) + (CASE WHEN tn + fp + fn > 0 THEN 2.0 * tn / (2 * tn + fp + fn) ELSE 0 END)) / "
            f"nullif((CASE WHEN tp + fp + fn > 0 THEN 1 ELSE 0 END) + (CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END), 0)"
            f", 6) AS value FROM ({_CONF.format(g=g, src=src)})")


def _mcc(g: str, src: str) -> str:
    den = "sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn))"
    return (f"SELECT {g}, 'mcc' AS metric, round(CASE WHEN {den} = 0 THEN 0.0 ELSE "
            f"(CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / {den} END, 6) AS value "
            f"FROM ({_CONF.format(g=g, src=src)})")


def _ap(g: str, src: str) -> str:
    # thresholds = distinct scores; precision at each; step sum over recall
    return f"""SELECT {g}, 'auprc' AS metric, round(CASE WHEN sum(pos) > 0 THEN
        sum(pos * (CAST(tp AS DOUBLE) / n)) / sum(pos) END, 6) AS value FROM (
      SELECT {g}, y_prob, pos, sum(pos) OVER (PARTITION BY {g} ORDER BY y_prob DESC) AS tp,
             sum(cnt) OVER (PARTITION BY {g} ORDER BY y_prob DESC) AS n
      FROM (SELECT {g}, y_prob, sum(y_true) AS pos, count(*) AS cnt FROM {src} GROUP BY {g}, y_prob))
    GROUP BY {g}"""


ORACLE["f1_macro"] = ofx.with_fixtures(_f1("target", "fx_scores"), **_SC)
ORACLE["mcc"] = ofx.with_fixtures(_mcc("target", "fx_scores"), **_SC)
ORACLE["average_precision"] = ofx.with_fixtures(_ap("target", "fx_scores"), **_SC)

_FLAT = "(SELECT * EXCLUDE (target), 'aggregate' AS target FROM fx_scores)"
ORACLE["pooled_metrics"] = ofx.with_fixtures(
    f"{_f1('target', _FLAT)} UNION ALL SELECT * FROM ({_ap('target', _FLAT)}) WHERE value IS NOT NULL", **_SC)

_LAB_FOLDS = (f"SELECT doc_id, CAST((off + rk - 1) % 5 AS INTEGER) AS fold FROM (SELECT doc_id, row_number() OVER "
              f"(PARTITION BY quality ORDER BY {_h(56, 'doc_id')}, doc_id) AS rk, (SELECT count(*) FROM labels l2 "
              f"WHERE l2.quality < l1.quality) AS off FROM labels l1)")
_SCF = dict(fx_scores=ofx.FX_SCORES, lf=_LAB_FOLDS, sf="SELECT s.*, lf.fold FROM fx_scores s JOIN lf USING (doc_id)")
_SFLAT = "(SELECT * EXCLUDE (target), 'aggregate' AS target FROM sf)"
_FOLD_METRICS = (f"{_f1('fold, target', 'sf')} UNION ALL {_mcc('fold, target', 'sf')} UNION ALL "
                 f"{_ap('fold, target', 'sf')} UNION ALL {_f1('fold, target', _SFLAT)} UNION ALL "
                 f"SELECT * FROM ({_ap('fold, target', _SFLAT)}) WHERE value IS NOT NULL")
ORACLE["fold_metrics"] = ofx.with_fixtures(_FOLD_METRICS, **_SCF)
ORACLE["cv_summary"] = ofx.with_fixtures(
    "SELECT target, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n_folds "
    "FROM fm WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY target, metric", **_SCF, fm=_FOLD_METRICS)

ORACLE["weighted_bce"] = ofx.with_fixtures(
    "SELECT round(avg(w * y_true * (greatest(-logit, 0) + ln(1 + exp(-abs(logit)))) + (1 - y_true) * "
    "(greatest(logit, 0) + ln(1 + exp(-abs(logit))))), 6) AS bce, count(*) AS n_cells FROM fx_scores s "
    "JOIN (" + _pw("labels", ["quality", "toxic"]) + ") w0 USING (target), LATERAL (SELECT w0.pos_weight AS w)",
    **_SC)

# joint training (M1-M4), written from its rule: hashed tf-idf rows of unit length, AdamW with warm-up, one CTE a step
_JT = ["quality", "toxic"]
_DIM = 512


def _tok_sql(c: str) -> str:
    return (f"list_filter(regexp_split_to_array({c}, '[\\t\\n\\x0B\\f\\r ]+'), lambda t: t <> '')")


def _joint_views(configs: list[dict], folds: bool) -> dict[str, str]:
    """CTEs up to ``w`` (fit, j, w): ``configs`` x folds x targets, or all rows (fold -1)."""
    src = "(SELECT doc_id, quality, toxic, CASE WHEN quality = 1 OR toxic = 1 THEN 1 ELSE 0 END AS trgt FROM labels)"
    v = {"sp": f"SELECT * FROM {_split_sql(src, 'doc_id')}",
         "tr": f"SELECT f.*, CAST((off + rk - 1) % 5 AS INTEGER) AS fold FROM (SELECT *, row_number() OVER (PARTITION BY trgt ORDER BY "
               f"{_h(56, 'doc_id')}, doc_id) AS rk, (SELECT count(*) FROM sp f2 WHERE split = 'train' AND f2.trgt < f1.trgt) AS off "
               "FROM sp f1 WHERE split = 'train') f",
         "x0": f"SELECT doc_id, j, 1 + ln(count(*)) AS val FROM (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {_DIM} AS j "
               f"FROM (SELECT doc_id, unnest({_tok_sql('text')}) AS t FROM documents)) WHERE doc_id IN (SELECT doc_id FROM sp) "
               "GROUP BY doc_id, j",
         "fo": "SELECT DISTINCT fold AS f FROM tr" if folds else "SELECT -1 AS f",
         "lab": " UNION ALL ".join(f"SELECT doc_id, fold, '{t}' AS target, {t} AS y, "
                                   "('0x' || substr(md5('batch:' || doc_id), 1, 8))::BIGINT AS lot FROM tr" for t in _JT),
         "pw": "SELECT f, target, CASE WHEN sum(y) > 0 THEN (count(*) - sum(y)) / CAST(sum(y) AS DOUBLE) ELSE 1.0 END AS pw "
               "FROM lab, fo WHERE fold <> f GROUP BY f, target",
         "idf": "SELECT f, j, ln((n + 1) / (count(doc_id) + 1)) AS idf FROM (SELECT f, count(*) AS n FROM tr, fo WHERE fold <> f GROUP BY f) "
                f"s, range({_DIM}) r(j) LEFT JOIN (SELECT f AS g, j AS i, doc_id FROM tr JOIN x0 USING (doc_id), fo WHERE fold <> f) d "
                "ON d.g = s.f AND d.i = r.j GROUP BY f, j, n",
         "xs": "SELECT doc_id, f, j, val * idf AS v FROM x0 JOIN idf USING (j)",
         "xv": "SELECT doc_id, f, j, v / sqrt(s) AS v FROM xs JOIN (SELECT doc_id, f, sum(v * v) AS s FROM xs GROUP BY doc_id, f) "
               "USING (doc_id, f) WHERE s > 0 "
               f"UNION ALL SELECT doc_id, f, {_DIM}, 1.0 FROM sp, fo",
         "fits": "SELECT c, b, f, target, pw FROM (VALUES " + ", ".join(f"({i}, {c['batches']})" for i, c in enumerate(configs))
                 + ") AS k(c, b), pw"}
    v["w0"] = f"SELECT c, f, target, j, 0.0 AS w, 0.0 AS m, 0.0 AS s FROM fits, range({_DIM} + 1) r(j)"
    total = [c["epochs"] * c["batches"] for c in configs]
    for t in range(max(total)):
        rates = []
        for i, c in enumerate(configs):
            warm = int(total[i] * c["warmup_ratio"])
            up = t / max(1, warm) if t < warm else max(0.0, (total[i] - t) / max(1, total[i] - warm))
            if t < total[i]:
                rates.append(f"({i}, {c['learning_rate'] * up!r}::DOUBLE, {c['weight_decay']!r}::DOUBLE)")
        v[f"z{t}"] = (f"SELECT k.c, k.f, k.target, k.pw, l.doc_id, l.y, sum(x.v * w.w) AS z FROM fits k "
                      f"JOIN (VALUES {', '.join(rates)}) AS q(c, lr, wd) ON q.c = k.c "
                      f"JOIN lab l ON l.target = k.target AND l.fold <> k.f AND l.lot % k.b = {t} % k.b "
                      f"JOIN xv x ON x.doc_id = l.doc_id AND x.f = k.f JOIN w{t} w ON w.c = k.c AND w.f = k.f AND w.target = k.target "
                      "AND w.j = x.j GROUP BY ALL")
        v[f"g{t}"] = (f"SELECT c, r.f, target, j, sum(r * x.v) / any_value(n) AS g FROM (SELECT *, (1 - y) / (1 + exp(-z)) - pw * y * "
                      f"(1 - 1 / (1 + exp(-z))) AS r, count(*) OVER (PARTITION BY c, f, target) AS n FROM z{t}) r "
                      "JOIN xv x ON x.doc_id = r.doc_id AND x.f = r.f GROUP BY c, r.f, target, j")
        v[f"u{t}"] = (f"SELECT w.c, w.f, w.target, w.j, w.w, q.lr, q.wd, CASE WHEN q.c IS NULL THEN w.m ELSE 0.9 * w.m + (1 - 0.9) * "
                      f"coalesce(g, 0) END AS m, CASE WHEN q.c IS NULL THEN w.s ELSE 0.999 * w.s + (1 - 0.999) * coalesce(g, 0) * "
                      f"coalesce(g, 0) END AS s FROM w{t} w LEFT JOIN (VALUES {', '.join(rates)}) AS q(c, lr, wd) ON q.c = w.c "
                      f"LEFT JOIN g{t} g ON g.c = w.c AND g.f = w.f AND g.target = w.target AND g.j = w.j")
        v[f"w{t + 1}"] = (f"SELECT c, f, target, j, CASE WHEN lr IS NULL THEN w ELSE w * (1 - lr * wd) - lr * (m / (1 - power(0.9::DOUBLE, "
                          f"{t + 1}))) / (sqrt(s / (1 - power(0.999::DOUBLE, {t + 1}))) + 1e-8) END AS w, m, s FROM u{t}")
    v["w"] = f"SELECT * FROM w{max(total)}"
    return v


def _joint_sql(sql: str, views: dict[str, str], **more: str) -> str:
    return "WITH " + ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in {**views, **more}.items()) + "\n" + sql


_J0 = dict(learning_rate=0.1, epochs=5, batches=2, weight_decay=0.01, warmup_ratio=0.1)
_JGRID = [{**_J0, "learning_rate": lr, "batches": b} for lr in (0.05, 0.1, 0.2) for b in (1, 2)]


def _joint_scores(rows: str) -> str:
    """Scores of ``rows`` (doc_id, fold, target, y) by the fits of their fold."""
    return (f"SELECT c AS config_id, fold, target, y_true, CAST(z > 0 AS INTEGER) AS y_pred, round(1 / (1 + exp(-z)), 6) AS y_prob FROM ("
            f"SELECT w.c, l.fold, l.target, l.y AS y_true, l.doc_id, round(sum(x.v * w.w), 6) AS z FROM ({rows}) l JOIN xv x ON "
            "x.doc_id = l.doc_id AND x.f = l.fold JOIN w ON w.f = l.fold AND w.target = l.target AND w.j = x.j GROUP BY ALL)")


_JFLAT = "(SELECT * EXCLUDE (target), 'aggregate' AS target FROM js)"
_TESTROWS = " UNION ALL ".join(f"SELECT doc_id, -1 AS fold, '{t}' AS target, {t} AS y FROM sp WHERE split = 'test'" for t in _JT)


def _jmetrics(by: str) -> str:
    g = f"{by}target"
    return (f"{_f1(g, 'js')} UNION ALL {_mcc(g, 'js')} UNION ALL {_ap(g, 'js')} UNION ALL {_f1(g, _JFLAT)} UNION ALL "
            f"SELECT * FROM ({_ap(g, _JFLAT)}) WHERE value IS NOT NULL")


ORACLE["fit_multilabel"] = _joint_sql(
    f"SELECT target, CAST(CASE WHEN j = {_DIM} THEN -1 ELSE j END AS INTEGER) AS feature, round(w, 6) + 0.0 AS coef, "
    "round(pw, 6) AS pos_weight FROM w JOIN pw USING (f, target)", _joint_views([_J0], False))
ORACLE["evaluate"] = _joint_sql(f"SELECT target, metric, value FROM ({_jmetrics('')})", _joint_views([_J0], False), js=_joint_scores(_TESTROWS))
ORACLE["training_loss"] = _joint_sql(
    "SELECT f AS fold, target, CAST(e AS INTEGER) AS epoch, round(avg(loss), 6) AS loss FROM (" + " UNION ALL ".join(
        f"SELECT f, target, {t // 2 + 1} AS e, avg(pw * y * (greatest(-z, 0) + ln(1 + exp(-abs(z)))) + (1 - y) * (greatest(z, 0) + "
        f"ln(1 + exp(-abs(z))))) AS loss FROM z{t} GROUP BY f, target" for t in range(10)) + ") GROUP BY f, target, e",
    _joint_views([_J0], True))
ORACLE["cross_validate"] = _joint_sql(
    "SELECT target, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n_folds FROM "
    f"({_jmetrics('fold, ')}) WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY target, metric",
    _joint_views([_J0], True), js=_joint_scores("SELECT doc_id, fold, target, y FROM lab"))
ORACLE["grid_search"] = _joint_sql(
    f"""SELECT CAST(i AS INTEGER) AS config_id, lr AS learning_rate, CAST(b AS BIGINT) AS batches,
       round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1, round(avg(ap), 6) AS mean_auprc, round(stddev_pop(ap), 6) AS std_auprc
       FROM (SELECT config_id, fold, max(value) FILTER (WHERE metric = 'f1_macro') AS f1, max(value) FILTER (WHERE metric = 'auprc') AS ap
             FROM ({_f1('config_id, fold, target', _JFLAT)} UNION ALL SELECT * FROM ({_ap('config_id, fold, target', _JFLAT)})) GROUP BY ALL) m
       JOIN (VALUES """ + ", ".join(f"({i}, {c['learning_rate']!r}::DOUBLE, {c['batches']})" for i, c in enumerate(_JGRID))
    + ") AS k(i, lr, b) ON i = config_id GROUP BY i, lr, b",
    _joint_views(_JGRID, True), js=_joint_scores("SELECT doc_id, fold, target, y FROM lab"))

_GRID_SQL = ("SELECT lr AS learning_rate, bs AS batch_size, CAST(i * 2 + j AS INTEGER) AS config_id "
             "FROM (VALUES (1e-5, 0), (2e-5, 1), (5e-5, 2)) a(lr, i), (VALUES (16, 0), (32, 1)) b(bs, j)")
ORACLE["param_grid"] = ofx.with_fixtures(
    "SELECT g.*, f.fold, (SELECT count(*) FROM fx_train) - f.n_val AS n_train, f.n_val FROM g, "
    "(SELECT fold, count(*) AS n_val FROM folded GROUP BY fold) f", **_FXT, folded=_TRAIN_FOLDS, g=_GRID_SQL)

_THR = f"""SELECT CAST(round((t - 0.3) * 10) AS INTEGER) AS config_id, CAST(t AS DOUBLE) AS threshold,
    round(avg(value), 6) AS mean_f1, round(stddev_pop(value), 6) AS std_f1 FROM (
  SELECT t, fold, value FROM (VALUES (0.3), (0.4), (0.5), (0.6), (0.7)) th(t), LATERAL (
    {_f1('fold', "(SELECT fold, y_true, CAST(y_prob > th.t AS INTEGER) AS y_pred FROM sf)")}))
  GROUP BY t"""
ORACLE["threshold_search"] = ofx.with_fixtures(_THR, **_SCF)
ORACLE["best_config"] = ofx.with_fixtures(f"SELECT * FROM ({_THR}) ORDER BY mean_f1 DESC NULLS LAST, threshold LIMIT 1",
                                          **_SCF)

def _encoded(src: str, key: str, chunks: bool, extra: str = "") -> str:
    """Ids (60 bits of md5 + 2), masks, windows of 512."""
    width = "greatest(CAST(ceil(len(toks) / 512) AS BIGINT), 1)" if chunks else "1"
    return rf"""
WITH tok AS (SELECT {key}{extra}, list_filter(regexp_split_to_array(coalesce(text, ''), '[\t\n\x0B\f\r ]+'), lambda x: x <> '')
             AS toks FROM {src}),
w AS (SELECT {key}{extra}, len(toks) AS n, toks, unnest(range({width})) AS chunk FROM tok),
enc AS (SELECT {key}{extra}, n, chunk, list_transform(toks[chunk * 512 + 1:chunk * 512 + 512],
          lambda x: CAST('0x' || substr(md5(x), 1, 15) AS BIGINT) + 2) AS ids FROM w)
SELECT {key}{extra}, {'CAST(chunk AS INTEGER) AS chunk, ' if chunks else ''}CAST(n AS INTEGER) AS n_tokens,
  array_to_string(list_concat(ids, list_transform(range(512 - len(ids)), lambda x: 0)), ',') AS input_ids,
  array_to_string(list_concat(list_transform(range(len(ids)), lambda x: 1),
                              list_transform(range(512 - len(ids)), lambda x: 0)), ',') AS attention_mask
FROM enc"""


ORACLE["encode_batch"] = _encoded("documents", "doc_id", False)
ORACLE["encode_chunks"] = _encoded("documents", "doc_id", True)


# --------------------------------------------------------------------------
# end-to-end flow
# --------------------------------------------------------------------------
def _redacted(c: str) -> str:
    """Column ``c`` with the recogniser's entities blanked; matches in w, e, p."""
    w, e, p = (f"regexp_{f}({c}, '{_PAT}'{g})" for f, g in (("extract_all", ", 0"), ("extract_all", ", 2"), ("split_to_array", "")))
    return (f"(SELECT CASE WHEN coalesce(len(w), 0) = 0 THEN {c} ELSE array_to_string(list_transform(range(1, len(w) + 1), "
            f"lambda k: p[k] || CASE WHEN {_kept_k('k')} THEN left(w[k], length(w[k]) - length(e[k])) || ' ' ELSE w[k] END), '')"
            f" || p[len(w) + 1] END FROM (SELECT {w} AS w, {e} AS e, {p} AS p))")


_E3_RED = f"SELECT doc_id, {_redacted('text')} AS text, {_redacted('rtnl')} AS rtnl, trgt FROM fx_train"
_E3_BASE = (f"SELECT doc_id, regexp_replace({nested_replace('text', _TERMS, ' ')}, '[\\p{{Nd}}\\r\\n]+', ' ', 'g') "
            f"AS text, regexp_replace({nested_replace('rtnl', _TERMS, ' ')}, '[\\p{{Nd}}\\r\\n]+', ' ', 'g') AS rtnl, "
            "trgt FROM e3_red")
_E3_AUG = ("SELECT doc_id, text, rtnl, trgt, 0 AS seq FROM e3_base UNION ALL "
           "SELECT doc_id, rtnl AS text, ' ' AS rtnl, trgt, 1 AS seq FROM e3_base WHERE trgt > 0")
_E3_TOK = f"SELECT doc_id, {nested_replace('text', fv.SALIENCE_TOKENS, ' ')} AS text, trgt, seq FROM e3_aug"
_E3_LAB = f"""SELECT t.*, CASE WHEN (SELECT count(*) FROM e3_tok) > 200 AND f.cum <= 200 THEN 'calibrate'
                 ELSE 'rest' END AS h
  FROM e3_tok t JOIN (SELECT doc_id, sum(size) OVER (ORDER BY {_h(56, 'doc_id')}, doc_id
                                                    ROWS UNBOUNDED PRECEDING) AS cum
                      FROM (SELECT doc_id, count(*) AS size FROM e3_tok GROUP BY doc_id)) f USING (doc_id)"""
_E3_SPLIT = _split_sql("(SELECT doc_id, trgt FROM e3_lab WHERE h = 'rest' AND seq = 0)", "doc_id")
ORACLE["training_set"] = ofx.with_fixtures(
    "SELECT doc_id, seq, 'calibrate' AS split, text FROM e3_lab WHERE h = 'calibrate' UNION ALL "
    f"SELECT l.doc_id, l.seq, s.split, l.text FROM e3_lab l JOIN {_E3_SPLIT} s USING (doc_id) "
    "WHERE l.h = 'rest' AND (l.seq = 0 OR s.split = 'train')",
    **_FXT, e3_red=_E3_RED, e3_base=_E3_BASE, e3_aug=_E3_AUG, e3_tok=_E3_TOK, e3_lab=_E3_LAB)

_TERMS_LONGEST = sorted(_TERMS, key=lambda t: -len(t))
ORACLE["redact_terms_longest"] = ofx.with_fixtures(
    f"SELECT doc_id, {nested_replace('text', _TERMS_LONGEST, ' ')} AS text, "
    f"{nested_replace('rtnl', _TERMS_LONGEST, ' ')} AS rtnl FROM tail", fx_text=ofx.FX_TEXT, tail=_TAIL)

# --------------------------------------------------------------------------
# keys and lineage of augmented rows; edges of tags, replies and counts
# --------------------------------------------------------------------------
ORACLE["head_by_text"] = "SELECT doc_id, source, lang FROM documents ORDER BY source, lang, doc_id LIMIT 50"
ORACLE["profile_first"] = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, count(*) AS n_rows, "
    f"(SELECT string_agg(coalesce(CAST({c} AS VARCHAR), ''), ' | ' ORDER BY doc_id) FROM "
    f"(SELECT * FROM documents ORDER BY doc_id LIMIT 3)) AS first FROM documents" for i, (c, t) in enumerate(_DOC_TYPES))
ORACLE["folds_augmented"] = ofx.with_fixtures(
    "SELECT aug.doc_id, aug.seq, folded.fold FROM aug JOIN folded USING (doc_id)", **_FXT, aug=_aug(True), folded=_TRAIN_FOLDS)
ORACLE["holdout_rows"] = ofx.with_fixtures(
    "SELECT doc_id, seq, CASE WHEN (SELECT count(*) FROM aug) > 200 AND row_number() OVER (ORDER BY "
    "md5('56:' || doc_id || ':' || seq), doc_id || ':' || seq) <= 200 THEN 'calibrate' ELSE 'train' END AS split FROM aug",
    **_FXT, aug=_aug(True))
ORACLE["encode_augmented"] = (
    f"WITH fx_annot AS ({_FXT['fx_annot']}), fx_train AS ({_FXT['fx_train']}), aug AS ({_aug(True)}), "
    "ids AS (SELECT *, doc_id || ':' || seq AS aug_id FROM aug)," + _encoded("ids", "aug_id", True, ", trgt").strip().removeprefix("WITH"))
ORACLE["tags_strict_numeric"] = ofx.with_fixtures(
    'SELECT row_id, CAST(trunc(coalesce("EmailPairID", 0)) AS BIGINT) AS "EmailPairID" FROM fx_sheet', fx_sheet=ofx.FX_SHEET)
ORACLE["parse_rerun"] = ofx.with_fixtures(
    "SELECT doc_id, alias, CASE WHEN doc_id % 3 = 1 THEN 0 ELSE decision END AS decision, "
    "CASE WHEN doc_id % 3 <> 1 THEN rationale END AS rationale, "
    "CASE WHEN doc_id % 3 <> 1 THEN explanation END AS explanation FROM parsed", fx_reply=ofx.fx_reply(), parsed=PARSED)
ORACLE["value_counts_missing"] = ofx.with_fixtures(
    "SELECT value, " + ", ".join(f"nullif(count(*) FILTER (WHERE col = '{c}'), 0) AS {c}" for c in TAG_CELLS)
    + " FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value FROM fx_annot" for c in TAG_CELLS)
    + ") WHERE value IS NOT NULL GROUP BY value", fx_annot=ofx.fx_annot())
ORACLE["split_sizes"] = ofx.with_fixtures(
    f"SELECT trgt, split, count(*) AS n_rows FROM {_split_sql('(SELECT doc_id, trgt FROM fx_train)', 'doc_id')} "
    "GROUP BY trgt, split", **_FXT)
ORACLE["cv_plan"] = ("SELECT * FROM (VALUES (0, 5, 0.0::DOUBLE), (1, 5, 0.01), (2, 10, 0.0), (3, 10, 0.01), (4, 20, 0.0), "
                     '(5, 20, 0.01)) g(config_id, "maxIter", "regParam") CROSS JOIN (' + ofx.with_fixtures(
                         "SELECT fold, count(*) AS n_val, (SELECT count(*) FROM fx_train) - count(*) AS n_train FROM folded "
                         "GROUP BY fold", **_FXT, folded=_TRAIN_FOLDS) + ") s JOIN (" + ORACLE["pos_weights_by_fold"]
                     + ") w USING (fold)")

# --------------------------------------------------------------------------
# sources, sinks and flows
# --------------------------------------------------------------------------
ORACLE["read_terms"] = (f"SELECT {pystrip_sql('line')} AS term, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) "
                        f"AS line FROM benchmark) WHERE {pystrip_sql('line')} <> '' GROUP BY 1")
ORACLE["write_read_table"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
ORACLE["write_cycles"] = (f"SELECT doc_id, CASE WHEN cycle = 2 THEN upper(lang) ELSE lang END AS lang, n_chars, cycle FROM "
                          f"(SELECT *, {_CYCLE} AS cycle FROM (SELECT *, CAST(doc_id AS VARCHAR) AS id FROM documents))")
ORACLE["write_read_csv"] = "SELECT * FROM labels"
ORACLE["null_text"] = ofx.with_fixtures("SELECT doc_id, coalesce(rtnl, 'nan') AS text FROM fx_annot", fx_annot=ofx.fx_annot())
ORACLE["pystrip"] = ofx.with_fixtures(f"SELECT doc_id, alias, {pystrip_sql('reply')} AS reply FROM fx_reply",
                                      fx_reply=ofx.fx_reply())
ORACLE["theme_output"] = ofx.with_fixtures(
    f"SELECT doc_id, text, {', '.join(fv.THEMES)} FROM fx_train WHERE " + " OR ".join(f"{t} = 1" for t in fv.THEMES),
    fx_train=ofx.fx_train())
ORACLE["flow_agreement"] = ofx.with_fixtures(
    "SELECT doc_id, " + ", ".join(f"CASE WHEN {t}_r1 <> {t}_r2 THEN 1 ELSE 0 END AS {t}_dis" for t in TAGS)
    + f", {_fill('rtnl')} AS rtnl_r1, {_fill('rtnl')} AS rtnl_r2 FROM ({COERCED_ANNOT})", fx_annot=ofx.fx_annot())
ORACLE["flow_triangulation"] = "SELECT doc_id, " + ", ".join(f"{c}_triangulate AS {c}" for c in fv.LLM_CODES) + f" FROM ({_TRI})"


# folds balanced in several labels: the leftover rows of each label set are dealt one by one in a recursion
_ML = fv.TARGETS
_HAS = ", ".join(f"CAST(substr(s, {i + 1}, 1) AS INTEGER)" for i in range(len(_ML)))
ORACLE["multilabel_folds"] = f"""
WITH RECURSIVE fx_annot AS ({ofx.fx_annot()}),
fx_train AS ({ofx.fx_train()}),
t AS (SELECT doc_id, {', '.join(_ML)}, concat({', '.join(_ML)}) AS s FROM fx_train),
c AS (SELECT s, count(*) AS n, [{_HAS}, 1] AS has FROM t GROUP BY s),
tot AS (SELECT [{', '.join(f"CAST(sum(n * has[{i + 1}]) AS BIGINT)" for i in range(len(_ML) + 1))}] AS tt,
               [{', '.join(f"CAST(sum(n // 5 * has[{i + 1}]) AS BIGINT)" for i in range(len(_ML) + 1))}] AS bb FROM c),
o AS (SELECT s, n, has, coalesce(list_sort([{{'a': tt[i], 'i': i}} FOR i IN range(1, {len(_ML) + 1}) IF has[i] = 1])[1],
             {{'a': CAST(NULL AS BIGINT), 'i': {len(_ML) + 1}}}) AS r FROM c, tot),
u AS (SELECT s, has, r.i AS rare, j, row_number() OVER (ORDER BY r.a IS NULL, r.a, s, j) AS step
      FROM (SELECT *, unnest(range(n % 5)) AS j FROM o)),
deal AS (
  SELECT CAST(0 AS BIGINT) AS step, CAST('' AS VARCHAR) AS s, CAST([] AS BIGINT[]) AS used, CAST(-1 AS BIGINT) AS f,
         [[tt[i] - 5 * bb[i] FOR i IN range(1, {len(_ML) + 2})] FOR q IN range(5)] AS lack FROM tot
  UNION ALL
  SELECT step, s, list_append(used, f), f, [[CASE WHEN q = f THEN lack[q + 1][i] - 5 * has[i] ELSE lack[q + 1][i] END
         FOR i IN range(1, {len(_ML) + 2})] FOR q IN range(5)] FROM (
    SELECT u.step, u.s, u.has, d.lack, CASE WHEN u.j = 0 THEN [] ELSE d.used END AS used,
           list_sort([{{'a': -d.lack[q + 1][u.rare], 'b': -list_sum([d.lack[q + 1][i] * u.has[i] FOR i IN range(1, {len(_ML) + 1})]),
                       'c': -d.lack[q + 1][{len(_ML) + 1}], 'q': q}} FOR q IN range(5)
                      IF NOT list_contains(CASE WHEN u.j = 0 THEN [] ELSE d.used END, q)])[1].q AS f
    FROM deal d JOIN u ON u.step = d.step + 1)),
more AS (SELECT u.s, u.j, deal.f FROM u JOIN deal USING (step))
SELECT doc_id, {', '.join(_ML)}, CAST(CASE WHEN p < n // 5 * 5 THEN p % 5 ELSE f END AS INTEGER) AS fold
FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY {_h(56, 'doc_id')}, doc_id) - 1 AS p FROM t) t
JOIN c USING (s) LEFT JOIN more ON more.s = t.s AND more.j = t.p - c.n // 5 * 5
"""
