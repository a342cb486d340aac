"""The fixture views of :mod:`tessera.plans.fixtures` as DuckDB SQL (for the
oracle queries). Written from the fixture definitions, not from the Spark
plans."""

from __future__ import annotations

from .. import fixed_values as fv


def cell_sql(who: str, tag: str) -> str:
    h = f"substr(md5(concat('{who}:{tag}:', id)),1,2)"
    return (f"CASE WHEN {h} < '30' THEN '1' WHEN {h} < 'a0' THEN '0' WHEN {h} < 'c8' THEN ' ' "
            f"WHEN {h} < 'd8' THEN '' WHEN {h} < 'e0' THEN '1.0' WHEN {h} < 'e4' THEN 'x' ELSE NULL END")


def fx_annot(tags=None) -> str:
    tags = tags or fv.ALL_TAGS
    cols = []
    for t in tags:
        cols.append(f"{cell_sql('r1', t)} AS {t}_r1")
        cols.append(f"CASE WHEN substr(md5(concat('agree:{t}:', id)),1,1) < 'd' THEN {cell_sql('r1', t)} "
                    f"ELSE {cell_sql('r2', t)} END AS {t}_r2")
    cols.append("CASE WHEN substr(md5(concat('rtnl:', id)),1,1) = 'f' THEN NULL "
                "ELSE split_part(text, chr(10), 1) END AS rtnl")
    return ("SELECT doc_id, text, id, " + ", ".join(cols) +
            " FROM (SELECT doc_id, text, CAST(doc_id AS VARCHAR) AS id FROM documents)")


SPLICE_SQL = """concat(text, CASE substr(md5(concat('splice:', CAST(doc_id AS STRING))),1,1)
  WHEN '0' THEN ' Daniela wrote to Daniel at [CITY].'
  WHEN '1' THEN ' <|PII|> Amyloid Scottish [PHONE NUMBER] 555-0100'
  WHEN '2' THEN ' <PII> <|AFRM|><|REFL|> see [URL]'
  ELSE '' END)"""
SPLICED_RTNL = ("CASE WHEN substr(md5(concat('rtnl:', CAST(doc_id AS STRING))),1,1) = 'f' THEN CAST(NULL AS STRING) ELSE "
                + SPLICE_SQL.replace("concat(text,", "concat(split_part(text, chr(10), 1),", 1) + " END")
FX_TEXT = f"SELECT doc_id, {SPLICE_SQL} AS text FROM documents"


_RH = "substr(md5(concat('reply:', alias, ':', CAST(doc_id AS STRING))),1,2)"
REPLY_SQL = f"""CASE
      WHEN {_RH} < '10' THEN 'error'
      WHEN {_RH} < '18' THEN NULL
      WHEN {_RH} < '60' THEN concat(' ', alias, '_1', chr(10), chr(10), alias, '_rationale: ', split_part(text, chr(10), 1), '<|SPL|>end', chr(10), chr(10), alias, '_explanation: Clear. Direct. ')
      WHEN {_RH} < '70' THEN concat(' ', alias, '_1')
      WHEN {_RH} < '80' THEN concat(' 0', chr(10), alias, '_explanation: Does not merit ', alias, '_1. None.')
      ELSE concat(' 0', chr(10), alias, '_explanation:', chr(9), 'No cue.', chr(10)) END"""


def fx_reply(aliases=None) -> str:
    aliases = aliases or fv.LLM_CODES
    vals = ", ".join(f"('{a}')" for a in aliases)
    return f"SELECT doc_id, alias, {REPLY_SQL} AS reply, text FROM documents CROSS JOIN (VALUES {vals}) AS a(alias)"


FX_SCORES = """SELECT doc_id, target, y_true, y_prob, CAST(y_prob > 0.5 AS INTEGER) AS y_pred,
       (y_prob - 0.5) * 8.0 AS logit FROM (
  SELECT doc_id, target, CAST(y_true AS INTEGER) AS y_true,
         CAST((doc_id * 7919 + length(target) * 13) % 1000 AS DOUBLE) / 1000 AS y_prob
  FROM (SELECT doc_id, 'quality' AS target, quality AS y_true FROM labels
        UNION ALL SELECT doc_id, 'toxic', toxic FROM labels))"""

FX_SHEET = """SELECT o_orderkey AS row_id,
  concat('c', CAST(o_custkey AS VARCHAR), '@example.org') AS "Email Address",
  o_orderpriority AS "Client Name",
  concat('Re: order ', CAST(o_orderkey AS VARCHAR)) AS "INBOX Line",
  o_orderstatus AS "RAW Message",
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) / 2 END AS "EmailPairID",
  CAST(o_orderkey % 9 AS DOUBLE) / 2 AS "WithinPatientID",
  CAST(o_orderkey % 2 AS INTEGER) AS "FirstInPair",
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS "MHP ID",
  CASE WHEN o_orderkey % 7 = 0 THEN '___' WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS "Unique ID",
  o_orderstatus AS "Cleaned Message"
FROM orders"""

# lenient tag rule written independently for the oracle
NUM_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def coerce_sql(c: str) -> str:
    return (f"CASE WHEN regexp_matches({c}, '{NUM_RE}') THEN "
            f"COALESCE(TRY_CAST(trunc(CAST(trim({c}) AS DOUBLE)) AS BIGINT), 0) ELSE 0 END")


def fx_train() -> str:
    tags = ", ".join(f"{coerce_sql(f'{t}_r1')} AS {t}" for t in fv.ALL_TAGS)
    return (f"SELECT doc_id, text, rtnl, {', '.join(fv.ALL_TAGS)}, "
            f"CASE WHEN {' OR '.join(f'coalesce({t} <> 0, true)' for t in fv.TARGETS)} THEN 1 ELSE 0 END AS trgt "
            f"FROM (SELECT doc_id, text, rtnl, {tags} FROM ({fx_annot()}))")


def with_fixtures(sql: str, **views: str) -> str:
    """Prefix ``sql`` with ``WITH name AS (...)`` for each fixture view."""
    if not views:
        return sql
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in views.items()) + "\n" + sql


# Sentences with names for some documents: (part, label) pairs; a part in
# braces is a name made of the id's hash, so most names occur once.
_LETTERS = "'0123456789abcdef', 'aeioubdklmnrstvy'"


def _name_sql(at: int, n: int) -> str:
    return (f"concat(upper(translate(substr(nh,{at},1),{_LETTERS})), translate(substr(nh,{at + 1},{n}),{_LETTERS}))")


NAME_SQL = {"given": _name_sql(1, 4), "family": _name_sql(7, 6), "town": _name_sql(14, 5), "firm": _name_sql(21, 5)}
SENTENCES = {
    "0": [("Please call ", None), ("{given} {family}", "PERSON"), (" at ", None), ("{firm} Group", "ORG"), (" before noon.", None)],
    "1": [("We met ", None), ("{given}", "PERSON"), (" in ", None), ("{town}", "GPE"), (" last week.", None)],
    "2": [("The ", None), ("{firm} Group", "ORG"), (" office in ", None), ("{town}", "GPE"), (" is closed.", None)],
    "3": [("Regards, ", None), ("{given} {family}", "PERSON")],
    "4": [("{given}", "PERSON"), (" wrote to ", None), ("{given} {family}", "PERSON"), (" on Monday.", None)],
    "5": [("A train to ", None), ("{town}", "GPE"), (" leaves at 9. Ask ", None), ("{firm} Group", "ORG"), (".", None)],
    "6": [("Thanks. Order 4411 ships in June, see Notes.", None)],
    "7": [("Meeting Room B is Free on Friday.", None)],
}


def part_sql(part: str) -> str:
    bits = []
    for x in part.replace("}", "{").split("{"):
        if x:
            bits.append(NAME_SQL.get(x) or "'" + x.replace("'", "''") + "'")
    return bits[0] if len(bits) == 1 else f"concat({', '.join(bits)})"


def sentence_case(per) -> str:
    """``CASE`` over the sentences; ``per(parts)`` gives the SQL of one."""
    return "CASE sk " + " ".join(f"WHEN '{k}' THEN {per(parts)}" for k, parts in SENTENCES.items()) + " END"


NAMED_BASE = ("SELECT doc_id, coalesce(text, '') AS body, md5(concat('name:', CAST(doc_id AS STRING))) AS nh, "
              "substr(md5(concat('sent:', CAST(doc_id AS STRING))),1,1) AS sk FROM documents")
SENTENCE_SQL = sentence_case(lambda parts: f"concat({', '.join(part_sql(p) for p, _ in parts)})")
