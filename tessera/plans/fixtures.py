"""Fixture views over the driver's tables.

The study's own sheets are private; these views give the same *shapes*
(messy tag cells, raw response sheets, LLM replies, scores) from the given
tables with md5 expressions that every engine evaluates alike, so each query
has an exact SQL oracle. Row counts grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..sources.io import load, spread
from . import oracle_fixtures as ofx

R1, R2 = "r1", "r2"


# The fixture definitions are SQL that Spark and DuckDB both accept (see
# FIXTURES.md); Spark parses each column once on the JVM side, which keeps
# plan construction to one call per column.

def _cell_of(h: str) -> str:
    return (f"CASE WHEN {h} < '30' THEN '1' WHEN {h} < 'a0' THEN '0' WHEN {h} < 'c8' THEN ' ' "
            f"WHEN {h} < 'd8' THEN '' WHEN {h} < 'e0' THEN '1.0' WHEN {h} < 'e4' THEN 'x' END")


def fx_annot(spark: SparkSession, base: str, tags=None) -> DataFrame:
    """One row per document with two raters' raw tag cells and a rationale.
    Same definition as FIXTURES.md; each md5 is computed once (a first
    projection of hash prefixes), which keeps the plan small."""
    tags = tags or fv.ALL_TAGS
    d = load(spark, base, "documents").selectExpr("doc_id", "text", "CAST(doc_id AS STRING) AS id")
    hashes = []
    for t in tags:
        hashes += [f"substr(md5(concat('{R1}:{t}:', id)),1,2) AS _h1_{t}",
                   f"substr(md5(concat('{R2}:{t}:', id)),1,2) AS _h2_{t}",
                   f"substr(md5(concat('agree:{t}:', id)),1,1) AS _ha_{t}"]
    hashes.append("substr(md5(concat('rtnl:', id)),1,1) AS _hr")
    h = d.selectExpr("doc_id", "text", "id", *hashes)
    exprs = []
    for t in tags:
        exprs.append(f"{_cell_of(f'_h1_{t}')} AS {t}_{R1}")
        exprs.append(f"CASE WHEN _ha_{t} < 'd' THEN {_cell_of(f'_h1_{t}')} ELSE {_cell_of(f'_h2_{t}')} END AS {t}_{R2}")
    exprs.append("CASE WHEN _hr = 'f' THEN CAST(NULL AS STRING) ELSE split_part(text, chr(10), 1) END AS rtnl")
    return h.selectExpr("doc_id", "text", "id", *exprs)


def fx_text(spark: SparkSession, base: str) -> DataFrame:
    """Documents with redaction terms and markers spliced into some texts."""
    return load(spark, base, "documents").selectExpr("doc_id", f"{ofx.SPLICE_SQL} AS text")


def fx_text_rtnl(spark: SparkSession, base: str) -> DataFrame:
    """:func:`fx_text` with the rationale of :func:`fx_annot` (the first line,
    missing for a sixteenth), the same terms spliced in."""
    return load(spark, base, "documents").selectExpr("doc_id", f"{ofx.SPLICE_SQL} AS text", f"{ofx.SPLICED_RTNL} AS rtnl")


def fx_reply(spark: SparkSession, base: str, aliases=None) -> DataFrame:
    """One simulated LLM reply per (document, code); row-local explode."""
    aliases = aliases or fv.LLM_CODES
    d = load(spark, base, "documents").select("doc_id", "text")
    d = d.select("doc_id", "text", F.explode(F.array(*[F.lit(a) for a in aliases])).alias("alias"))
    return d.selectExpr("doc_id", "alias", f"{ofx.REPLY_SQL} AS reply", "text")


def fx_scores(spark: SparkSession, base: str) -> DataFrame:
    """``labels`` in long form with a deterministic score (ties on purpose)."""
    lab = load(spark, base, "labels")
    long = lab.unpivot(["doc_id"], ["quality", "toxic"], "target", "y_true")
    prob = (F.pmod(F.col("doc_id") * 7919 + F.length("target") * 13, F.lit(1000)).cast("double") / 1000.0)
    return long.withColumns({"y_true": F.col("y_true").cast("int"), "y_prob": prob}).withColumns({
        "y_pred": (F.col("y_prob") > 0.5).cast("int"),
        "logit": (F.col("y_prob") - 0.5) * 8.0})


def fx_sheet(spark: SparkSession, base: str) -> DataFrame:
    """A raw response sheet built from ``orders`` (index column ``row_id``)."""
    o = load(spark, base, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("row_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.org")).alias("Email Address"),
        F.col("o_orderpriority").alias("Client Name"),
        F.concat(F.lit("Re: order "), k.cast("string")).alias("INBOX Line"),
        F.col("o_orderstatus").alias("RAW Message"),
        F.when(F.pmod(k, F.lit(11)) == 0, F.lit(None).cast("double"))
         .otherwise(F.col("o_custkey").cast("double") / 2).alias("EmailPairID"),
        (F.pmod(k, F.lit(9)).cast("double") / 2).alias("WithinPatientID"),
        F.pmod(k, F.lit(2)).cast("int").alias("FirstInPair"),
        F.when(F.pmod(k, F.lit(17)) == 0, F.lit(None).cast("double"))
         .otherwise(F.col("o_totalprice")).alias("MHP ID"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.lit("___")).when(F.pmod(k, F.lit(13)) == 0, F.lit(None).cast("string"))
         .otherwise(k.cast("string")).alias("Unique ID"),
        F.col("o_orderstatus").alias("Cleaned Message"),
    )


def fx_train(spark: SparkSession, base: str) -> DataFrame:
    """Annotated set: rater 1 tags (lenient), suffix removed, plus ``trgt``."""
    from ..operators.columns import composite_indicator
    from ..operators.labels import tag_coerce
    a = fx_annot(spark, base)
    d = a.select("doc_id", "text", "rtnl", *[tag_coerce(f"{t}_{R1}").alias(t) for t in fv.ALL_TAGS])
    return composite_indicator(d, fv.TARGETS, "trgt")


def fx_named(spark: SparkSession, base: str) -> DataFrame:
    """Documents, half of them with a last line that holds names made of the id's
    hash, and the annotated spans of these."""
    d = spread(load(spark, base, "documents").select("doc_id", "text")).selectExpr(
        "doc_id", "coalesce(text, '') AS body", "md5(concat('name:', CAST(doc_id AS STRING))) AS nh",
        "substr(md5(concat('sent:', CAST(doc_id AS STRING))),1,1) AS sk")

    def spans(parts) -> str:
        out, at = [], ["length(body)", "1"]
        for part, label in parts:
            sql = ofx.part_sql(part)
            if label:
                start = " + ".join(at)
                out.append(f"named_struct('start', CAST({start} AS INT), 'end', CAST({start} + length({sql}) AS INT), "
                           f"'label', '{label}', 'text', {sql})")
            at.append(f"length({sql})")
        return f"array({', '.join(out)})"

    none = "CAST(array() AS array<struct<start:int,end:int,label:string,text:string>>)"
    gold = ofx.sentence_case(lambda parts: spans(parts) if any(lab for _, lab in parts) else none)
    return d.selectExpr("doc_id", f"concat(body, coalesce(concat(chr(10), {ofx.SENTENCE_SQL}), '')) AS text",
                        f"coalesce({gold}, {none}) AS gold")
