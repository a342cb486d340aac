"""The corpus pipeline: documents in, packed training sequences out.

Each stage calls one operator of ``tessera.llm`` on all that the stage before
kept; what a stage returns is written as Parquet and read again. Null and empty
texts, null and repeated ids, rows that repeat in whole, texts of any length and
further columns go through every stage; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import lines, mixing, packing, simhash, toxicity
from tessera.llm.common import saved

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3. Learned from the labels of
    documents that are still here; without labels of both classes all stay, and
    so do null and empty texts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean_documents(docs, toxicity.fit(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat or nearly repeat an
    earlier one; n_chars follows the text. A document may end up empty."""
    out = lines.dedup_lines(docs, carry=True, links_table=True)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates one row: that with the smallest
    id, null ids last, and of these the smallest hash of text, then of row."""
    groups = simhash.simhash_groups(docs, shingle=3, most=3, row_key=True)
    groups = saved(groups.select(F.col("doc_id").alias("_tz_id"), "_tz_ht", "_tz_hr", "_c"), "groups")
    stay = groups.groupBy("_c").agg(F.min(F.struct(F.col("_tz_id").isNull().alias("_no"), "_tz_id", "_tz_ht", "_tz_hr")).alias("_k"))
    stay = stay.select("_k._tz_id", "_k._tz_ht", "_k._tz_hr")
    key = ["_tz_ht", "_tz_hr"]
    repeated = not groups.groupBy("_tz_id", *key).count().where("count > 1").isEmpty()
    out = docs.select("*", *simhash.row_hashes(docs))
    same = F.col("doc_id").eqNullSafe(F.col("_tz_id")) & (out["_tz_ht"] == stay["_tz_ht"]) & (out["_tz_hr"] == stay["_tz_hr"])
    out = out.join(stay, same, "left_semi")
    # rows that repeat in whole share a key, and a component
    return (out.dropDuplicates(["doc_id", *key]) if repeated else out).drop(*key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: a row per document and pass over
    its source, with the words taken. Documents without words are not taken."""
    out = mixing.mixed_documents(docs, mixing.mix(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens; ids are little-endian
    unsigned 32-bit. A null or empty text is one id, its end. The workers' word
    tables are kept small: the workers live on beside those of other stages."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), cache_words=200_000)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("simhash", drop_near_copies), ("mixing", mix_sources),
          ("packing", pack)]
ORACLE_SQL = None  # a learned model, hashes and random draws are not SQL; tests/llm compares plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{k}")
    return docs
