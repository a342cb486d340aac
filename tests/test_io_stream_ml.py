"""Sources/sinks, the streaming path and a small Spark ML round trip."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import ml
from tessera.sources import io as sio
from tessera.sources.codebook import codebook
from tessera.streaming import clean_text, clean_text_stream


def test_write_table_partitioned_and_pruned(spark, scratch):
    df = spark.range(20).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("cycle"))
    path = os.path.join(scratch, "cycles")
    sio.write_table(df, path, partition_by=["cycle"])
    back = spark.read.parquet(path).where("cycle = 1")
    assert back.count() == 7
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cycle" in plan


def test_overwrite_keeps_other_partitions(spark, scratch):
    df = spark.range(20).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("cycle"))
    path = os.path.join(scratch, "cycles")
    for cycle in (0, 1, 2, 1):
        sio.write_table(df.where(F.col("cycle") == cycle), path, partition_by=["cycle"])
    assert spark.read.parquet(path).count() == 20


def test_partitions_with_manifest(spark, scratch):
    path, by = os.path.join(scratch, "packets"), ["cycle", "kind"]
    rows = [(k, k % 3, None if k % 5 == 0 else "01", f"t{k}") for k in range(30)]
    df = spark.createDataFrame(rows, "row_id long, cycle int, kind string, text string")
    assert sio.read_partitions(spark, path, df.schema, by).isEmpty()
    sio.write_partitions(df, path, by)
    want = sorted(map(str, rows))
    for again in (df, df.where("cycle = 1"), df.limit(0)):
        sio.write_partitions(again, path, by)
        back = sio.read_partitions(spark, path, df.schema, by)
        assert sorted(str(tuple(r)) for r in back.collect()) == want and back.columns == df.columns
        assert sio.check_partitions(spark, path, df.schema, by).isEmpty()
    assert sio.read_manifest(spark, path, df.schema, by).count() == 6
    # a run that dies before its manifest: its partitions do not show until it runs again
    half = df.where("cycle = 2").withColumn("text", F.lit("new"))
    sio.write_table(half.withColumn(sio.RUN, F.lit("dead")), f"{path}/data", by)
    back = sio.read_partitions(spark, path, df.schema, by)
    assert back.count() == 20 and back.where("cycle = 2").isEmpty()
    assert sio.check_partitions(spark, path, df.schema, by).count() == 2
    sio.write_partitions(half, path, by)
    assert sio.read_partitions(spark, path, df.schema, by).where("cycle = 2 and text = 'new'").count() == 10
    plan = back.where("cycle = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cycle" in plan
    with pytest.raises(ValueError):
        sio.write_partitions(df.withColumn("_run", F.lit(1)), path, by)


def test_write_csv_header(spark, scratch):
    df = spark.createDataFrame([(1, "a")], "config_id int, name string")
    path = os.path.join(scratch, "csv")
    sio.write_csv(df.coalesce(1), path)
    part = [f for f in os.listdir(path) if f.endswith(".csv")][0]
    assert open(os.path.join(path, part)).read().splitlines() == ["config_id,name", "1,a"]


def test_read_terms(spark, scratch):
    path = os.path.join(scratch, "names.txt")
    with open(path, "w") as f:
        f.write("  Ann \n\n\tBob \n   \nCy\n")
    assert sio.terms_list(sio.read_terms(spark, path)) == ["Ann", "Bob", "Cy"]


def test_read_table_row_id_and_schema(spark):
    df = sio.read_table(spark, sio.table_path("/root/testdata/sf0.001", "labels"), row_id="doc_id")
    assert df.columns[0] == "row_id" and df.count() > 0


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    got = {r.column_name: (r.dtype, r.non_null, r.n_rows) for r in sio.profile(df).collect()}
    assert got == {"a": ("bigint", 2, 2), "b": ("string", 1, 2)}


def test_codebook_defaults(spark):
    cb = codebook(spark, rows=[("x", "X", "def\n", None, None)])
    r = cb.first()
    assert (r.clarification, r.examples, r.definition) == ("", "", "def\n")


def test_stream_equals_batch(spark, scratch):
    src = os.path.join(scratch, "src")
    rows = [(1, "Hi Daniel <|AFRM|> 42\nbye"), (2, "nothing")]
    batch = spark.createDataFrame(rows, "doc_id long, text string")
    batch.write.parquet(src)
    q = clean_text_stream(spark, src, batch.schema, os.path.join(scratch, "out"), os.path.join(scratch, "ckpt"))
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(os.path.join(scratch, "out")).collect())
    assert got == sorted(tuple(r) for r in clean_text(batch).collect())
    assert got[0][1] == "Hi" + " " * 6 + "bye"


def test_ml_round_trip(spark):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text")
    d = spark.read.parquet(f"{base}/labels.parquet").join(docs, "doc_id")
    d = d.withColumn("trgt", ((F.col("quality") != 0) | (F.col("toxic") != 0)).cast("int"))
    _, feats = ml.featurize(d, num_features=1 << 10)
    models = ml.fit_multilabel(feats, ["quality", "toxic"], {"maxIter": 5})
    m = ml.evaluate(models, feats, "doc_id", ["quality", "toxic"]).collect()
    assert {r.metric for r in m} == {"f1_macro", "mcc", "auprc"}
    _, summary = ml.cross_validate(feats, "doc_id", ["quality", "toxic"], k=2, params={"maxIter": 3})
    assert summary.count() > 0


def test_workflows(spark, scratch):
    from tessera import fixed_values as fv
    from tessera.plans import fixtures as fx
    from tessera.plans import workflows as wf
    base = "/root/testdata/sf0.001"
    a = fx.fx_annot(spark, base)
    r1 = a.select("doc_id", *[F.col(f"{t}_r1").alias(t) for t in fv.ALL_TAGS])
    r2 = a.select("doc_id", *[F.col(f"{t}_r2").alias(t) for t in fv.ALL_TAGS])
    rep = wf.agreement_report(r1, r2, "doc_id")
    assert rep["kappa"].count() == 9 and rep["disagreements"].count() == a.count()
    human = fx.fx_train(spark, base).select("doc_id", *fv.ALL_TAGS)
    replies = fx.fx_reply(spark, base).select("doc_id", "alias", "reply")
    tri = wf.triangulated_labels(human, replies, "doc_id")
    assert set(tri.columns) == {"doc_id", *fv.ALL_TAGS}
    pool = fx.fx_train(spark, base).withColumnRenamed("doc_id", "row_id")
    packet, masked = wf.annotation_packets(pool, 20, 0, 56, out_dir=os.path.join(scratch, "cycles"))
    assert packet.count() == 20 and masked.count() == 20
    out = os.path.join(scratch, "cycles")
    for _ in range(2):  # a cycle run again is there once
        back = sio.read_partitions(spark, f"{out}/r1", packet.schema, ["cycle"])
        assert back.where("cycle = 0").count() == 20 and back.columns == packet.columns
        wf.annotation_packets(pool, 20, 0, 56, out_dir=out)
    wf.annotation_packets(pool, 20, 1, 56, out_dir=out)
    assert sio.read_partitions(spark, f"{out}/r2", masked.schema, ["cycle"]).count() == 40


def test_kappa_stream_matches_batch(spark, scratch):
    from tessera import fixed_values as fv
    from tessera.operators.agreement import cohen_kappa
    from tessera.operators.labels import normalize_tags
    from tessera.plans import fixtures as fx
    from tessera.streaming import kappa_stream
    cols = [f"{t}_{s}" for t in fv.ALL_TAGS for s in ("r1", "r2")]
    pairs = fx.fx_annot(spark, "/root/testdata/sf0.001").select("doc_id", *cols)
    src = os.path.join(scratch, "pairs")
    # two files arrive: the state must add them up
    pairs.where("doc_id % 2 = 0").write.parquet(src)
    pairs.where("doc_id % 2 = 1").write.mode("append").parquet(src)
    stream = spark.readStream.schema(pairs.schema).parquet(src)
    q = kappa_stream(stream, fv.ALL_TAGS, "r1", "r2", os.path.join(scratch, "kappa"), os.path.join(scratch, "ck"))
    q.awaitTermination(180)
    got = {r.tag: r.kappa for r in spark.read.parquet(os.path.join(scratch, "kappa")).collect()}
    want = {r.tag: r.kappa for r in cohen_kappa(normalize_tags(pairs, cols, "coerce"), fv.ALL_TAGS, "r1", "r2")
            .collect()}
    assert got == want


def test_training_set_faithful_gap(spark):
    from tessera.plans import workflows as wf
    rows = [(i, f"text {i}", f"why {i}", 1, 0, 0, 0) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, text string, rtnl string, afrm int, agnt int, fitt int, refl int")
    fixed = {(r.row_id, r.seq): r.text for r in wf.training_set(df, n_calibrate=5).collect()}
    faithful = {(r.row_id, r.seq): r.text for r in wf.training_set(df, n_calibrate=5, faithful=True).collect()}
    assert fixed[(3, 1)] == "why  " and faithful[(3, 1)] == "why 3"   # the copy bypasses numeral stripping
    assert fixed[(3, 0)] == faithful[(3, 0)] == "text  "


def test_read_table_csv_with_schema(spark, scratch):
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    path = os.path.join(scratch, "sheet.csv")
    with open(path, "w") as f:
        f.write("idx,text,afrm\n0,hello, \n1,bye,1\n")
    schema = StructType([StructField("idx", LongType()), StructField("text", StringType()),
                         StructField("afrm", StringType())])
    df = sio.read_table(spark, path, schema=schema, row_id="idx", fmt="csv", header=True,
                        ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)
    assert df.columns == ["row_id", "text", "afrm"]
    assert [(r.row_id, r.afrm) for r in df.orderBy("row_id").collect()] == [(0, " "), (1, "1")]
