"""Kappa intervals, rater errors and the correcting stream against plain versions."""

import hashlib
import itertools
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import agreement, rater_error
from tessera.streaming import corrected_kappa, kappa_corrections


def plain_kappa(pairs):
    """Weighted pairs: {(a, b): weight}"""
    n = sum(pairs.values())
    left, right = Counter(), Counter()
    for (a, b), w in pairs.items():
        left[a] += w
        right[b] += w
    pe = sum(left[k] * right[k] for k in left)
    agree = sum(w for (a, b), w in pairs.items() if a == b)
    return round((n * agree - pe) / (n * n - pe), 6) if n * n != pe else None


def test_kappa_replicates(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(2), rng.randrange(2), int(k == 3), 0) for k in range(150)]
    rows = [(k, a, a if rng.random() < 0.7 else b, c, d) for k, a, b, c, d in rows]
    df = spark.createDataFrame(rows, "id long, x_a int, x_b int, y_a int, y_b int").repartition(5)
    got = {(r.rep, r.tag): r.kappa for r in agreement.kappa_replicates(df, ["x", "y"], "a", "b", "id", 21, seed=7).collect()}
    steps = agreement.POISSON_STEPS
    assert steps[0] == int(65536 / math.e) and len(steps) == 8
    total = Counter()
    for rep in range(21):
        cells = {"x": Counter(), "y": Counter()}
        for k, xa, xb, ya, yb in rows:
            u = int(hashlib.md5(f"boot:7:{rep // 8}:{k}".encode()).hexdigest()[4 * (rep % 8):][:4], 16)
            w = sum(u >= s for s in steps)
            total[w] += 1
            if w:
                cells["x"][xa, xb] += w
                cells["y"][ya, yb] += w
        assert {t: plain_kappa(c) for t, c in cells.items()} == {t: got[rep, t] for t in "xy"}
    assert abs(sum(w * n for w, n in total.items()) / (150 * 21) - 1) < 0.06  # Poisson with mean 1
    out = {r.tag: r for r in agreement.kappa_intervals(df, ["x", "y"], "a", "b", "id", 21, seed=7).collect()}
    ks = sorted(got[r, "x"] for r in range(21))
    assert math.isclose(out["x"].lo, np.percentile(ks, 2.5), abs_tol=2e-6) and math.isclose(out["x"].hi, np.percentile(ks, 97.5), abs_tol=2e-6)
    assert out["x"].lo < out["x"].kappa < out["x"].hi and out["x"].n == 150
    with pytest.raises(Exception, match="missing value"):
        agreement.kappa_replicates(df.withColumn("x_a", F.lit(None).cast("int")), ["x"], "a", "b", "id", 3).collect()


def plain_errors(rows, raters, iterations):
    """Row by row, without counting combinations."""
    chance = []
    for r in rows:
        given = [x for x in r if x is not None]
        chance.append(sum(given) / len(given) if given else 0.5)
    for _ in range(iterations):
        prev = (sum(chance) + 1) / (len(rows) + 2)
        se, sp = [], []
        for k in range(raters):
            have = [(r[k], c) for r, c in zip(rows, chance) if r[k] is not None]
            se.append((sum(c for x, c in have if x == 1) + 1) / (sum(c for _, c in have) + 2))
            sp.append((sum(1 - c for x, c in have if x == 0) + 1) / (sum(1 - c for _, c in have) + 2))
        new = []
        for r in rows:
            a, b = prev, 1 - prev
            for k, x in enumerate(r):
                if x is not None:
                    a *= se[k] if x else 1 - se[k]
                    b *= 1 - sp[k] if x else sp[k]
            new.append(a / (a + b))
        chance = new
    return prev, se, sp, chance


def test_rater_errors(spark):
    rng = random.Random(5)
    truth = [rng.random() < 0.3 for _ in range(600)]
    rows = []
    for k, t in enumerate(truth):
        def say(right):
            return None if rng.random() < 0.1 else int(t if rng.random() < right else not t)
        rows.append((k, say(0.95), say(0.9), say(0.7), None))
    rows.append((600, None, None, None, None))
    df = spark.createDataFrame(rows, "id long, c_p int, c_q int, c_m int, d_p int").withColumns({"d_q": F.lit(None).cast("int"), "d_m": F.lit(1)})
    errors, post = rater_error.rater_errors(df, ["c", "d"], ["p", "q", "m"], iterations=30)
    prev, se, sp, chance = plain_errors([r[1:4] for r in rows], 3, 30)
    got = {r.rater: r for r in errors.where("code = 'c'").collect()}
    for k, r in enumerate("pqm"):
        assert math.isclose(got[r].sensitivity, se[k], abs_tol=2e-6) and math.isclose(got[r].specificity, sp[k], abs_tol=2e-6)
        assert got[r].n == sum(x[1 + k] is not None for x in rows) and math.isclose(got[r].prevalence, prev, abs_tol=2e-6)
    assert got["p"].sensitivity > got["m"].sensitivity
    out = {r.id: r for r in rater_error.triangulate_by_error(df, ["c", "d"], ["p", "q", "m"], iterations=30).collect()}
    assert all(math.isclose(out[k].c_p_yes, c, abs_tol=2e-6) for k, c in enumerate(chance))
    right = sum(out[k].c_triangulate == t for k, t in enumerate(truth))
    majority = sum((sum(x or 0 for x in r[1:4]) >= 2) == t for r, t in zip(rows, truth))
    assert right >= majority and right > 540
    none = df.where("id < 0")
    assert rater_error.rater_errors(none, ["c"], ["p", "q"])[1].isEmpty()
    with pytest.raises(Exception, match="neither 0 nor 1"):
        rater_error.rater_errors(df.withColumn("c_p", F.lit(2)), ["c"], ["p", "q"])
    with pytest.raises(ValueError):
        rater_error.rater_errors(df, ["c"], ["p"])


def test_corrections(spark, scratch):
    rng = random.Random(8)
    src, sink, state = (os.path.join(scratch, x) for x in ("events", "sink", "state"))
    schema = "row long, tag string, rater string, value int, seq long, note string"
    last = {}
    for batch in range(3):
        events = []
        for _ in range(400):
            e = (rng.randrange(40), rng.choice(["t", "u"]), rng.choice("ab"), rng.choice([0, 0, 1, 1, 2, None]), rng.randrange(300) + 100 * batch, None)
            if (e[0], e[1], e[2], e[4]) not in last:
                events.append(e)
                last[(e[0], e[1], e[2], e[4])] = e[3]
        events += rng.sample(events, 50)  # seen twice
        spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        query = kappa_corrections(stream, sink, state, key="row")  # starts again where it was
        query.awaitTermination()
        newest = {}
        for (row, tag, rater, seq), value in sorted(last.items(), key=lambda x: x[0][3]):
            newest[row, tag, rater] = value
        for tag in "tu":
            pairs = Counter()
            for row in range(40):
                a, b = newest.get((row, tag, "a")), newest.get((row, tag, "b"))
                if a is not None and b is not None:
                    pairs[a, b] += 1
            got = {r.tag: (r.n, r.kappa) for r in corrected_kappa(spark, sink).collect()}
            assert got[tag] == (sum(pairs.values()), plain_kappa(pairs))


def test_corrections_of_nothing(spark, scratch):
    assert corrected_kappa(spark, os.path.join(scratch, "none")).isEmpty()


def test_answer_patterns(spark):
    rows = list(itertools.product([0, 1, None], repeat=2)) * 2
    df = spark.createDataFrame(rows, "c_p int, c_q int")
    got = {r.pattern: r.n for r in rater_error.answer_patterns(df, ["c"], ["p", "q"]).collect()}
    assert got == {a + b: 2 for a in "01-" for b in "01-"}


def test_corrections_call_python_by_bucket(spark, scratch):
    """A micro-batch calls Python for each bucket, not for each row; keys of any type, null too."""
    from tessera.streaming import corrections

    src, sink, state = (os.path.join(scratch, x) for x in ("events", "sink", "state"))
    schema = "row timestamp, tag string, rater string, value int, seq long"
    rows = spark.range(300).select(F.when(F.col("id") > 0, F.timestamp_micros("id")).alias("row"), F.col("id").alias("n"))
    events = rows.select("row", F.lit("t").alias("tag"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("rater"),
                         (F.col("n") % 2).cast("int").alias("value"))
    events = events.select("row", "tag", "rater", "value", F.explode(F.array(F.lit(0), F.lit(-1), F.lit(None)).cast("array<long>")).alias("seq"))
    events.coalesce(1).write.parquet(src)
    query = kappa_corrections(spark.readStream.schema(schema).parquet(src), sink, state, key="row", buckets=8)
    query.awaitTermination()
    assert sum(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:]) <= 8
    got = corrected_kappa(spark, sink).first()
    assert (got.n, got.kappa) == (300, 1)
    now = {(None, "t"): [0, 1, None, -1], ("x", "u"): [1, 2, 3, 4]}
    assert corrections._unpacked(corrections._packed(now)) == now
