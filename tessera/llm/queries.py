"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact, fim, lexical, licences, lines, mixing, multiindex, packing, simhash, suffix, toxicity, warc
from .common import NO_ID

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def q(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@q
def op1_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


ORACLE["op1_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t
"""


@q
def op5_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@q
def op6_warc(spark, sf_dir):
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     s AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d,
                  max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM s
"""


@q
def op10_mixing(spark, sf_dir):
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


@q
def op8_embedding_groups(spark, sf_dir):
    return multiindex.embedding_groups(table(spark, sf_dir, "embeddings"))


@q
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select(
        F.col("_d").alias("doc_id"), (F.crc32(F.coalesce(F.col("_d").cast("string"), F.lit(""))) % 4 == 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


@q
def op2_line_dedup(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select(
        F.nullif("_id", F.lit(NO_ID)).alias("doc_id"), "n_lines", "n_exact", "n_near", "text")


ORACLE["op2_line_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     l AS (SELECT doc_id, k, trim(regexp_replace(lower(ls[k + 1]), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS t
           FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS k FROM d)),
     r AS (SELECT doc_id, k, string_split(t, ' ') AS w, row_number() OVER (PARTITION BY t ORDER BY doc_id, k) AS nth
           FROM l WHERE t <> ''),
     v AS (SELECT doc_id, k, len(w) AS m, i, array_to_string(w[1:i], ' ') || chr(1) || array_to_string(w[i + 2:], ' ') AS rest
           FROM (SELECT *, unnest(range(len(w))) AS i FROM r WHERE nth = 1 AND len(w) >= 5)
           UNION ALL
           SELECT doc_id, k, len(w) + 1, i, array_to_string(w[1:i], ' ') || chr(1) || array_to_string(w[i + 1:], ' ')
           FROM (SELECT *, unnest(range(len(w) + 1)) AS i FROM r WHERE nth = 1 AND len(w) >= 5)),
     gone AS (SELECT doc_id, k, 1 AS exact FROM r WHERE nth > 1 UNION ALL
              SELECT DISTINCT doc_id, k, 0 FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY m, i, rest ORDER BY doc_id, k)
                                                 AS nth FROM v) WHERE nth > 1),
     g AS (SELECT doc_id, list(k) AS ks, sum(exact) AS e, sum(1 - exact) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ls) AS INTEGER) AS n_lines, CAST(coalesce(e, 0) AS INTEGER) AS n_exact,
       CAST(coalesce(n, 0) AS INTEGER) AS n_near,
       CASE WHEN ks IS NULL THEN text ELSE array_to_string([ls[k + 1] FOR k IN range(len(ls)) IF NOT list_contains(ks, k)],
                                                           chr(10)) END AS text
FROM d LEFT JOIN g USING (doc_id)
"""


@q
def op4_licences(spark, sf_dir):
    # the documents as files of a tree: source, thousands, hundreds, one file each
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100) % 10,
                       F.concat(F.col("doc_id"), F.lit(".txt")))
    return licences.scan_licences(docs.select("doc_id", path.alias("path"), "text"), "doc_id", "path", "text")


@q
def op7_suffix_dedup(spark, sf_dir):
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op7_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     c AS (SELECT doc_id, len(h) // 2 - 99 AS n, q, substr(h, 1024 * q + 1, 1222) AS x
           FROM (SELECT doc_id, h, unnest(range(0, len(h) // 1024 + 1)) AS q FROM d)),
     s AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS nth
           FROM (SELECT doc_id, 512 * q + i AS p, md5(substr(x, 2 * i + 1, 200)) AS g
                 FROM (SELECT *, unnest(range(0, least(512, n - 512 * q))) AS i FROM c))),
     m AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, false) AS far
           FROM s WHERE nth > 1),
     runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z
              FROM (SELECT doc_id, p, count(*) FILTER (WHERE far) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM m)
              GROUP BY doc_id, i),
     cut AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM runs),
     kept AS (SELECT doc_id, sum(z - a) AS r, count(*) AS k, max(z) AS last,
                     string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS x
              FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(k, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(x || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@q
def op9_packing(spark, sf_dir):
    import public_tokenizers

    out = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@q
def op11_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE["op11_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     g AS (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS x
           FROM (SELECT item, w, least(len(w), 10) AS l, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
                 FROM b WHERE len(w) > 0)),
     h AS (SELECT DISTINCT doc_id, i, t.l, item
           FROM (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS x
                 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT l FROM g)
                 WHERE i + l - 1 <= len(w)) t JOIN g ON g.x = t.x AND g.l = t.l),
     hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
     its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
             FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@q
def op12_fill_in_middle(spark, sf_dir):
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"),
                      F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
     k AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
                  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
                  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
     c AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
                  least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b FROM k),
     p AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid,
                  array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


@q
def op13_lexical_search(spark, sf_dir):
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark"))


ORACLE["op13_lexical_search"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, unnest(regexp_extract_all(
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark),
     q AS (SELECT item_id, t, count(*) AS c FROM b GROUP BY item_id, t),
     g AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
     p AS (SELECT doc_id, t, count(*) AS tf, any_value(m) AS m
           FROM (SELECT doc_id, unnest(w) AS t, 75 + (25 * len(w) * n) // l AS m FROM d, g WHERE len(w) > 0)
           WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
     f AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM p, g GROUP BY t, n),
     s AS (SELECT item_id, doc_id, CAST(sum(c * wt * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
           FROM q JOIN p USING (t) JOIN f USING (t) GROUP BY item_id, doc_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""
