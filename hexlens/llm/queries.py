"""The operators' queries over the driver tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexlens.llm import bpe, conversations, decontam, jaccard, language, mining, neighbours, packing, quality, substring, token_counts, toxicity, urls
from hexlens.llm.common import prepare, table


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return substring.dedup(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("ss_n_words").alias("n_words"), F.col("ss_n_removed").alias("n_removed"),
        F.sha2("ss_kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
d AS (SELECT sha256(k) AS h FROM s GROUP BY 1 HAVING count(*) > 1),
g AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM s WHERE sha256(k) IN (SELECT h FROM d)) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN g USING (r)
"""


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.join(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT r, k FROM (SELECT r, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.r <> b.r GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 5 * c >= 4 * (a.n + b.n - c)),
t(x, y) AS (SELECT x, y FROM e UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x),
c AS (SELECT x AS r, min(doc_id) AS d FROM t JOIN w ON w.r = t.y GROUP BY x),
l AS (SELECT x AS r, count(*) AS n_links FROM e GROUP BY x)
SELECT doc_id, CASE WHEN c.d IS NULL THEN doc_id ELSE least(c.d, doc_id) END AS class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM w LEFT JOIN c USING (r) LEFT JOIN l USING (r)
"""


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language.identify(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mining.mine(table(spark, sf_dir, "embeddings"), shift_every=7)


OP11_SQL = r"""
WITH p AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, p.vec_id, p.label, list_sum(list_transform(list_zip(a.v, p.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM p a JOIN p ON a.vec_id % 100 = 0 AND p.vec_id <> a.vec_id AND len(p.v) = len(a.v)),
g AS (SELECT * FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, g.vec_id AS positive_id, (row_number() OVER (PARTITION BY anchor_id, g.vec_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
  s.vec_id AS negative_id, g.score AS positive_score, s.score AS negative_score
FROM g JOIN s USING (anchor_id) WHERE s.label <> s.own AND 80 * g.score <= 100 * s.score AND 100 * s.score <= 100 * g.score QUALIFY rank <= 5
"""


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.decode(bpe.encode(table(spark, sf_dir, "documents"))).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return conversations.report(conversations.damage(table(spark, sf_dir, "conversations")), present_col="present")


QUERIES = {"op1_substring": op1_substring, "op2_jaccard": op2_jaccard, "op3_neighbours": op3_neighbours, "op4_language": op4_language, "op5_token_counts": op5_token_counts, "op6_quality": op6_quality, "op7_packing": op7_packing,
           "op8_toxicity": op8_toxicity, "op9_urls": op9_urls, "op10_decontamination": op10_decontamination, "op11_hard_negatives": op11_hard_negatives, "op12_bpe": op12_bpe, "op13_conversations": op13_conversations}
SQL = {"op1_substring": OP1_SQL, "op2_jaccard": OP2_SQL, "op11_hard_negatives": OP11_SQL}
