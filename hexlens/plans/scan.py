"""Scan queries: C1, C2, the stream and the file source, each with an oracle.

The experts are deterministic stand-ins (a score out of the content hash), so
that verdicts have an exact oracle; the model-fitting queries are elsewhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexlens.catalog import register
from hexlens.operators import families as FM
from hexlens.operators.scan import scan_corpus, scan_summary, virus_family
from hexlens.plans.pe_corpus import _ERROR, _FILES, pe_files
from hexlens.plans.sqlparts import FILES_CTE
from hexlens.session import materialize_once, scratch_table_path
from hexlens.sources import files as SF
from hexlens.sources import sinks as SK
from hexlens.sources.tables import documents_as_files, table
from hexlens.streaming.requests import answer
from hexlens.streaming.scan_stream import run_scan_stream, verdicts

def normal() -> Column:
    return F.conv(F.substring("sha256", 1, 6), 16, 10).cast("double") / float(1 << 24)


def packed() -> Column:
    return 1.0 - normal()


def _hash_score(sha: str) -> str:
    return f"(('0x' || substr({sha}, 1, 6))::BIGINT / {1 << 24}.0::DOUBLE)"


def scan_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PE corpus; every 19th file lies outside the scanned folder."""
    f = pe_files(spark, sf_dir)
    return f.withColumn("path", F.when(F.col("k") % 19 == 0, F.format_string("elsewhere/%d.exe", "k")).otherwise(F.col("path")))


def known_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of the contents of even keys: 0.99 for every fourth, else 0.25."""
    f = scan_inputs(spark, sf_dir).where("k % 2 = 0")
    score = F.when(F.col("k") % 4 == 0, 0.99).otherwise(0.25)
    family = F.when(F.col("k") % 4 == 0, F.struct(F.lit(7).alias("cluster_id"), F.lit("Malware_Family_7_Size9").alias("family_name"), F.lit(False).alias("is_new_family")))
    rows = f.select(F.sha2("content", 256).alias("sha256"), score.alias("score"), family.alias("malware_family"))
    return rows.groupBy("sha256").agg(F.max("score").alias("score"), F.max("malware_family").alias("malware_family"))


def far_family(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A family model that every file is far from (one centroid, threshold 0 but for its own members)."""
    n = 1549
    model = spark.range(1).select(F.lit(1).alias("cluster_id"), F.array_repeat(F.lit(1e6), n).alias("centroid"), F.lit(1.0).alias("threshold"),
                                  F.lit("Malware_Family_1_Size1").alias("family_name"), F.lit(1).cast("long").alias("n"))
    scaler = spark.range(1).select(F.array_repeat(F.lit(0.0), n).alias("mean"), F.array_repeat(F.lit(1.0), n).alias("scale"))
    return model, scaler


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, scaler = far_family(spark, sf_dir)
    return materialize_once(spark, ("scan", sf_dir), lambda: scan_corpus(
        scan_inputs(spark, sf_dir).select("path", "length", "content"), {0: normal(), 1: normal()}, model, scaler,
        known_verdicts(spark, sf_dir), allowed_root="corpus"), "scan-results")


# contents: an image is its key's own, truncated images are all equal, other files are equal if their names are
_CACHED = f"""
WITH {_FILES},
c AS (SELECT *, CASE WHEN k % 17 = 16 THEN 't' || coalesce(p_name, '') WHEN k % 13 = 12 THEN 'x' ELSE 'k' || k END AS content FROM f),
known AS (SELECT content, bool_or(k % 4 = 0) AS bad FROM c WHERE k % 2 = 0 GROUP BY content),
r AS (SELECT k, known.content IS NOT NULL AS hit, known.bad FROM c LEFT JOIN known USING (content) WHERE k % 19 <> 0 AND (pe OR known.content IS NOT NULL))"""


@register("scan_corpus", operators=("C1", "J1", "P1", "P2", "P5", "P12", "M8"), sql=_CACHED + """
SELECT k, k || '.exe' AS file_name, hit AS cache_hit, true AS score_known, bad AS cached_verdict,
       CASE WHEN bad THEN 'Malware_Family_7_Size9' END AS cached_family, true AS verdict_holds, true AS family_holds
FROM r
""")
def q_scan_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guard, cache (hits carry the cached verdict and skip the features), PE check, route, verdict, family.

    Misses are checked against the stand-in's score and the rules of verdict
    and family; a hit of a file that is no image is still a hit.
    """
    r = _scan(spark, sf_dir)
    hit, name = F.col("cache_hit"), F.col("file_name")
    verdict = F.when(F.col("is_malware"), F.col("confidence") == F.col("score")).otherwise(F.col("confidence") == 1 - F.col("score"))
    new = F.col("is_malware") & (F.col("virus_family") == "New_Unknown_Family") & F.col("malware_family.is_new_family")
    return r.select(F.split(name, r"\.")[0].cast("long").alias("k"), name, hit,
                    (hit | (F.abs(F.col("score") - normal()) < 1e-12)).alias("score_known"), F.when(hit, F.col("is_malware")).alias("cached_verdict"),
                    F.when(hit, F.col("virus_family")).alias("cached_family"), ((F.col("is_malware") == (F.col("score") > 0.98)) & verdict).alias("verdict_holds"),
                    (hit | F.when(F.col("is_malware"), new).otherwise(F.col("malware_family").isNull())).alias("family_holds"))


@register("scan_native", operators=("C2", "F12", "M8", "F9"), sql=f"""
WITH {_FILES},
u AS (SELECT k, max((name = 'UPX0')::INT) AS route FROM s0 GROUP BY k)
SELECT f.k, coalesce(u.route, 0)::INTEGER AS route, true AS score_known, CASE WHEN pe THEN {_ERROR.replace('k %', 'f.k %')} END AS error FROM f LEFT JOIN u USING (k)
""")
def q_scan_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file (no PE check, no cache), the native rule; a packed file is scored by the packed expert."""
    r = scan_corpus(pe_files(spark, sf_dir).select("path", "length", "content"), {0: normal(), 1: packed()}, require_pe=False, rule="native", native=True)
    want = F.when(F.col("route") == 1, packed()).otherwise(normal())
    return r.select(F.split("file_name", r"\.")[0].cast("long").alias("k"), "route", (F.abs(F.col("score") - want) < 1e-12).alias("score_known"), "error")


@register("scan_report", operators=("A35", "P5"), sql=_CACHED + """
SELECT count(*)::BIGINT AS files, count_if(bad)::BIGINT AS cached_malware, true AS totals_hold FROM r
""")
def q_scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, malware and new families of the scan; new families are the malicious misses (the family model is far)."""
    r = _scan(spark, sf_dir)
    s = scan_summary(r)
    parts = r.agg(F.sum((F.col("cache_hit") & F.col("is_malware")).cast("int")).cast("bigint").alias("cached_malware"),
                  F.sum((~F.col("cache_hit") & F.col("is_malware")).cast("int")).cast("bigint").alias("other"))
    return s.crossJoin(F.broadcast(parts)).select("files", "cached_malware", (  # one row each
        (F.col("new_families") == F.col("other")) & (F.col("malware") == F.col("cached_malware") + F.col("other"))).alias("totals_hold"))


# ---------------------------------------------------------------------------
# files on storage: a card file for every supplier
# ---------------------------------------------------------------------------

CARDS = 1000  # that one task writes


def write_cards(spark: SparkSession, sf_dir: str, text: str, name: str) -> str:
    """One text file a supplier in a folder of its own under the shared folder; returns the root.

    A folder and a file take some milliseconds, so tasks write them side by side
    and move their own (the second commit algorithm; nobody reads before the end).
    On a local disk Spark's file system would write a file of checksums beside each
    and start a process for each permission that it sets, most of the time of a
    file: this write takes the plain one.
    """
    root = scratch_table_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    cards = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(text).alias("value"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-cards.count() // CARDS))
    (cards.repartition(tasks, "s_suppkey").write.partitionBy("s_suppkey")
          .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
          .option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem").option("fs.file.impl.disable.cache", "true").text(root))
    return root


_CARD = "concat(s_name, repeat(' *', cast(s_nationkey as int)))"
_CARD_SQL = "s_name || repeat(' *', s_nationkey::INT) || chr(10)"


def _key() -> Column:
    return F.regexp_extract("path", r"s_suppkey=(\d+)/", 1).cast("long")


@register("scan_files", operators=("S1", "F1", "F9"), sql=f"""
SELECT s_suppkey, octet_length(encode({_CARD_SQL}))::BIGINT AS length, sha256({_CARD_SQL}) AS sha256, 's_suppkey=' || s_suppkey AS folder FROM supplier
""")
def q_scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder tree read recursively as binary files."""
    f = SF.read_files(spark, write_cards(spark, sf_dir, _CARD, "cards"), recursive=True, glob="*.txt")
    return f.select(_key().alias("s_suppkey"), "length", F.sha2("content", 256).alias("sha256"), SF.parent_name("path").alias("folder"))


@register("scan_files_limited", operators=("P3", "S16"), sql=f"""
SELECT s_suppkey, octet_length(encode({_CARD_SQL}))::BIGINT AS length FROM supplier WHERE octet_length(encode({_CARD_SQL})) <= 40
""")
def q_scan_files_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size limit as an explicit parameter that binds."""
    f = SF.read_files(spark, write_cards(spark, sf_dir, _CARD, "cards"), recursive=True, max_size=40, glob="*.txt")
    return f.select(_key().alias("s_suppkey"), "length")


_SHARED = "concat('nation ', s_nationkey)"


@register("stream_scan", operators=("T1", "T2", "T3"), sql=f"""
WITH c AS (SELECT DISTINCT 'nation ' || s_nationkey || chr(10) AS t FROM supplier)
SELECT sha256(t) AS sha256, octet_length(encode(t))::BIGINT AS file_size, round({_hash_score('sha256(t)')}, 9) AS score,
       {_hash_score('sha256(t)')} > 0.98 AS is_malware, NULL::VARCHAR AS virus_family
FROM c
""")
def q_stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of few distinct contents arrive as files, some in each trigger; every content is scored once."""
    root = write_cards(spark, sf_dir, _SHARED, "stream-cards")
    run = scratch_table_path(spark, f"scan-stream-{uuid.uuid4().hex[:12]}")
    run_scan_stream(spark, root, f"{run}/verdicts", f"{run}/checkpoint", {0: normal(), 1: packed()}, glob="*.txt", require_pe=False)
    return verdicts(spark, f"{run}/verdicts").select("sha256", "file_size", F.round("score", 9).alias("score"), "is_malware", "virus_family")


@register("bounded_requests", operators=("T2", "T4"), sql=f"""
WITH r AS (SELECT event_type || ' ' || strftime(ts, '%Y-%m-%d') AS id, 'user/' || user_id AS p FROM events),
c AS (SELECT id, count(*) AS files, count_if(starts_with(p, 'user/1') OR starts_with(p, 'user/2')) AS inside,
             count_if((starts_with(p, 'user/1') OR starts_with(p, 'user/2')) AND {_hash_score('sha256(p)')} > 0.5) AS bad FROM r GROUP BY id)
SELECT 1 AS version, id, files <= 64 AS ok, files::BIGINT AS files, CASE WHEN files <= 64 THEN inside END::BIGINT AS scanned, CASE WHEN files <= 64 THEN bad END::BIGINT AS malware,
       CASE WHEN files > 64 THEN 'batch_too_large' END AS code, CASE WHEN files > 64 THEN files || ' files, at most 64' END AS message
FROM c
""")
def q_bounded_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a type and day are one request; more than 64 files are refused whole, the others scanned (the stand-in knows users 1.. and 2..)."""
    e = table(spark, sf_dir, "events").select(F.concat_ws(" ", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("id"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("file_path"))

    def scan(paths: DataFrame) -> DataFrame:
        known = paths.where(F.col("path").startswith("user/1") | F.col("path").startswith("user/2"))
        return known.select(F.col("path").alias("file_path"), F.sha2("path", 256).alias("sha256")).select("file_path", (normal() > 0.5).alias("is_malware"))
    return answer(e, scan, allowed_root="user").select("version", "id", "ok", "files", "scanned", "malware", F.col("error.code").alias("code"), F.col("error.message").alias("message"))


# ---------------------------------------------------------------------------
# sinks and stores, written and read back
# ---------------------------------------------------------------------------

def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result row a document: score out of the number of characters."""
    d = documents_as_files(spark, sf_dir).select("doc_id", "path", "length")
    score = (F.col("length") % 1000) / 1000.0
    return d.select(F.col("path").alias("file_path"), SF.base_name("path").alias("file_name"), F.col("length").alias("file_size"),
                    (score > 0.9).alias("is_malware"), F.when(score > 0.9, score).otherwise(1 - score).alias("confidence"),
                    F.struct(F.lit(3).alias("cluster_id"), F.concat(F.lit("fam_"), (F.col("doc_id") % 5).cast("string")).alias("family_name")).alias("malware_family"))


_RESULT_SQL = f"""
WITH {FILES_CTE},
r AS (SELECT doc_id, path, length, (length % 1000) / 1000.0::DOUBLE AS s FROM files)"""


@register("result_sinks", operators=("S10", "S11", "P12"), sql=_RESULT_SQL + """
SELECT path AS file_path, length AS file_size, s > 0.9 AS is_malware, round(CASE WHEN s > 0.9 THEN s ELSE 1 - s END, 6) AS confidence,
       'fam_' || (doc_id % 5) AS virus_family, s > 0.9 AS listed
FROM r
""")
def q_result_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON, flat CSV and the text list of malicious paths, joined back on the path."""
    at = scratch_table_path(spark, f"results-{uuid.uuid4().hex[:12]}")
    r = _results(spark, sf_dir)
    SK.write_results(r, at)
    SK.write_malicious_paths(r, f"{at}/malicious")
    nested = spark.read.schema(r.schema).json(f"{at}/json").select("file_path", virus_family().alias("virus_family"))
    flat = spark.read.option("header", "true").schema("file_path string, file_name string, file_size long, is_malware boolean, confidence double").csv(f"{at}/csv")
    listed = spark.read.text(f"{at}/malicious").select(F.col("value").alias("file_path"), F.lit(True).alias("listed"))
    return (flat.join(nested, "file_path").join(listed, "file_path", "left")
                .select("file_path", "file_size", "is_malware", F.round("confidence", 6).alias("confidence"), "virus_family", F.coalesce("listed", F.lit(False)).alias("listed")))


@register("cache_table", operators=("S13", "T3"), sql=f"""
WITH {FILES_CTE}
SELECT sha256(content) AS sha256, min(doc_id % 2)::INTEGER AS first_batch, count(*)::BIGINT AS copies FROM files GROUP BY 1
""")
def q_cache_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts appended in two batches (even ids, then odd): a known content keeps the batch that brought it."""
    at = scratch_table_path(spark, f"cache-{uuid.uuid4().hex[:12]}")
    d = documents_as_files(spark, sf_dir).select((F.col("doc_id") % 2).cast("int").alias("batch"), F.sha2("content", 256).alias("sha256"))
    for b in (0, 1):
        SK.append_cache(spark, d.where(F.col("batch") == b), at)
    copies = d.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"))
    return SK.read_cache(spark, at).join(copies, "sha256").select("sha256", F.col("batch").alias("first_batch"), "copies")


@register("family_store", operators=("S12", "S15", "A24", "J8"), sql="""
SELECT label::INTEGER AS cluster_id, count(*)::BIGINT AS n, 'Malware_Family_' || label || '_Size' || count(*) AS family_name, count(*)::BIGINT AS files, 64 AS width
FROM embeddings GROUP BY label
""")
def q_family_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family model and cluster outputs written, read back (lengths checked) and joined on their keys."""
    at = scratch_table_path(spark, f"families-{uuid.uuid4().hex[:12]}")
    e = table(spark, sf_dir, "embeddings")
    model, scaler = FM.family_fit(e, "embedding", "label")
    SK.write_family_model(model, scaler, at)
    SK.write_cluster_outputs(e.select(F.col("vec_id").alias("filename"), F.col("label").alias("cluster_id")), model, at)
    m = SK.load_family_model(spark, at).select("cluster_id", F.size("centroid").alias("width"))
    sizes = spark.read.schema("cluster_id int, n long").json(f"{at}/cluster_sizes")
    names = spark.read.schema("cluster_id int, family_name string").json(f"{at}/family_names")
    files = spark.read.schema("filename long, cluster_id int").json(f"{at}/file_clusters").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("files"))
    return m.join(sizes, "cluster_id").join(names, "cluster_id").join(files, "cluster_id").select("cluster_id", "n", "family_name", "files", "width")


@register("sample_store", operators=("S4", "S6", "S8", "J2"), sql=f"""
WITH {FILES_CTE}
SELECT path AS filename, CASE WHEN doc_id % 3 = 0 THEN 'benign' ELSE 'malicious' END AS label,
       CASE WHEN doc_id % 7 = 0 THEN 0 ELSE least(greatest(length - 8, 0), 2040) END::INTEGER AS orig_length,
       CASE WHEN doc_id % 7 = 0 THEN repeat('00', 2048) ELSE rpad(substr(hex(content), 17, 4080), 4096, '0') END AS bytes_hex, 1500 AS pe_width
FROM files
""")
def q_sample_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written (bytes, PE vector, length), metadata as one JSON map a file, read back; missing ones are zeros."""
    at = scratch_table_path(spark, f"samples-{uuid.uuid4().hex[:12]}")
    f = documents_as_files(spark, sf_dir).select("doc_id", "path", "length", "content")
    SK.write_samples(f.where("doc_id % 7 <> 0").select("path", "length", "content"), f"{at}/samples", max_file_size=2048)
    meta = f.select(F.to_json(F.create_map("path", F.when(F.col("doc_id") % 3 == 0, "benign").otherwise("malicious"))).alias("value"))
    meta.write.text(f"{at}/metadata")
    out = SF.read_samples(spark, f"{at}/samples", SF.read_metadata_json(spark, f"{at}/metadata", lines=True), 2048)
    return out.select("filename", "label", "orig_length", F.hex("byte_sequence").alias("bytes_hex"), F.size("pe_features").alias("pe_width"))


@register("feature_store", operators=("S9", "P11", "S17"), sql="""
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id::VARCHAR AS filename, label::INTEGER AS label, 64 AS width, round(sum(x), 4) AS total, (SELECT count(*) FROM embeddings)::BIGINT AS reported
FROM e GROUP BY vec_id, label
""")
def q_feature_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written as CSV columns and as Parquet, read back; the columns are ordered by number; with a JSON report."""
    at = scratch_table_path(spark, f"features-{uuid.uuid4().hex[:12]}")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("filename"), "label", F.col("embedding").alias("features"))
    SK.write_features(e, f"{at}/parquet")
    SK.write_features_csv(e, f"{at}/csv", dim=64)
    SK.write_report(e.agg(F.count(F.lit(1)).alias("reported")), f"{at}/report")
    back = SK.load_features_csv(spark, f"{at}/csv", 64).select("filename", "features")
    stored = spark.read.parquet(f"{at}/parquet").select("filename", "label")
    report = spark.read.schema("reported long").json(f"{at}/report")
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return stored.join(back, "filename").crossJoin(F.broadcast(report)).select(  # the report is one row
        "filename", F.col("label").cast("int").alias("label"), F.size("features").alias("width"), F.round(total, 4).alias("total"), "reported")
