"""Source, join and set-operation queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexlens import config as C
from hexlens.catalog import register
from hexlens.operators import joins as J
from hexlens.plans.metrics import SCORED_CTE, scored
from hexlens.sources import files as SF
from hexlens.sources.tables import documents_as_files, table

_FILES_SQL = """files AS (
  SELECT doc_id, source, lang, source || '/' || CAST(doc_id AS VARCHAR) || '.' || lang AS path,
         sha256(encode(text)) AS sha256, text
  FROM documents
)"""


@register("ext_filter", operators=("S2", "F9"), sql=f"""
WITH {_FILES_SQL}
SELECT doc_id, path, '.' || lang AS ext, source AS parent FROM files WHERE '.' || lower(lang) IN ('.en', '.de')
""")
def q_ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = documents_as_files(spark, sf_dir).select("doc_id", "path")
    out = SF.ext_filter(f, [".EN", ".de"])
    return out.select("doc_id", "path", SF.extension("path").alias("ext"), SF.parent_name("path").alias("parent"))


def _cache(spark, sf_dir):
    """Verdict cache stand-in: contents of labelled documents, verdict = toxic."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    f = documents_as_files(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("sha256"))
    c = f.join(lab, "doc_id").select("sha256", (F.col("toxic") == 1).alias("is_malware"), "doc_id")
    return c.groupBy("sha256").agg(F.min_by("is_malware", "doc_id").alias("is_malware"))


@register("cache_lookup", operators=("J1", "F1", "U3"), sql=f"""
WITH {_FILES_SQL},
cache AS (
  SELECT f.sha256, arg_min(l.toxic = 1, f.doc_id) AS is_malware FROM files f JOIN labels l USING (doc_id) GROUP BY f.sha256
)
SELECT f.doc_id, f.sha256, c.sha256 IS NOT NULL AS cache_hit, c.is_malware
FROM files f LEFT JOIN cache c USING (sha256)
""")
def q_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = documents_as_files(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("sha256"))
    return J.cache_lookup(f, _cache(spark, sf_dir)).select("doc_id", "sha256", "cache_hit", "is_malware")


@register("skip_existing", operators=("J9",), sql=f"""
WITH {_FILES_SQL},
stored AS (SELECT DISTINCT f.sha256 FROM files f JOIN labels l USING (doc_id))
SELECT doc_id, sha256 FROM files WHERE sha256 NOT IN (SELECT sha256 FROM stored)
""")
def q_skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = documents_as_files(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("sha256"))
    stored = f.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return J.skip_existing(f, stored).select("doc_id", "sha256")


@register("dedupe_content", operators=("U3", "F1"), sql=f"""
WITH {_FILES_SQL}
SELECT sha256, min(path) AS path, count(*)::BIGINT AS copies FROM files GROUP BY sha256
""")
def q_dedupe_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = documents_as_files(spark, sf_dir).select("path", F.sha2("content", 256).alias("sha256"))
    return J.dedupe_content(f, "sha256", "path", copies="copies")


@register("label_join", operators=("J2", "P7", "P6"), sql=f"""
WITH {_FILES_SQL}
SELECT f.doc_id, f.path,
       CASE WHEN regexp_matches(lower(f.path), 'whitelist|benign|good|clean') THEN 0
            WHEN regexp_matches(lower(f.path), 'malicious|virus|trojan') THEN 1
            WHEN l.toxic = 0 THEN 0 WHEN l.toxic = 1 THEN 1 ELSE 1 END AS label,
       CASE WHEN regexp_matches(lower(regexp_extract(f.path, '[^/]+$')), 'benign|good|clean') THEN 0 ELSE 1 END AS inferred
FROM files f JOIN labels l USING (doc_id)
""")
def q_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = documents_as_files(spark, sf_dir).select("doc_id", "path")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = f.join(lab, "doc_id")
    return j.select("doc_id", "path", SF.resolve_label("path", "toxic").alias("label"),
                    SF.infer_label("path").alias("inferred"))


@register("fp_weight", operators=("J3", "A30"), sql=f"""
WITH {SCORED_CTE},
fp AS (SELECT DISTINCT path FROM scored WHERE label = 0 AND score > 0.98)
SELECT s.path, CASE WHEN fp.path IS NOT NULL THEN 11.0 ELSE 1.0 END AS weight
FROM scored s LEFT JOIN fp USING (path)
""")
def q_fp_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    fps = s.where((F.col("label") == 0) & (F.col("score") > C.PREDICTION_THRESHOLD)).select("path")
    return J.fp_weight(s.select("path"), fps, "path", iteration=2)


def _hits_sql(col: str, kws: list[str]) -> str:
    return " + ".join(f"CASE WHEN contains(lower({col}), '{k}') THEN 1 ELSE 0 END" for k in kws)


_CATS = {"network": C.API_CATEGORY_NETWORK, "process": C.API_CATEGORY_PROCESS,
         "filesystem": C.API_CATEGORY_FILESYSTEM, "registry": C.API_CATEGORY_REGISTRY}


@register("keyword_hits", operators=("J6", "A14"), sql="SELECT page_id, " + ", ".join(
    f"CAST({_hits_sql('url', kws)} AS INTEGER) AS url_{cat}, CAST({_hits_sql('html', kws)} AS INTEGER) AS html_{cat}"
    for cat, kws in _CATS.items()) + ", CAST(" + _hits_sql('html', C.PACKER_SECTION_KEYWORDS) + " AS INTEGER) AS html_packer FROM pages")
def q_keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    cols = []
    for cat, kws in _CATS.items():
        cols += [J.keyword_hits("url", kws).cast("int").alias(f"url_{cat}"),
                 J.keyword_hits("html", kws).cast("int").alias(f"html_{cat}")]
    cols.append(J.keyword_hits("html", C.PACKER_SECTION_KEYWORDS).cast("int").alias("html_packer"))
    return p.select("page_id", *cols)


@register("union_sources", operators=("U1", "U2", "A22"), sql=f"""
WITH {SCORED_CTE},
benign AS (SELECT path, label FROM scored WHERE label = 0),
malicious AS (SELECT path, label FROM scored WHERE label = 1),
hard AS (SELECT path, label FROM scored WHERE label = 0 AND score > 0.98),
train AS (SELECT * FROM benign UNION ALL SELECT * FROM malicious UNION ALL SELECT * FROM hard)
SELECT label, count(*)::BIGINT AS n, count(DISTINCT path)::BIGINT AS distinct_files FROM train GROUP BY label
""")
def q_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).select("path", "label", "score")
    benign = s.where("label = 0").select("path", "label")
    malicious = s.where("label = 1").select("path", "label")
    hard = s.where((F.col("label") == 0) & (F.col("score") > C.PREDICTION_THRESHOLD)).select("path", "label")
    train = benign.unionByName(malicious).unionByName(hard)  # UNION ALL: hard negatives repeat
    return train.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("distinct_files"))


@register("merge_maps", operators=("U5",), sql="""
WITH older AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'benign' ELSE 'malicious' END AS label FROM labels),
newer AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'malicious' ELSE 'benign' END AS label FROM labels WHERE toxic = 1),
u AS (SELECT doc_id, label, 0 AS v FROM older UNION ALL SELECT doc_id, label, 1 AS v FROM newer)
SELECT doc_id, arg_max(label, v) AS label FROM u GROUP BY doc_id
""")
def q_merge_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    older = lab.select("doc_id", F.when(F.col("quality") == 1, "benign").otherwise("malicious").alias("label"))
    newer = lab.where("toxic = 1").select("doc_id", F.lit("malicious").alias("label"))
    return J.merge_maps(older, newer, "doc_id", "label")


@register("model_key_intersect", operators=("J8", "U4"), sql="""
WITH cent AS (SELECT DISTINCT label AS cluster_id FROM embeddings),
thr AS (SELECT label AS cluster_id FROM embeddings GROUP BY label HAVING count(*) >= 2),
names AS (SELECT label AS cluster_id FROM embeddings GROUP BY label HAVING count(*) >= 50)
SELECT CAST(cluster_id AS INTEGER) AS cluster_id FROM cent JOIN thr USING (cluster_id) JOIN names USING (cluster_id)
""")
def q_model_key_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster_id"))
    sizes = e.groupBy("cluster_id").count()
    return J.key_intersect(e, sizes.where("count >= 2"), sizes.where("count >= 50"), key="cluster_id")


@register("request_envelope", operators=("T4",), sql="""
SELECT event_id, 1 AS version, CAST(event_id AS VARCHAR) AS id, event_type <> 'error' AS ok,
       CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
       CASE WHEN event_type = 'error' THEN 'SCAN_FAILED' END AS error_code
FROM events
""")
def q_request_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (events) -> response envelopes: ok payload or error code."""
    ev = table(spark, sf_dir, "events")
    props = F.from_json("props", "k int")
    ok = F.col("event_type") != "error"
    return ev.select("event_id", F.lit(1).alias("version"), F.col("event_id").cast("string").alias("id"),
                     ok.alias("ok"), F.when(ok, props["k"]).alias("k"),
                     F.when(~ok, F.lit("SCAN_FAILED")).alias("error_code"))


@register("path_guard", operators=("P1", "F9"), sql=f"""
WITH {_FILES_SQL}
SELECT doc_id, path, regexp_extract(path, '[^/]+$') AS name, source AS parent
FROM files WHERE length(path) > 0 AND strpos(path, chr(0)) = 0
  AND (path = 'src1' OR starts_with(path, 'src1/'))
""")
def q_path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files inside the allowed root ``src1`` (equal, or prefix plus separator; src10 is outside)."""
    f = documents_as_files(spark, sf_dir).select("doc_id", "path")
    return f.where(SF.path_guard("path", "src1")).select(
        "doc_id", "path", SF.base_name("path").alias("name"), SF.parent_name("path").alias("parent"))
