"""Queries over ``embeddings`` (feature vectors + cluster labels) and ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexlens import config as C
from hexlens.catalog import register
from hexlens.functions.vectors import fit_dim, hash_slot, l2_norm, l2_normalize
from hexlens.operators import families as FM
from hexlens.plans.corpus import round6
from hexlens.plans.sqlparts import r6
from hexlens.sources.tables import table

EMB_UNNEST = """e AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings
)"""
SCALED = EMB_UNNEST + """,
sc AS (SELECT dim, avg(x) AS mu, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS s FROM e GROUP BY dim),
z AS (SELECT vec_id, label, dim, (x - mu) / s AS z FROM e JOIN sc USING (dim))"""
MODEL = SCALED + """,
c AS (SELECT label, dim, avg(z) AS cz FROM z GROUP BY label, dim),
d AS (SELECT z.vec_id, z.label, sqrt(sum((z.z - c.cz) * (z.z - c.cz))) AS dist
      FROM z JOIN c USING (label, dim) GROUP BY z.vec_id, z.label),
q AS (SELECT label, quantile_cont(dist, 0.9) AS q, count(*) AS n FROM d GROUP BY label),
model AS (SELECT label AS cluster_id, n, CASE WHEN q = 0 THEN 1.0 ELSE q END AS threshold,
                 'Malware_Family_' || label || '_Size' || n AS family_name FROM q)"""


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _model(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return FM.family_fit(e, "embedding", "label")


@register("scaler_fit", operators=("F15",), sql=f"""
WITH {EMB_UNNEST}
SELECT CAST(dim - 1 AS INTEGER) AS dim, {r6('avg(x)')} AS mean,
       {r6('CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END')} AS scale
FROM e GROUP BY dim
""")
def q_scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = FM.scaler_fit(_emb(spark, sf_dir), "embedding")
    out = s.select(F.posexplode(F.arrays_zip("mean", "scale")).alias("dim", "z")).select(
        F.col("dim").cast("int").alias("dim"), F.col("z.mean").alias("mean"), F.col("z.scale").alias("scale"))
    return round6(out, ["mean", "scale"])


@register("family_model", operators=("A27", "F15", "F14", "A26"), sql=f"""
WITH {MODEL},
cn AS (SELECT label AS cluster_id, sqrt(sum(cz * cz)) AS cnorm FROM c GROUP BY label)
SELECT CAST(cluster_id AS INTEGER) AS cluster_id, n::BIGINT AS n, {r6('threshold')} AS threshold, family_name,
       {r6('cnorm')} AS centroid_norm
FROM model JOIN cn USING (cluster_id)
""")
def q_family_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _model(spark, sf_dir)
    out = model.select("cluster_id", "n", "threshold", "family_name", l2_norm("centroid").alias("centroid_norm"))
    return round6(out, ["threshold", "centroid_norm"])


@register("nearest_centroid", operators=("J4", "F14", "F15"), sql=f"""
WITH {MODEL},
dd AS (SELECT z.vec_id, c.label AS cid, sqrt(sum((z.z - c.cz) * (z.z - c.cz))) AS dist
       FROM z JOIN c USING (dim) GROUP BY z.vec_id, c.label),
best AS (SELECT vec_id, arg_min(cid, dist) AS nearest_cluster_id, min(dist) AS distance FROM dd GROUP BY vec_id)
SELECT b.vec_id, CAST(b.nearest_cluster_id AS INTEGER) AS nearest_cluster_id, {r6('b.distance')} AS distance,
       CAST(CASE WHEN b.distance <= m.threshold THEN b.nearest_cluster_id END AS INTEGER) AS cluster_id,
       CASE WHEN b.distance <= m.threshold THEN m.family_name ELSE 'New_Unknown_Family' END AS family_name,
       NOT (b.distance <= m.threshold) AS is_new_family
FROM best b JOIN model m ON m.cluster_id = b.nearest_cluster_id
""")
def q_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    model, scaler = FM.family_fit(e, "embedding", "label")
    x = FM.scaler_apply(e.select("vec_id", "embedding"), "embedding", scaler, "x").select("vec_id", "x")
    out = FM.nearest_centroid(x, "x", model)
    out = out.select("vec_id", "nearest_cluster_id", "distance", "cluster_id", "family_name", "is_new_family")
    return round6(out, ["distance"])


@register("cluster_sizes", operators=("A24",), sql="""
SELECT CAST(label AS INTEGER) AS cluster_id, count(*)::BIGINT AS n FROM embeddings GROUP BY label
""")
def q_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FM.cluster_sizes(_emb(spark, sf_dir), "label")


@register("analyze_clusters", operators=("A25", "A26"), sql="""
SELECT CAST(label AS INTEGER) AS cluster_id, count(*)::BIGINT AS n,
       'Malware_Family_' || label || '_Size' || count(*) AS family_name
FROM embeddings GROUP BY label HAVING count(*) >= 50
""")
def q_analyze_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FM.analyze_clusters(_emb(spark, sf_dir), "label", min_family_size=50)


def _label_clusters(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.when(F.col("toxic") == 1, F.lit(-1)).otherwise(F.col("quality")).alias("cluster_id"))


@register("noise_ids", operators=("W7",), sql="""
WITH l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN -1 ELSE quality END AS cluster_id FROM labels),
mx AS (SELECT coalesce(max(cluster_id), -1) AS m FROM l WHERE cluster_id <> -1)
SELECT doc_id, cluster_id, CAST(CASE WHEN cluster_id = -1
         THEN (SELECT m FROM mx) + row_number() OVER (PARTITION BY cluster_id = -1 ORDER BY doc_id)
         ELSE cluster_id END AS INTEGER) AS family_id
FROM l
""")
def q_noise_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FM.noise_ids(_label_clusters(spark, sf_dir), "cluster_id", "doc_id").select("doc_id", "cluster_id", "family_id")


@register("first_n_per_class", operators=("W4",), sql=f"""
SELECT vec_id, label FROM (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings
) WHERE rn <= {C.FAST_DEV_PER_CLASS}
""")
def q_first_n_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FM.first_n_per_class(_emb(spark, sf_dir).select("vec_id", "label"), "label", "vec_id")


@register("intra_inter_distance", operators=("J5", "F14", "F15"), sql=f"""
WITH {SCALED},
samples AS (
  SELECT vec_id AS sid, label AS slabel FROM embeddings
  WHERE label <> -1 ORDER BY sha256(CAST(vec_id AS VARCHAR)), vec_id LIMIT 5
),
zs AS (SELECT sid, slabel, dim, z AS zs FROM samples JOIN z ON z.vec_id = samples.sid),
pairs AS (
  SELECT zs.sid, zs.slabel, z.vec_id, z.label, sqrt(sum((zs.zs - z.z) * (zs.zs - z.z))) AS dist
  FROM zs JOIN z USING (dim) WHERE z.vec_id <> zs.sid GROUP BY zs.sid, zs.slabel, z.vec_id, z.label
),
intra AS (SELECT sid, avg(dist) AS d FROM pairs WHERE label = slabel GROUP BY sid),
inter AS (
  SELECT sid, avg(dist) AS d FROM (
    SELECT sid, dist, row_number() OVER (PARTITION BY sid ORDER BY vec_id) AS rn FROM pairs WHERE label <> slabel
  ) WHERE rn <= 100 GROUP BY sid
)
SELECT s.sid AS vec_id, CAST(s.slabel AS INTEGER) AS cluster_id, {r6('intra.d')} AS intra_distance,
       {r6('inter.d')} AS inter_distance
FROM samples s LEFT JOIN intra USING (sid) LEFT JOIN inter USING (sid)
""")
def q_intra_inter_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    scaler = FM.scaler_fit(e, "embedding")
    x = FM.scaler_apply(e.select("vec_id", "label", "embedding"), "embedding", scaler, "x").select("vec_id", "label", "x")
    out = FM.intra_inter_distance(x, "vec_id", "x", "label").withColumn("cluster_id", F.col("cluster_id").cast("int"))
    return round6(out, ["intra_distance", "inter_distance"])


@register("fit_dim_status", operators=("P8", "A23"), sql=f"""
SELECT 'padded' AS status, count(*)::BIGINT AS n, {r6('sum(s)')} AS total
FROM (SELECT list_sum(CAST(embedding AS DOUBLE[])) AS s FROM embeddings WHERE len(embedding) < 1500)
""")
def q_fit_dim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, status = fit_dim("embedding", C.PE_FEATURE_VECTOR_DIM)
    e = _emb(spark, sf_dir).select(v.alias("v"), status.alias("status"))
    out = e.groupBy("status").agg(F.count(F.lit(1)).alias("n"),
                                  F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("total"))
    return round6(out, ["total"])


@register("hash_slot", operators=("F2",), sql="""
SELECT slot128, slot32, count(*)::BIGINT AS n FROM (
  SELECT ('0x' || substr(sha256(p_name), 63, 2))::INTEGER % 128 AS slot128,
         ('0x' || substr(sha256(p_name), 63, 2))::INTEGER % 32 AS slot32
  FROM part
) GROUP BY ALL
""")
def q_hash_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return (p.select(hash_slot("p_name", 128).alias("slot128"), hash_slot("p_name", 32).alias("slot32"))
             .groupBy("slot128", "slot32").agg(F.count(F.lit(1)).alias("n")))


@register("l2_normalize", operators=("F3",), sql=f"""
WITH {EMB_UNNEST},
nrm AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM e GROUP BY vec_id)
SELECT vec_id, {r6('norm')} AS norm,
       {r6('CASE WHEN norm > 0 THEN (SELECT sum(x) FROM e WHERE e.vec_id = nrm.vec_id) / norm ELSE 0 END')} AS unit_sum,
       {r6('CASE WHEN norm > 0 THEN 1.0 ELSE 0.0 END')} AS unit_norm
FROM nrm
""")
def q_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir).select("vec_id", "embedding", l2_normalize("embedding").alias("u"))
    out = e.select("vec_id", l2_norm("embedding").alias("norm"),
                   F.aggregate("u", F.lit(0.0), lambda a, x: a + x).alias("unit_sum"),
                   l2_norm("u").alias("unit_norm"))
    return round6(out, ["norm", "unit_sum", "unit_norm"])


@register("seeded_sample", operators=("W10",), sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
ORDER BY sha256(CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || '/' ||
                CAST(l_partkey AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) || ':42')
LIMIT {C.VIS_SAMPLE_SIZE}
""")
def q_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 20,000 rows without replacement, chosen by a seeded hash order
    (a bounded top-k: each task keeps 20,000 candidates)."""
    li = table(spark, sf_dir, "lineitem")
    key = F.sha2(F.concat(F.concat_ws("/", *[F.col(c).cast("string") for c in
                                             ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]),
                          F.lit(":42")), 256)
    # the key is a column first, so the top-k comparator compares values and
    # does not re-hash rows on every comparison
    keyed = li.select("l_orderkey", "l_linenumber", "l_partkey", key.alias("_k"))
    return keyed.orderBy("_k").limit(C.VIS_SAMPLE_SIZE).select("l_orderkey", "l_linenumber", "l_partkey")


@register("align_ragged", operators=("P9", "P8", "A23"), sql="""
WITH w AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS k,
                  list_sum(list_transform(string_split(text, ' '), lambda x: length(x))) AS s FROM conversations),
m AS (SELECT max(k) AS mx FROM w)
SELECT CASE WHEN k < mx THEN 'padded' WHEN k > mx THEN 'truncated' ELSE 'ok' END AS status,
       count(*)::BIGINT AS n, sum(s)::DOUBLE AS total, max(mx)::INTEGER AS width
FROM w, m GROUP BY ALL
""")
def q_align_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-length arrays of every conversation turn, padded to the longest turn."""
    from hexlens.functions.vectors import align_ragged
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.length(w).cast("double")).alias("v"))
    a, width = align_ragged(c, "v")
    return a.groupBy(F.col("aligned_status").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("aligned.values", F.lit(0.0), lambda s, x: s + x)).alias("total"),
        F.lit(width).cast("int").alias("width"))
