"""Families: scaler, family model fit, nearest centroid, cluster bookkeeping.

(F15, A24-A27, J4, J5, W7.)  Heavy work is grouped aggregation with map-side
combine; the family model is a small parameter table (k rows) whose size is
checked before it is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexlens import config as C
from hexlens.functions.vectors import l2_distance, standardise
from hexlens.operators.ranking import group_quantile, rank_within_group
from hexlens.session import materialize

# model parameters above this size are not broadcast in one piece
BROADCAST_MODEL_BYTES = 256 * 1024 * 1024
BROADCAST_META_ROWS = 1_000_000


# ---------------------------------------------------------------------------
# F15 scaler
# ---------------------------------------------------------------------------

def scaler_fit(df: DataFrame, vec: str) -> DataFrame:
    """One row ``(mean array<double>, scale array<double>)``: population std, 0 -> 1.

    Summarizer is a tree aggregate of dense buffers (no explode, no shuffle of
    rows); the result has d values - a bound fixed by the schema.
    """
    m = df.select(array_to_vector(F.col(vec)).alias("_v")).agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s"))
    n = F.col("s.count").cast("double")
    mean = vector_to_array(F.col("s.mean"), "float64")
    var_pop = F.transform(vector_to_array(F.col("s.variance"), "float64"),
                          lambda v: F.when(n > 1, v * (n - 1) / n).otherwise(F.lit(0.0)))
    scale = F.transform(var_pop, lambda v: F.when(F.sqrt(v) == 0, F.lit(1.0)).otherwise(F.sqrt(v)))
    return m.select(mean.alias("mean"), scale.alias("scale"))


def scaler_apply(df: DataFrame, vec: str, scaler: DataFrame, out: str) -> DataFrame:
    """Standardise ``vec`` with a one-row scaler (broadcast: exactly one row)."""
    return (df.crossJoin(F.broadcast(scaler.select(F.col("mean").alias("_sm"), F.col("scale").alias("_ss"))))
              .withColumn(out, standardise(vec, "_sm", "_ss")).drop("_sm", "_ss"))


# ---------------------------------------------------------------------------
# A27 family model fit
# ---------------------------------------------------------------------------

def family_fit(df: DataFrame, vec: str, cluster: str, names: DataFrame | None = None,
               percentile: float = C.FAMILY_THRESHOLD_PERCENTILE,
               multiplier: float = C.FAMILY_THRESHOLD_MULTIPLIER) -> tuple[DataFrame, DataFrame]:
    """Fit ``(family_model, scaler)``.

    family_model: ``cluster_id int, centroid array<double>, threshold double,
    family_name string, n bigint`` - centroid = mean of scaled rows, threshold =
    exact q-th percentile of member distances x multiplier (1.0 when 0).
    Noise (-1) is excluded.
    """
    base = df.select(F.col(cluster).cast("int").alias("cluster_id"), F.col(vec).alias("_vec"))
    scaler = scaler_fit(base, "_vec")
    scaled = scaler_apply(base, "_vec", scaler, "_x").where(F.col("cluster_id") != -1)
    cents = materialize(scaled.groupBy("cluster_id")
                        .agg(Summarizer.mean(array_to_vector("_x")).alias("_c"), F.count(F.lit(1)).alias("n"))
                        .select("cluster_id", vector_to_array("_c", "float64").alias("centroid"), "n"), "family-centroids")
    # k centroids within the model bound go to the rows, so that no cluster's rows meet in one task
    k, d = cents.select(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    side = cents.select("cluster_id", "centroid")
    side = F.broadcast(side) if (k or 0) * (d or 0) * 8 <= BROADCAST_MODEL_BYTES else side
    dist = materialize(scaled.join(side, "cluster_id").select("cluster_id", l2_distance("_x", "centroid").alias("dist")), "family-distances")
    thr = group_quantile(dist, ["cluster_id"], "dist", percentile / 100.0, "_q")
    model = cents.join(thr, "cluster_id", "left").withColumn(
        "threshold", F.when(F.coalesce(F.col("_q"), F.lit(0.0)) * multiplier == 0, F.lit(1.0))
                      .otherwise(F.col("_q") * multiplier)).drop("_q")
    if names is not None:
        model = model.join(names.select(F.col("cluster_id").cast("int"), "family_name"), "cluster_id", "left")
    else:
        model = model.withColumn("family_name", F.format_string(C.FAMILY_NAME_FORMAT, "cluster_id", "n"))
    # both are small parameter tables reused by every consumer: write them once
    model = materialize(model.select("cluster_id", "centroid", "threshold", "family_name", "n"), "family-model")
    return model, materialize(scaler, "family-scaler")


# ---------------------------------------------------------------------------
# J4 nearest centroid
# ---------------------------------------------------------------------------

NEAREST_SCHEMA = T.StructType([
    T.StructField("nearest_cluster_id", T.IntegerType()),
    T.StructField("distance", T.DoubleType()),
])


def _nearest_udf(bc):
    """Arrow UDF: argmin Euclidean distance against a broadcast centroid block.

    ``bc`` is a Spark broadcast of ``(ids, centroids)``: executors fetch it
    once, the UDF closure only carries the handle.  Ties go to the smallest
    cluster id (ids are sorted ascending and argmin returns the first minimum).
    """

    @F.pandas_udf(NEAREST_SCHEMA)
    def nearest(x: pd.Series) -> pd.DataFrame:
        ids, cents = bc.value
        if len(x) == 0:
            return pd.DataFrame({"nearest_cluster_id": pd.Series([], dtype="int32"),
                                 "distance": pd.Series([], dtype="float64")})
        X = np.stack(x.to_numpy()).astype(np.float64)
        if X.shape[1] != cents.shape[1]:
            raise ValueError(f"dimension mismatch: rows {X.shape[1]} vs centroids {cents.shape[1]}")
        d2 = (X * X).sum(axis=1)[:, None] - 2.0 * X @ cents.T + (cents * cents).sum(axis=1)[None, :]
        j = np.argmin(d2, axis=1)
        # exact distance for the winner (the expansion above is only used to rank)
        best = np.sqrt(((X - cents[j]) ** 2).sum(axis=1))
        return pd.DataFrame({"nearest_cluster_id": ids[j].astype("int32"), "distance": best})

    return nearest


def nearest_centroid(df: DataFrame, x: str, model: DataFrame) -> DataFrame:
    """Assign every row to its nearest family; ``<= threshold`` is a known family.

    Adds ``nearest_cluster_id, distance, cluster_id (null when new),
    family_name ('New_Unknown_Family' when new), is_new_family``.  The rows
    stay where they are: the model goes to them in blocks of at most
    BROADCAST_MODEL_BYTES, and a running minimum keeps the best of the blocks
    seen (written to the shared folder between blocks, so that only one is in
    memory).  Ties go to the smallest cluster id.
    """
    spark = df.sparkSession
    meta = model.select("cluster_id", "threshold", "family_name")
    k, d = model.select(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    if not k:
        raise ValueError("empty family model")
    rows_per_block = max(1, BROADCAST_MODEL_BYTES // (8 * max(d, 1)))
    ordered = model.select("cluster_id", "centroid").orderBy("cluster_id")
    out = df
    for start in range(0, k, rows_per_block):
        block = ordered.offset(start).limit(rows_per_block).collect()  # at most BROADCAST_MODEL_BYTES
        ids = np.array([r[0] for r in block], dtype=np.int64)
        cents = np.array([r[1] for r in block], dtype=np.float64)
        nn = _nearest_udf(spark.sparkContext.broadcast((ids, cents)))(F.col(x))
        out = out.withColumn("_nn", nn)
        own = F.struct(F.col("_nn.distance").alias("distance"), F.col("_nn.nearest_cluster_id").alias("nearest_cluster_id"))
        out = out.withColumn("_best", F.least("_best", own) if start else own).drop("_nn")
        if start + rows_per_block < k:
            out = materialize(out, "nearest-centroid")
    out = out.select("*", "_best.nearest_cluster_id", "_best.distance").drop("_best")
    meta = meta.withColumnRenamed("cluster_id", "nearest_cluster_id")
    # k rows of (id, threshold, name): broadcast while k is within the model bound, else a plain join
    if k <= BROADCAST_META_ROWS:
        meta = F.broadcast(meta)
    out = out.join(meta, "nearest_cluster_id", "left")
    known = F.col("distance") <= F.col("threshold")
    return (out.withColumn("cluster_id", F.when(known, F.col("nearest_cluster_id")))
               .withColumn("family_name", F.when(known, F.col("family_name")).otherwise(F.lit(C.NEW_FAMILY_NAME)))
               .withColumn("is_new_family", ~known)
               .drop("threshold"))


def intra_inter_distance(df: DataFrame, key: str, x: str, cluster: str, samples: int = 5, others: int = 100) -> DataFrame:
    """Mean distance of sampled rows to all rows of their cluster, and to ``others`` rows of other clusters.

    Samples are the first rows by a hash of the key (stand-in for the seeded
    random choice), written once; every row meets ``samples`` rows at most.
    """
    chosen = materialize(df.where(F.col(cluster) != -1).orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(samples)
                           .select(F.col(key).alias("sid"), F.col(cluster).alias("slabel"), F.col(x).alias("sx")), "intra-inter-samples")
    pairs = (df.join(F.broadcast(chosen), F.col(key) != F.col("sid"))
               .select("sid", "slabel", key, cluster, l2_distance(x, "sx").alias("dist")))
    intra = pairs.where(F.col(cluster) == F.col("slabel")).groupBy("sid").agg(F.avg("dist").alias("intra_distance"))
    w = Window.partitionBy("sid").orderBy(key)
    inter = (pairs.where(F.col(cluster) != F.col("slabel")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= others)
                  .groupBy("sid").agg(F.avg("dist").alias("inter_distance")))
    return chosen.join(intra, "sid", "left").join(inter, "sid", "left").select(
        F.col("sid").alias(key), F.col("slabel").alias("cluster_id"), "intra_distance", "inter_distance")


# ---------------------------------------------------------------------------
# A24-A26, W7 cluster bookkeeping
# ---------------------------------------------------------------------------

def cluster_sizes(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return df.groupBy(F.col(cluster).alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))


def analyze_clusters(df: DataFrame, cluster: str = "cluster_id", min_family_size: int = 20,
                     treat_noise_as_family: bool = False) -> DataFrame:
    """A25 + A26: which clusters become families, and their names.

    A cluster (not -1) is a family when its size >= min_family_size, or when
    smaller but noise is treated as family; the noise group itself is a family
    only when treated as one and >= min_family_size.
    """
    s = cluster_sizes(df, cluster)
    is_noise = F.col("cluster_id") == -1
    keep = F.when(is_noise, F.lit(treat_noise_as_family) & (F.col("n") >= min_family_size)) \
            .otherwise((F.col("n") >= min_family_size) | F.lit(treat_noise_as_family))
    return (s.where(keep)
             .withColumn("family_name", F.format_string(C.FAMILY_NAME_FORMAT, "cluster_id", "n")))


def noise_ids(df: DataFrame, cluster: str, order_col: str, out: str = "family_id") -> DataFrame:
    """Every noise row (-1) gets its own id max_label + 1 + i, i by ``order_col``.

    Numbering uses the two-pass rank (no single-task window); the scalar max
    comes from a partial aggregate.
    """
    max_label = df.where(F.col(cluster) != -1).agg(F.coalesce(F.max(cluster), F.lit(-1)).alias("_mx"))
    noise = df.where(F.col(cluster) == -1).withColumn("_g", F.lit(0))
    ranked = rank_within_group(noise, ["_g"], [order_col], out="_i").drop("_g")
    ranked = ranked.crossJoin(F.broadcast(max_label)).withColumn(
        out, (F.col("_mx") + 1 + F.col("_i")).cast(df.schema[cluster].dataType)).drop("_mx", "_i")
    rest = df.where(F.col(cluster) != -1).withColumn(out, F.col(cluster))
    return rest.unionByName(ranked)


def first_n_per_class(df: DataFrame, label: str, order_col: str, n: int = C.FAST_DEV_PER_CLASS) -> DataFrame:
    """First n rows of each label in ``order_col`` order.

    Every task first keeps the first n rows of each label that it holds, so at
    most n rows a label and task go on; the two-pass rank then picks the first
    n of all without putting one label in one task.
    """
    keep = df.schema

    def head(batches):
        seen: dict = {}
        for pdf in batches:
            at = pdf.groupby(label, sort=False, dropna=False).cumcount() + pdf[label].map(lambda v: seen.get(v, 0))
            for v, c in pdf[label].value_counts(dropna=False).items():
                seen[v] = seen.get(v, 0) + int(c)
            yield pdf[at < n]

    local = df.sortWithinPartitions(label, order_col).mapInPandas(head, keep)
    ranked = rank_within_group(local, [label], [order_col], out="_rn")
    return ranked.where(F.col("_rn") < n).drop("_rn")
