"""Families of malicious rows, from features to a family model and its outputs."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexlens import config as C
from hexlens.operators import families as FM
from hexlens.operators import training as TR
from hexlens.session import materialize
from hexlens.sources.sinks import write_cluster_outputs, write_family_model


def cluster_quality(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Calinski-Harabasz, and the silhouette with squared Euclidean distances, which needs no pairs.

    Both are 0 for a single cluster; noise rows (-1) must have been given ids.
    """
    ch = TR.calinski_harabasz(df, vec, cluster)
    if df.select(cluster).distinct().limit(2).count() < 2:
        return ch.withColumn("silhouette", F.lit(0.0))
    rows = df.select(array_to_vector(F.col(vec)).alias("features"), F.col(cluster).cast("int").alias("prediction"))
    return ch.withColumn("silhouette", F.lit(float(ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(rows))))


def discover_families(df: DataFrame, vec: str, key: str = "filename", k: int = C.KMEANS_N_CLUSTERS, pca: int = C.PCA_DIMENSION_FOR_CLUSTERING,
                      min_family_size: int = 20, treat_noise_as_family: bool = True, out: str | None = None) -> dict[str, DataFrame]:
    """F15, M14, M15, W7, A24-A27 in one chain over malicious rows (``key``, ``vec``).

    k-means at every size.  Rows of noise (a cluster id of -1, from another
    clustering) become clusters of their own.  Returns clusters, sizes,
    families, model, scaler and quality; ``out``: also written there (S12, S15).
    """
    reduced = TR.scale_pca(df.select(key, vec), vec, pca)
    clusters = TR.kmeans_clusters(reduced, "pca", k=k).select(key, vec, "cluster_id")
    if clusters.where("cluster_id = -1").limit(1).count():
        clusters = FM.noise_ids(clusters, "cluster_id", key, out="_id").drop("cluster_id").withColumnRenamed("_id", "cluster_id")
    clusters = materialize(clusters, "discovered-clusters")
    sizes = FM.cluster_sizes(clusters)
    families = FM.analyze_clusters(clusters, min_family_size=min_family_size, treat_noise_as_family=treat_noise_as_family)
    model, scaler = FM.family_fit(clusters, vec, "cluster_id")
    if out:
        write_cluster_outputs(clusters.select(F.col(key).alias("filename"), "cluster_id"), families, f"{out}/clusters")
        write_family_model(model, scaler, f"{out}/families")
    return {"clusters": clusters, "sizes": sizes, "families": families, "model": model, "scaler": scaler,
            "quality": cluster_quality(clusters, vec, "cluster_id")}
