"""Sinks (S7, S9-S13, S15, S17): partitioned, append-safe writes of DataFrames.

Every writer is a plain DataFrame write (executors write their partitions);
nothing is gathered on the driver.  Paths are caller-supplied (use shared
storage on a cluster, e.g. under ``spark.checkpoint.dir``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexlens.session import materialize, table_exists

RESULT_CSV_COLUMNS = ["file_path", "file_name", "file_size", "is_malware", "confidence"]


def write_features(df: DataFrame, path: str, partition_by: str | None = "label") -> None:
    """Feature table as Parquet ``(filename, label, features array<float>)``."""
    w = df.write.mode("overwrite")
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def write_samples(files: DataFrame, path: str, max_file_size: int | None = None) -> None:
    """``filename, byte_sequence, pe_features, orig_length, error`` of every file (path, length, content)."""
    from hexlens.operators.byte_stats import byte_window
    from hexlens.operators.featurise import featurise
    f = featurise(files, "path", max_file_size=max_file_size).select(F.col("path").alias("filename"), F.col("pe_vector").alias("pe_features"), "error")
    w = byte_window(files.select(F.col("path").alias("filename"), "content"), "content", max_file_size)
    w.select("filename", F.col("window").alias("byte_sequence"), "orig_length").join(f, "filename").write.mode("overwrite").parquet(path)


def write_features_csv(df: DataFrame, path: str, dim: int) -> None:
    """The feature table as CSV with one column a dimension."""
    features_as_columns(df, dim=dim).write.mode("overwrite").option("header", "true").csv(path)


def load_features_csv(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """CSV columns ``feature_*`` back as one array, in the order of their numbers."""
    schema = "filename string, label double, " + ", ".join(f"feature_{i} double" for i in range(dim))
    df = spark.read.option("header", "true").schema(schema).csv(path)
    return df.select("filename", "label", F.array(*feature_columns(df)).alias("features"))


def features_as_columns(df: DataFrame, features: str = "features", dim: int | None = None) -> DataFrame:
    """S9 CSV form: ``features[i]`` projected to ``feature_i`` columns."""
    n = dim if dim is not None else len(df.select(features).first()[0])
    return df.select(*[c for c in df.columns if c != features],
                     *[F.col(features)[i].alias(f"feature_{i}") for i in range(n)])


def feature_columns(df: DataFrame) -> list[str]:
    """``feature_*`` columns ordered by their numeric suffix."""
    cols = [c for c in df.columns if c.startswith("feature_") and c[8:].isdigit()]
    return sorted(cols, key=lambda c: int(c[8:]))


def write_results(df: DataFrame, path: str) -> None:
    """Nested JSON results plus a flat 5-column CSV (family dropped)."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.select(*RESULT_CSV_COLUMNS).write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def write_malicious_paths(df: DataFrame, path: str) -> None:
    """Text list of malicious paths."""
    df.where(F.col("is_malware")).select("file_path").write.mode("overwrite").text(path)


def write_cluster_outputs(assign: DataFrame, families: DataFrame, path: str) -> None:
    """File->cluster, cluster->count, cluster->name."""
    assign.select("filename", "cluster_id").write.mode("overwrite").json(f"{path}/file_clusters")
    assign.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path}/cluster_sizes")
    families.select("cluster_id", "family_name").write.mode("overwrite").json(f"{path}/family_names")


#: Hex digits of the key that name the folder of a cached verdict.
CACHE_DIGITS = 2


def _cache_folder(key: str) -> Column:
    return F.concat(F.lit("k"), F.substring(key, 1, CACHE_DIGITS)).alias("prefix")  # never read as a number


def read_cache(spark: SparkSession, path: str, keys: DataFrame | None = None, key: str = "sha256") -> DataFrame:
    """Cached verdicts; given keys, only the folders that may hold them are read (16 ** CACHE_DIGITS at most)."""
    t = spark.read.parquet(path)
    if keys is not None and "prefix" in t.columns:
        t = t.where(F.col("prefix").isin([r[0] for r in keys.select(_cache_folder(key)).distinct().collect()]))
    return t.drop("prefix")


def append_cache(spark: SparkSession, verdicts: DataFrame, path: str, key: str = "sha256") -> int:
    """Append only verdicts whose key is not yet in the cache table; returns rows added.

    The table is kept by the first digits of the key, so that a batch reads the
    folders of its own keys.  A table that can't be read is an error, not a
    first write.
    """
    new = verdicts.dropDuplicates([key])
    if table_exists(spark, path):
        new = materialize(new, "cache-candidates")
        new = new.join(read_cache(spark, path, new, key).select(key), key, "left_anti")
    new = materialize(new, "cache-append")  # what is counted is what is written
    n = new.count()
    if n:
        new.withColumn("prefix", _cache_folder(key)).write.mode("append").partitionBy("prefix").parquet(path)
    return n


def write_family_model(model: DataFrame, scaler: DataFrame, path: str) -> None:
    """Family model as Parquet, and as JSON lines in order of the cluster id (one family a line)."""
    model.write.mode("overwrite").parquet(f"{path}/model")
    scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    (model.select("cluster_id", "centroid", "threshold", "family_name").orderBy("cluster_id")
          .write.mode("overwrite").json(f"{path}/json"))


def load_family_model(spark: SparkSession, path: str) -> DataFrame:
    """S15 load with validation: a model whose centroids differ in length, or from the scaler, is rejected."""
    m = spark.read.parquet(f"{path}/model")
    dims = {r[0] for r in m.select(F.size("centroid")).distinct().limit(2).collect()}
    dims |= {r[0] for r in spark.read.parquet(f"{path}/scaler").select(F.size("mean")).distinct().limit(2).collect()}
    if len(dims) != 1:
        raise ValueError(f"family model at {path}: vectors of lengths {sorted(dims)}")
    return m


def write_report(df: DataFrame, path: str) -> None:
    """A (one-row) report DataFrame as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)
