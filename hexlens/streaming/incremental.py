"""T5: update a boosted model from each new batch of stored samples (``foreachBatch``).

New sample files (feature rows) arrive in a folder; every micro-batch
continues training the last saved model for a few rounds (M4) and saves the
result under its epoch.  A restart goes on from the saved models, and a batch
that is replayed starts from the epoch before it and overwrites its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexlens.operators.boosting import BoostedModel, boost
from hexlens.session import table_exists
from hexlens.sources.files import resolve_label


def saved_epochs(spark: SparkSession, model_dir: str) -> list[int]:
    """Epochs with a whole saved model, ascending."""
    if not table_exists(spark, model_dir):
        return []
    root = spark._jvm.org.apache.hadoop.fs.Path(model_dir)
    names = [s.getPath().getName() for s in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    return sorted(int(n[6:]) for n in names if n.startswith("epoch-") and table_exists(spark, f"{model_dir}/{n}/_SUCCESS"))


def latest_model(spark: SparkSession, model_dir: str, before: int | None = None) -> BoostedModel | None:
    epochs = [e for e in saved_epochs(spark, model_dir) if before is None or e < before]
    return BoostedModel.load(spark, f"{model_dir}/epoch-{epochs[-1]}") if epochs else None


def sample_labels(rows: DataFrame) -> DataFrame:
    """The label of each sample from its file name, then the stored one."""
    if "filename" not in rows.columns:
        return rows
    stored = F.col("label").cast("int") if "label" in rows.columns else F.lit(None)
    return rows.withColumn("label", resolve_label("filename", stored).cast("double"))


def incremental_fit(spark: SparkSession, source_dir: str, schema, checkpoint_dir: str, model_dir: str,
                    model: BoostedModel | None = None, rounds: int = 2, features: str = "features",
                    max_files_per_trigger: int = 1, **kw) -> BoostedModel | None:
    """Consume every new sample file under ``source_dir`` (availableNow); returns the last model.

    ``model`` is where the first epoch starts from, if given.
    """
    def fit(batch: DataFrame, epoch: int) -> None:
        rows = sample_labels(batch)
        start = latest_model(spark, model_dir, epoch) or model
        if not rows.isEmpty():
            boost(rows, features=features, rounds=rounds, model=start, **kw).save(spark, f"{model_dir}/epoch-{epoch}")

    q = (spark.readStream.schema(schema).option("maxFilesPerTrigger", str(max_files_per_trigger)).option("maxFileAge", "36500d")
              .parquet(source_dir)
              .writeStream.foreachBatch(fit).option("checkpointLocation", checkpoint_dir)
              .trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_model(spark, model_dir) or model
