"""Model store (S14): experts of a routed system, saved and loaded by route."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from hexlens.operators.boosting import BoostedModel
from hexlens.session import table_exists


def save_experts(spark: SparkSession, experts: dict, path: str) -> None:
    """Each route's model under ``path``: a boosted one as its stages, a Spark ML one as a pipeline."""
    for route, model in experts.items():
        if isinstance(model, BoostedModel):
            model.save(spark, f"{path}/route={route}/boosted")
        else:
            PipelineModel(stages=[model]).write().overwrite().save(f"{path}/route={route}/pipeline")


def load_experts(spark: SparkSession, path: str, routes=(0, 1)) -> dict:
    """The saved experts; a route without a model is missing, as for a fit on too few rows."""
    out = {}
    for route in routes:
        at = f"{path}/route={route}"
        if table_exists(spark, f"{at}/boosted"):
            out[route] = BoostedModel.load(spark, f"{at}/boosted")
        elif table_exists(spark, f"{at}/pipeline"):
            out[route] = PipelineModel.load(f"{at}/pipeline").stages[0]
    return out
