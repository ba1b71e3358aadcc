"""C4: from labelled features to experts and families in one resumable chain.

Every stage writes one artefact, whose folder is named by the hash of the stage's
parameters and of the artefacts it was made from, and notes it in a manifest on
the same shared storage when it is whole.  A run that was ended goes on after the
last whole stage; a parameter that changes makes that stage and those after it
anew, beside the old ones.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexlens import config as C
from hexlens.operators import trees as T
from hexlens.operators.boosting import BoostedModel
from hexlens.operators.discovery import discover_families
from hexlens.session import table_exists
from hexlens.sources import sinks as SK
from hexlens.sources.models import load_experts, save_experts


class Chain:
    """Stages under ``folder``; ``ran`` lists those that this run made."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.ran = spark, folder.rstrip("/"), []
        self.made: dict[str, str] = {}

    def stage(self, name: str, params: dict, after: tuple[str, ...], make: Callable[[str], None]) -> str:
        """The stage's artefact; made now unless the manifest has it."""
        told = json.dumps([name, params, [self.made[a] for a in after]], sort_keys=True, default=str)
        key = f"{name}-{hashlib.sha256(told.encode()).hexdigest()[:16]}"
        at, note = f"{self.folder}/{key}", f"{self.folder}/manifest/{key}"
        if not table_exists(self.spark, note):
            make(at)
            self.ran.append(name)
            # a folder that Spark commits is whole or not there
            self.spark.createDataFrame([(name, key, told)], "stage string, artefact string, made_from string").coalesce(1).write.mode("overwrite").json(note)
        self.made[name] = key
        return at

    def manifest(self) -> DataFrame:
        return self.spark.read.schema("stage string, artefact string, made_from string").json(f"{self.folder}/manifest/*")


def train_all(spark: SparkSession, rows: DataFrame, folder: str, inputs: str, key: str = "doc_id", features: str = "row", label: str = "label",
              route: str = "route", trials: int = 50, folds: int = 5, rounds: int = C.DEFAULT_INCREMENTAL_ROUNDS, metric: str = "f1",
              k: int = C.KMEANS_N_CLUSTERS, pca: int = 20, min_family_size: int = 20, least_rows: int = 10, stop: Callable[[str], None] | None = None) -> Chain:
    """Features, first model, tuning, refit, an expert a route, families; returns the chain.

    ``rows``: key, features (array), label, route and split (train, val, test);
    test rows teach nothing.  ``inputs`` names their content: another name, another
    run.  A route with ``least_rows`` rows at most, or one class, gets no expert;
    without malicious rows there are no families.  ``stop`` is called with each
    stage's name after it is whole.
    """
    chain = Chain(spark, folder)
    stop = stop or (lambda name: None)

    def done(name: str, params: dict, after: tuple[str, ...], make) -> str:
        at = chain.stage(name, params, after, make)
        stop(name)
        return at

    role = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1)
    x = F.col(features).cast("array<float>").alias("x")
    at = done("features", {"inputs": inputs, "folds": folds}, (), lambda p: rows.select(
        F.col(key).alias("key"), x, F.col(label).cast("double").alias("label"), F.col(route).cast("int").alias("route"), "split",
        role.alias("role"), F.when(F.col("split") != "test", F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(folds))).cast("int").alias("fold")).write.mode("overwrite").parquet(p))
    table = spark.read.parquet(at)

    def fit(params: dict, where=None):
        def make(path: str) -> None:
            model, _, trainer = T.train(table if where is None else table.where(where), "key", "x", rounds=rounds, model_features="vec", **params)
            trainer.close()
            model.save(spark, path)
        return make

    done("first", {"rounds": rounds}, ("features",), fit({"warmup": C.WARMUP_ROUNDS}))
    tuned = done("tuned", {"trials": trials, "rounds": rounds, "metric": metric}, ("features",),
                 lambda p: T.tune(table, "key", "x", trials=trials, rounds=rounds, metric=metric).write.mode("overwrite").parquet(p))
    best = spark.read.parquet(tuned).where("best").first().trial if trials else "baseline"
    params = {} if best == "baseline" else T.draw(trials)[int(best.split("_")[1])]
    done("refit", {"params": params, "rounds": rounds}, ("features", "tuned"), fit(params))

    def experts(path: str) -> None:
        found = {}
        for r in (0, 1):
            n, classes = table.where((F.col("route") == r) & F.col("role").isNotNull()).agg(F.count(F.lit(1)), F.countDistinct("label")).first()
            if n > least_rows and classes > 1:
                found[r], _, trainer = T.train(table.where(F.col("route") == r), "key", "x", rounds=rounds, model_features="vec", **params)
                trainer.close()
        save_experts(spark, found, path)
    done("experts", {"params": params, "rounds": rounds, "least": least_rows}, ("features", "tuned"), experts)

    def families(path: str) -> None:
        bad = table.where("label = 1").select(F.col("key").cast("string").alias("filename"), F.col("x").cast("array<double>").alias("x"))
        n = bad.count()
        if n:
            discover_families(bad, "x", k=min(k, n), pca=pca, min_family_size=min_family_size, out=path)
    done("families", {"k": k, "pca": pca, "least": min_family_size}, ("features",), families)
    return chain


def trained(spark: SparkSession, chain: Chain) -> dict:
    """What a scan needs: experts by route, family_model and family_scaler (None without families)."""
    at = f"{chain.folder}/{chain.made['families']}/families"
    some = table_exists(spark, f"{at}/model")
    return {"experts": load_experts(spark, f"{chain.folder}/{chain.made['experts']}"),
            "family_model": SK.load_family_model(spark, at) if some else None,
            "family_scaler": spark.read.parquet(f"{at}/scaler") if some else None}


def saved_model(spark: SparkSession, chain: Chain, stage: str) -> BoostedModel | None:
    return BoostedModel.load(spark, f"{chain.folder}/{chain.made[stage]}")

