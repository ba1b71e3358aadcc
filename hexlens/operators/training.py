"""Distributed ML operators.

All fits are ``pyspark.ml`` estimators (distributed over executors); the
driver only holds model parameters.  Splits are hash buckets of the row key,
so the same rows land in the same split on every run and at every scale.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexlens import config as C


def hash_bucket(key, seed: int = C.DEFAULT_RANDOM_STATE, buckets: int = 100) -> Column:
    """Stable bucket in [0, buckets) from sha256(key || ':' || seed) (same in DuckDB)."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.sha2(F.concat(k.cast("string"), F.lit(f":{seed}")), 256)
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


SMALL_ROWS = 10


def split_60_20_20(df: DataFrame, key: str, seed: int = C.DEFAULT_RANDOM_STATE,
                   test_size: float = C.DEFAULT_TEST_SIZE, val_size: float = C.DEFAULT_VAL_SIZE) -> DataFrame:
    """M1: adds ``split`` in {train, val, test}: test 20 %, then val 25 % of the rest.

    Hash buckets give the shares per label approximately (stratification by
    construction: every label is bucketed the same way).  Of a table of at most
    SMALL_ROWS rows every split gets all rows, as in the reference.
    """
    if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return df.withColumn("split", F.explode(F.array(F.lit("train"), F.lit("val"), F.lit("test"))))
    b = hash_bucket(key, seed)
    t = int(round(test_size * 100))
    v = t + int(round(val_size * (100 - t)))
    return df.withColumn("split", F.when(b < t, "test").when(b < v, "val").otherwise("train"))


def assemble(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col)))


def train_gbt(train: DataFrame, label: str = "label", features: str = "features", weight: str | None = None,
              validation: str | None = None, max_iter: int = 50, max_depth: int = 6, step: float = 0.1,
              subsampling: float = 0.9, seed: int = C.DEFAULT_RANDOM_STATE):
    """M2: boosted trees with log-loss; optional sample weights and validation-based early stop."""
    gbt = GBTClassifier(labelCol=label, featuresCol=features, maxIter=max_iter, maxDepth=max_depth,
                        stepSize=step, subsamplingRate=subsampling, seed=seed,
                        featureSubsetStrategy="all", minInstancesPerNode=1)
    if weight:
        gbt = gbt.setWeightCol(weight)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return gbt.fit(train)


def positive_score(pred: DataFrame, out: str = "score") -> DataFrame:
    return pred.withColumn(out, vector_to_array(F.col("probability"))[1]).drop("rawPrediction", "probability", "prediction")


def expert_predict(df: DataFrame, route: str, experts: dict, features: str = "features") -> DataFrame:
    """M8: score each row with its route's expert; a missing expert scores 0.

    Two filtered ``transform``s plus a union: each expert only sees its rows.
    An expert is a fitted model with ``transform`` or ``predict``, or a column.
    """
    parts = []
    for r in (0, 1):
        rows = df.where(F.col(route) == r)
        model = experts.get(r)
        if model is None:
            parts.append(rows.withColumn("score", F.lit(0.0)))
        elif isinstance(model, Column):
            parts.append(rows.withColumn("score", model))
        elif hasattr(model, "predict_rows"):
            parts.append(model.predict_rows(rows))
        else:
            parts.append(positive_score(model.transform(rows)))
    return parts[0].unionByName(parts[1])


def train_experts(df: DataFrame, route: str, min_rows: int = 10, **kw) -> dict:
    """M7: one model per route label; a route with <= min_rows rows (or one class) gets none."""
    experts = {}
    for r in (0, 1):
        rows = df.where(F.col(route) == r)
        stats = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k")).first()
        if stats["n"] > min_rows and stats["k"] > 1:
            experts[r] = train_gbt(rows, **kw)
    return experts


def importance_table(model, names: list[str] | None = None) -> DataFrame:
    """M12/W5 input: gain-based importances (normalised to 1) as a (dim, importance) table."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray().tolist()
    rows = [(i, float(v), names[i] if names and i < len(names) else f"dim_{i}") for i, v in enumerate(imp)]
    return spark.createDataFrame(rows, "dim int, importance double, meaning string")


def top_k_importance(imp: DataFrame, k: int = C.EVAL_TOP_FEATURE_COUNT) -> DataFrame:
    """Top-k dimensions by importance (TakeOrderedAndProject; ties by dim)."""
    return imp.orderBy(F.desc("importance"), "dim").limit(k)


def k_schedule(n: int, start: int = C.FEATURE_GATING_K_START, step: int = C.FEATURE_GATING_K_STEP) -> list[int]:
    """K from start by step, always ending at n."""
    ks = list(range(start, n, step)) if start < n else []
    return ks + [n]


def scale_pca(df: DataFrame, vec: str, k: int) -> DataFrame:
    """Standardise with the engine's own scaler (F15, population std), then PCA to k dims."""
    from hexlens.operators.families import scaler_apply, scaler_fit
    scaled = scaler_apply(df, vec, scaler_fit(df, vec), "_s").withColumn("_z", array_to_vector(F.col("_s")))
    k = min(k, len(df.select(vec).first()[0]))
    pca = PCA(k=k, inputCol="_z", outputCol="pca").fit(scaled)
    return pca.transform(scaled).drop("_s", "_z")


def kmeans_clusters(df: DataFrame, features: str, k: int = C.KMEANS_N_CLUSTERS,
                    max_iter: int = C.KMEANS_MAX_ITER, seed: int = C.DEFAULT_RANDOM_STATE) -> DataFrame:
    """K-means cluster id per row; fewer distinct rows than k is an error."""
    n = df.limit(k).count()
    if n < k:
        raise ValueError(f"{n} rows for {k} clusters")
    km = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol=features, predictionCol="cluster_id")
    return km.fit(df).transform(df)


# ---------------------------------------------------------------------------
# M9 gating MLP, M10 cross-validated score, M11 sampled search, M13 feature gating
# ---------------------------------------------------------------------------

def train_gating_mlp(df: DataFrame, features: str = "vec", label: str = "route", hidden=(256, 128),
                     max_iter: int = 50, seed: int = C.DEFAULT_RANDOM_STATE):
    """M9: multilayer perceptron on routing labels (layers d, 256, 128, 2)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    d = len(df.select(features).first()[0])
    mlp = MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=[d, *hidden, 2],
                                         maxIter=max_iter, seed=seed)
    return mlp.fit(df.withColumn(label, F.col(label).cast("double")))


def fold_column(df: DataFrame, key: str, folds: int, seed: int = C.DEFAULT_RANDOM_STATE, out: str = "fold") -> DataFrame:
    """Stable fold id per row from the key hash (every label is spread the same way)."""
    return df.withColumn(out, F.pmod(hash_bucket(key, seed, 1 << 20), F.lit(folds)).cast("int"))


# scores of the positive class, as the reference reports them
_METRICS = {"roc_auc": ("binary", "areaUnderROC"), "accuracy": ("multi", "accuracy"), "f1": ("multi", "fMeasureByLabel"),
            "precision": ("multi", "precisionByLabel"), "recall": ("multi", "recallByLabel")}


def evaluator(metric: str, label: str = "label"):
    """The Spark evaluator of one of the reported metrics."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
    kind, name = _METRICS[metric]
    return (BinaryClassificationEvaluator(labelCol=label, metricName=name) if kind == "binary" else
            MulticlassClassificationEvaluator(labelCol=label, metricName=name, metricLabel=1.0))


def cv_score(df: DataFrame, key: str, estimator_params: dict | None = None, folds: int = 5,
             metric: str = "f1", features: str = "vec", label: str = "label") -> float:
    """Mean k-fold score of a GBT; fewer than two classes scores 0."""
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    if df.select(label).distinct().count() < 2:
        return 0.0
    gbt = GBTClassifier(labelCol=label, featuresCol=features, seed=C.DEFAULT_RANDOM_STATE,
                        **(estimator_params or {"maxIter": 20, "maxDepth": 4}))
    cv = CrossValidator(estimator=gbt, estimatorParamMaps=ParamGridBuilder().build(), evaluator=evaluator(metric, label),
                        foldCol="fold", parallelism=2)
    model = cv.fit(fold_column(df, key, folds))
    return float(model.avgMetrics[0])


def sample_params(trials: int, seed: int = C.DEFAULT_RANDOM_STATE) -> list[dict]:
    """Seeded random / log-uniform draws over the tuned ranges (GBT equivalents)."""
    import random
    rng = random.Random(seed)
    out = []
    for _ in range(trials):
        out.append({
            "maxDepth": rng.randint(3, 8),                                  # ~ num_leaves 16..512
            "stepSize": math.exp(rng.uniform(math.log(0.005), math.log(0.2))),
            "featureSubsetStrategy": str(round(rng.uniform(0.6, 1.0), 3)),
            "subsamplingRate": rng.uniform(0.6, 1.0),
            "minInstancesPerNode": rng.randint(10, 100),
            "minInfoGain": rng.uniform(0.0, 0.2),
            "maxIter": 20,
        })
    return out


TUNE_METRICS = ("f1", "precision", "recall", "accuracy", "roc_auc")


def gbt_as_fit(p: dict) -> dict:
    """Parameters of ``GBTClassifier`` as those of a ``trees.Fit``.

    Spark's margin is 2 F, which starts at 0.  Its first tree takes the labels -1
    and 1, that is 2 (y - 1/2), at rate 1, the later ones 4 (y - p) at
    ``stepSize``; the least gain is of the variances of those.
    """
    step, gain = p.get("stepSize", 0.1), p.get("minInfoGain", 0.0)
    depth, columns = p.get("maxDepth", 5), p.get("featureSubsetStrategy", "all")
    return {"regression": True, "margin": 0.0, "rate": 8 * step, "min_gain": gain / 16, "first": (4.0, gain / 4), "rounds": p.get("maxIter", 20), "depth": depth,
            "leaves": 1 << depth, "min_data": p.get("minInstancesPerNode", 1), "feature_fraction": 1.0 if columns == "all" else float(columns),
            "bagging_fraction": p.get("subsamplingRate", 1.0), "bagging_freq": 1}


def tune(df: DataFrame, key: str, trials: int = 50, folds: int = 5, metric: str = "f1", features: str = "vec", label: str = "label") -> DataFrame:
    """One row per trial with the cross-validated ``metric``; baseline and best trial with all metrics.

    The baseline and the sampled parameters times the folds are fits of boosted
    trees by variance, level by level, on 32 bins as Spark's own, that share one
    binned table (``trees.cross_validate``): Spark's own estimator bins and passes over
    the rows anew for each of them.  The share of features is drawn for a tree, not
    for a node.
    """
    from hexlens.operators import trees as T
    from hexlens.operators.boosting import TREE_BINS, TREE_SAMPLE
    spark = df.sparkSession
    data = fold_column(df, key, folds).select(key, "fold", F.col(label).cast("double").alias("_y"), vector_to_array(features).alias("_x"))
    names = ["baseline", *(f"trial_{k}" for k in range(trials))]
    sets = dict(zip(names, map(gbt_as_fit, [{"maxIter": 20, "maxDepth": 4}, *sample_params(trials)]), strict=True))
    got = {r.trial: r for r in T.cross_validate(data, key, "_x", sets, label="_y", most=TREE_BINS, sample=TREE_SAMPLE).collect()}  # a row a trial
    scores = lambda m: [float(got[t][m]) if t in got else 0.0 for t in names]
    first = scores(metric)
    best = max(range(1, len(names)), key=lambda k: first[k]) if trials else 0
    rows = [(t, metric, v, k == best) for k, (t, v) in enumerate(zip(names, first, strict=True))]
    for k in dict.fromkeys((0, best)):
        rows += [(names[k], m, scores(m)[k], k == best) for m in TUNE_METRICS if m != metric]
    return spark.createDataFrame(rows, "trial string, metric string, score double, best boolean")


def mask_indices(kind: str, dim: int, k: int | None = None, order: list[int] | None = None, stats: int = C.STAT_FEATURE_DIM,
                 seed: int = C.DEFAULT_RANDOM_STATE) -> list[int]:
    """P10: the dimensions that a mask keeps: ``top_k`` (of an importance order), ``random`` (seeded k),
    ``statistics`` (before the PE vector) or ``pe`` (the PE vector)."""
    import random
    if kind == "top_k":
        return list(order[:k])
    if kind == "random":
        return sorted(random.Random(seed).sample(range(dim), k))
    if kind in ("statistics", "pe"):
        return list(range(min(stats, dim))) if kind == "statistics" else list(range(min(stats, dim), dim))
    raise ValueError(kind)


def mask_columns(df: DataFrame, features: str, indices: list[int], out: str = "masked") -> DataFrame:
    """P10: adds the vector of the kept dimensions."""
    return VectorSlicer(inputCol=features, outputCol=out, indices=list(indices)).transform(df)


def feature_gating(df: DataFrame, importance_order: list[int], k_values: list[int], features: str = "vec",
                   label: str = "label", max_iter: int = 50, max_depth: int = 6) -> DataFrame:
    """Refit on the top-k dimensions for each k; accuracy on the test split."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    spark = df.sparkSession
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    rows = []
    for k in k_values:
        sub = mask_columns(df, features, mask_indices("top_k", 0, k, importance_order), "m").select(label, "split", "m")
        model = train_gbt(sub.where("split = 'train'"), label=label, features="m", max_iter=max_iter, max_depth=max_depth)
        acc = ev.evaluate(model.transform(sub.where("split = 'test'")))
        rows.append((k, float(acc)))
    return spark.createDataFrame(rows, "k int, accuracy double")


def calinski_harabasz(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Calinski-Harabasz index by grouped sums (one pass per level, no pairs).

    B = sum_c n_c ||mu_c - mu||^2, W = sum_x ||x - mu_c||^2 = sum_c (S2_c - n_c ||mu_c||^2).
    """
    from pyspark.ml.stat import Summarizer
    v = df.select(F.col(cluster).alias("c"), array_to_vector(F.col(vec)).alias("v"),
                  F.aggregate(F.col(vec), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("sq"))
    per = v.groupBy("c").agg(Summarizer.mean(F.col("v")).alias("mu"), F.count(F.lit(1)).alias("n"),
                             F.sum("sq").alias("s2"))
    per = per.select("c", "n", "s2", vector_to_array("mu").alias("mu"))
    glob = per.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"))
    # global mean = weighted mean of cluster means (k rows: small)
    mu_all = per.select(F.posexplode("mu").alias("i", "m"), "n").groupBy("i").agg(
        (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("g"))
    b = (per.select("c", "n", F.posexplode("mu").alias("i", "m")).join(F.broadcast(mu_all), "i")
            .groupBy("c", "n").agg(F.sum((F.col("m") - F.col("g")) ** 2).alias("d2"))
            .agg(F.sum(F.col("n") * F.col("d2")).alias("B")))
    w = per.select((F.col("s2") - F.col("n") * F.aggregate("mu", F.lit(0.0), lambda a, x: a + x * x)).alias("w")) \
           .agg(F.sum("w").alias("W"))
    return glob.crossJoin(b).crossJoin(w).select(
        "N", "k", F.when((F.col("k") > 1) & (F.col("W") > 0),
                         (F.col("B") / (F.col("k") - 1)) / (F.col("W") / (F.col("N") - F.col("k"))))
        .otherwise(F.lit(0.0)).alias("calinski_harabasz"))
