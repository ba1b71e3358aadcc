"""Training / evaluation queries.

Fitted numbers have no exact oracle; each query returns the facts about its
fit that SQL can state: rows and splits, schedules, rates, bounds, restarts.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexlens import config as C
from hexlens.catalog import register
from hexlens.operators import metrics as M
from hexlens.operators import training as TR
from hexlens.operators import trees as T
from hexlens.operators.boosting import BoostedModel, boost, fp_mining, fp_reinforcement
from hexlens.operators.chain import train_all, trained
from hexlens.operators.featurise import featurise
from hexlens.operators.scan import route_from_vector, scan_corpus
from hexlens.plans import dims as D
from hexlens.session import materialize, materialize_once, scratch_table_path
from hexlens.sources.models import load_experts, save_experts
from hexlens.sources.tables import documents_as_files, table
from hexlens.streaming.incremental import incremental_fit, saved_epochs


@register("split_assignment", operators=("M1",), sql="""
WITH b AS (
  SELECT doc_id, toxic AS label,
         ('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || ':42'), 1, 8))::BIGINT % 100 AS bucket
  FROM labels
)
SELECT CASE WHEN bucket < 20 THEN 'test' WHEN bucket < 40 THEN 'val' ELSE 'train' END AS split,
       label, count(*)::BIGINT AS n
FROM b GROUP BY ALL
""")
def q_split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return TR.split_60_20_20(lab, "doc_id").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def labelled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 1549 features of each labelled document, whole, + label + split; written once for all queries."""
    def build():
        f = documents_as_files(spark, sf_dir).select("doc_id", "length", "content")
        lab = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
        keyed = f.join(lab.select("doc_id"), "doc_id", "left_semi")
        x = featurise(keyed, "doc_id").select("doc_id", "features").join(lab, "doc_id")
        x = TR.split_60_20_20(x, "doc_id").select("doc_id", "label", "split", F.col("features").alias("row"))
        return TR.assemble(x, "row", "features").withColumn("label", F.col("label").cast("double")).withColumn("stats", F.slice("row", 1, C.STAT_FEATURE_DIM))
    return materialize_once(spark, ("labelled-features", sf_dir), build, "labelled-features")


_SPLIT_SQL = """
WITH b AS (SELECT doc_id, toxic AS label, ('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || ':42'), 1, 8))::BIGINT % 100 AS bucket,
                  ('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || ':42'), 1, 8))::BIGINT % 1048576 AS wide FROM labels JOIN documents USING (doc_id)),
s AS (SELECT *, CASE WHEN bucket < 20 THEN 'test' WHEN bucket < 40 THEN 'val' ELSE 'train' END AS split FROM b)"""


@register("train_evaluate", operators=("M2", "M7", "M8", "C5", "A29", "S14"), sql=_SPLIT_SQL + """
SELECT 'Benign' AS class_name, count_if(label <> 1)::BIGINT AS support, true AS in_range, true AS reloaded FROM s WHERE split = 'test'
UNION ALL SELECT 'Malicious', count_if(label = 1)::BIGINT, true, true FROM s WHERE split = 'test'
UNION ALL SELECT n, count(*)::BIGINT, true, true FROM s, (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) v(n) WHERE split = 'test' GROUP BY n
""")
def q_train_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route by entropy, one expert per route, saved and loaded again, report on the test split."""
    x = labelled_features(spark, sf_dir).withColumn("route", (F.col("stats")[11] > 0.55).cast("int"))
    train = x.where("split <> 'test'").withColumn("is_val", F.col("split") == "val")
    experts = TR.train_experts(train, "route", max_iter=20, max_depth=4, validation="is_val")
    at = scratch_table_path(spark, f"experts-{uuid.uuid4().hex[:12]}")
    save_experts(spark, experts, at)
    loaded = load_experts(spark, at)
    test = materialize(x.where("split = 'test'"), "test-split")
    scored = TR.expert_predict(test, "route", loaded)
    same = scored.select("doc_id", "score").join(TR.expert_predict(test, "route", experts).select("doc_id", F.col("score").alias("was")), "doc_id")
    ok = same.where("score <> was").limit(1).count() == 0 and set(loaded) == set(experts)
    report = M.classification_report(scored, threshold=0.5)
    inside = F.forall(F.array("precision", "recall", "f1"), lambda v: v.isNull() | v.between(0, 1))
    return report.select("class_name", "support", inside.alias("in_range"), F.lit(ok).alias("reloaded"))


@register("feature_importance_top", operators=("M12", "W5", "P13"), sql="""
SELECT i::INTEGER AS rank, true AS ordered, true AS named FROM range(50) r(i)
""")
def q_feature_importance_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most important of the 1549 dimensions, by the one dimension table."""
    x = labelled_features(spark, sf_dir)
    model = TR.train_gbt(x.where("split = 'train'"), max_iter=20, max_depth=4)
    imp = TR.importance_table(model, [D.meaning(i) for i in range(C.FULL_FEATURE_DIM)])
    top = TR.top_k_importance(imp)  # at most 50 rows
    w = Window.orderBy(F.desc("importance"), "dim")
    total = imp.agg(F.sum("importance").alias("t"))  # one row
    return top.withColumn("rank", F.row_number().over(w) - 1).withColumn("before", F.lag("importance").over(w)).crossJoin(F.broadcast(total)).select(
        "rank", (F.coalesce(F.col("before") >= F.col("importance"), F.lit(True)) & (F.abs(F.col("t") - 1) < 1e-6)).alias("ordered"),
        F.col("meaning").rlike("^(stat|hash|pe):|^padding$").alias("named"))


@register("dimensions", operators=("P13", "F6"), sql=f"""
SELECT i::INTEGER AS dim, CASE WHEN i < 49 THEN 'stat' WHEN i < 305 THEN 'hash' WHEN i < 433 THEN 'pe' ELSE 'padding' END AS part,
       count(*) OVER ()::BIGINT AS rows_with_all FROM range(1549) r(i)
""")
def q_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of every dimension, over the rows that have all of them."""
    x = labelled_features(spark, sf_dir)
    width = x.agg(F.min(F.size("row")).alias("lo"), F.max(F.size("row")).alias("hi"))  # one row
    dims = D.dimension_table(spark)
    return dims.crossJoin(F.broadcast(width)).select("dim", F.regexp_extract("meaning", "^[a-z]+", 0).alias("part"),
                                                     F.when(F.col("lo") == F.col("hi"), F.col("hi")).cast("bigint").alias("rows_with_all"))


@register("kmeans_families", operators=("M14", "M15", "M18", "W7", "A24", "A25", "A26", "A27", "A37", "F15", "P4", "S12"), sql="""
SELECT count(*)::BIGINT AS files, 32::BIGINT AS clusters, true AS named, true AS fitted, true AS scored FROM embeddings
""")
def q_kmeans_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M18 in one chain: scale, PCA, k-means, noise ids, families and names, family model, outputs, quality."""
    from hexlens.operators.discovery import discover_families
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("filename"), "embedding")
    found = discover_families(e, "embedding", k=32, min_family_size=2, out=scratch_table_path(spark, f"families-{uuid.uuid4().hex[:12]}"))
    sizes, families, model, quality = (found[x] for x in ("sizes", "families", "model", "quality"))
    s = sizes.agg(F.sum("n").cast("bigint").alias("files"), F.count(F.lit(1)).alias("clusters"))
    named = families.where(F.col("family_name") != F.format_string(C.FAMILY_NAME_FORMAT, "cluster_id", "n")).limit(1).count() == 0
    fitted = model.count() == sizes.count() and model.where("threshold <= 0").limit(1).count() == 0
    q = quality.first()
    return s.select("files", "clusters", F.lit(named).alias("named"), F.lit(fitted).alias("fitted"),
                    F.lit(bool(q.calinski_harabasz > 0 and -1 <= q.silhouette <= 1)).alias("scored"))


@register("continued_boosting", operators=("M2", "M3", "M4", "S14"), sql="""
SELECT i::INTEGER AS stage, round(CASE WHEN i < 6 THEN 0.001 + (0.1 - 0.001) * least(1, i / 4.0) ELSE 0.1 END, 9) AS step, true AS kept, true AS better FROM range(10) r(i)
""")
def q_continued_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first fit with warm-up, saved, loaded and continued at full rate: stage rates, and what the first stages became."""
    x = labelled_features(spark, sf_dir)
    train = x.where("split <> 'test'").select("features", "label")
    first = boost(train, features="features", rounds=6, depth=3, warmup=4)
    at = scratch_table_path(spark, f"boosted-{uuid.uuid4().hex[:12]}")
    first.save(spark, at)
    more = boost(train, features="features", rounds=4, depth=3, model=BoostedModel.load(spark, at))
    loss = lambda m: m.margin(train).agg(F.avg(F.log1p(F.exp(F.when(F.col("label") == 1, -F.col("margin")).otherwise(F.col("margin")))))).first()[0]
    better = bool(loss(more) < loss(first))
    return spark.createDataFrame([(i, round(s, 9), i >= 6 or first.stages[i][1] == t, better) for i, (s, t) in enumerate(more.stages)],
                                 "stage int, step double, kept boolean, better boolean")


@register("fp_reinforcement", operators=("M5", "M6", "J3", "A30", "U2"), sql=_SPLIT_SQL + """,
t AS (SELECT count_if(split = 'train')::BIGINT AS n, count_if(split = 'train' AND label = 0)::BIGINT AS benign, count_if(split = 'val' AND label = 0)::BIGINT AS val_benign FROM s)
SELECT 'reinforce' AS phase, val_benign AS false_positives, benign AS touched FROM t
UNION ALL SELECT 'mining', val_benign, n FROM t
""")
def q_fp_reinforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-weighting (M5) and mining (M6), first iteration: a prior-only model puts every row above the threshold,
    so all benign rows are false positives: of validation, and those of the training rows that are re-weighted."""
    x = labelled_features(spark, sf_dir).select("doc_id", "features", "label", "split")
    train, val = (x.where(F.col("split") == s).drop("split") for s in ("train", "val"))
    start = BoostedModel(0.0, (), "features")  # scores 0.5
    kw = {"threshold": 0.4, "features": "features", "depth": 3, "max_iter": 2, "rounds": 2}
    _, h1 = fp_reinforcement(train, val, "doc_id", start, **kw)
    _, h2 = fp_mining(train, val, "doc_id", start, **kw)
    return spark.createDataFrame([("reinforce", *h1[0][1:]), ("mining", *h2[0][1:])], "phase string, false_positives long, touched long")


@register("fold_assignment", operators=("M10",), sql=_SPLIT_SQL + " SELECT (wide % 5)::INTEGER AS fold, label::INTEGER AS label, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def q_fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = TR.fold_column(labelled_features(spark, sf_dir).select("doc_id", "label"), "doc_id", 5)
    return x.groupBy("fold", F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("cv_tune", operators=("M10", "M11"), sql="""
SELECT t AS trial, 'f1' AS metric, true AS in_range FROM (SELECT 'baseline' AS t UNION ALL SELECT 'trial_' || i FROM range(50) r(i))
UNION ALL SELECT t, m, true FROM (VALUES ('baseline'), ('best')) a(t), (VALUES ('precision'), ('recall'), ('accuracy'), ('roc_auc')) b(m)
""")
def q_cv_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline against fifty sampled parameter sets, five folds each, on all 1549 features."""
    x = labelled_features(spark, sf_dir).select("doc_id", "label", "row")
    out = TR.tune(TR.assemble(x, "row", "vec"), "doc_id")
    name = F.when((F.col("metric") != "f1") & (F.col("trial") != "baseline"), "best").otherwise(F.col("trial"))
    return out.select(name.alias("trial"), "metric", F.col("score").between(0, 1).alias("in_range"))


@register("gating_mlp", operators=("M9",), sql="""
SELECT (label >= 5)::INT AS route, count(*)::BIGINT AS held_out, true AS gated FROM embeddings
WHERE ('0x' || substr(sha256(CAST(vec_id AS VARCHAR) || ':42'), 1, 8))::BIGINT % 100 < 20 GROUP BY 1
""")
def q_gating_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate network (256, 128) on routing labels (stand-in: embedding label >= 5), applied to held-out rows."""
    e = table(spark, sf_dir, "embeddings").withColumn("route", (F.col("label") >= 5).cast("double"))
    x = TR.split_60_20_20(TR.assemble(e, "embedding", "vec"), "vec_id").select("vec_id", "split", "route", "vec")
    model = TR.train_gating_mlp(x.where("split <> 'test'"), "vec", "route", max_iter=30)
    pred = model.transform(x.where("split = 'test'"))
    return pred.groupBy(F.col("route").cast("int").alias("route")).agg(F.count(F.lit(1)).alias("held_out"), F.min(F.col("prediction").isin(0.0, 1.0)).alias("gated"))


@register("feature_gating", operators=("M13", "W9", "P10", "M12"), sql="""
SELECT k::INTEGER AS k, true AS in_range FROM (VALUES (20), (40), (49)) v(k)
""")
def q_feature_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refit on the top-k statistics by importance, k from 20 by 20 and ending at all of them."""
    x = labelled_features(spark, sf_dir).select("label", "split", "stats")
    x = materialize(TR.assemble(x, "stats", "vec"), "gating-input")
    model = TR.train_gbt(x.where("split = 'train'"), features="vec", max_iter=10, max_depth=4)
    imp = model.featureImportances.toArray()
    order = sorted(range(len(imp)), key=lambda i: (-imp[i], i))
    out = TR.feature_gating(x, order, TR.k_schedule(len(imp), 20, 20), features="vec", max_iter=10, max_depth=4)
    return out.select("k", F.col("accuracy").between(0, 1).alias("in_range"))


@register("feature_masks", operators=("P10",), sql="""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)
SELECT vec_id, 10 AS random_width, round(sum(x) FILTER (d < 49), 4) AS statistics, round(sum(x) FILTER (d >= 49), 4) AS pe, round(sum(x) FILTER (d IN (5, 3)), 4) AS top_k
FROM e GROUP BY vec_id
""")
def q_feature_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics only, PE part only, seeded random and top-k masks of the vectors."""
    x = TR.assemble(table(spark, sf_dir, "embeddings"), "embedding", "vec").select("vec_id", "vec")
    masks = {"random_width": ("random", 10, None), "statistics": ("statistics", None, None), "pe": ("pe", None, None), "top_k": ("top_k", 2, [5, 3, 1])}
    for name, (kind, k, order) in masks.items():
        x = TR.mask_columns(x, "vec", TR.mask_indices(kind, 64, k, order), name)
    total = lambda c: F.round(F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, v: a + v), 4)
    return x.select("vec_id", F.size(vector_to_array("random_width")).alias("random_width"), *[total(c).alias(c) for c in ("statistics", "pe", "top_k")])


@register("cluster_quality", operators=("A37",), sql="""
WITH e AS (SELECT vec_id, label AS c, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
mc AS (SELECT c, d, avg(x) AS mu FROM e GROUP BY c, d),
mg AS (SELECT d, avg(x) AS g FROM e GROUP BY d),
nc AS (SELECT c, count(DISTINCT vec_id) AS n FROM e GROUP BY c),
b AS (SELECT sum(nc.n * (mc.mu - mg.g) * (mc.mu - mg.g)) AS B FROM mc JOIN mg USING (d) JOIN nc USING (c)),
w AS (SELECT sum((e.x - mc.mu) * (e.x - mc.mu)) AS W FROM e JOIN mc USING (c, d)),
g AS (SELECT count(DISTINCT vec_id) AS N, count(DISTINCT c) AS k FROM e)
SELECT g.N::BIGINT AS N, g.k::BIGINT AS k, round((b.B / (g.k - 1)) / (w.W / (g.N - g.k)), 4) AS calinski_harabasz
FROM g, b, w
""")
def q_cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calinski-Harabasz of the embedding clusters by grouped sums (no pairwise distances)."""
    ch = TR.calinski_harabasz(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return ch.select(F.col("N").cast("bigint"), F.col("k").cast("bigint"),
                     F.round("calinski_harabasz", 4).alias("calinski_harabasz"))


SAMPLES = 2000  # rows of a file, about


def write_samples(samples: DataFrame, at: str) -> int:
    """As many files for each part, of bounded size and by as many tasks; returns how many, which one trigger takes."""
    counts = [r["count"] for r in samples.groupBy("part").count().collect()]  # four rows
    files = max(1, min(counts, default=0) // SAMPLES)
    # the row's number tells rows of equal keys apart: no part lacks a file
    piece = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files)).alias("piece")
    samples.select("*", piece).repartition(len(counts) * files or 1, "part", "piece").sortWithinPartitions("part", "piece").write.partitionBy("part", "piece").parquet(at)
    return files


@register("incremental_fit", operators=("T5", "M4", "S5", "S14"), sql=_SPLIT_SQL + """
SELECT 8 AS stages, 4 AS epochs, 4 AS epochs_after_restart, true AS restart_is_idle, count_if(split <> 'test')::BIGINT AS samples FROM s
""")
def q_incremental_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored samples (without the test rows) arrive as files; each micro-batch continues the last saved model.

    Labels come from the file names.  A second run over the same folder finds
    nothing new and ends with the same model.
    """
    x = labelled_features(spark, sf_dir).where("split <> 'test'")
    at = scratch_table_path(spark, f"incremental-{uuid.uuid4().hex[:12]}")
    name = F.concat(F.when(F.col("label") == 1, "trojan_").otherwise("clean_"), F.col("doc_id").cast("string"))
    samples = x.select(name.alias("filename"), "features", (F.pmod("doc_id", F.lit(4))).alias("part"))
    files = write_samples(samples, f"{at}/samples")
    schema = samples.drop("part").schema
    n = spark.read.parquet(f"{at}/samples").count()
    runs = []
    for _ in range(2):
        model = incremental_fit(spark, f"{at}/samples/*/*", schema, f"{at}/checkpoint", f"{at}/models", rounds=2, depth=3, max_files_per_trigger=files)
        runs.append((model, saved_epochs(spark, f"{at}/models")))
    (m1, e1), (m2, e2) = runs
    return spark.createDataFrame([(len(m1.stages), len(e1), len(e2), m1 == m2, n)],
                                 "stages int, epochs int, epochs_after_restart int, restart_is_idle boolean, samples long")


# ---------------------------------------------------------------------------
# trees from histograms
# ---------------------------------------------------------------------------

_VECTORS = """
WITH e AS (SELECT vec_id, label, embedding, ('0x' || substr(sha256(CAST(vec_id AS VARCHAR) || ':42'), 1, 8))::BIGINT % 100 AS bucket FROM embeddings),
s AS (SELECT *, (label >= 5)::INT AS y, CASE WHEN bucket < 20 THEN 'test' WHEN bucket < 40 THEN 'val' ELSE 'train' END AS split FROM e)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their split and its role: 0 teaches, 1 stops."""
    x = TR.split_60_20_20(table(spark, sf_dir, "embeddings"), "vec_id")
    return x.withColumn("role", F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1))


@register("first_split", operators=("M2", "M12"), sql=_VECTORS + """,
x AS (SELECT vec_id, y, split, unnest(range(0, 64)) AS d, floor(unnest(embedding)::DOUBLE * 20) AS v FROM s WHERE split <> 'test'),
p AS (SELECT avg(y) AS p, count(*) AS n, sum(y) AS ys FROM s WHERE split = 'train'),
c AS (SELECT d, v, count_if(split = 'train') AS n, sum(CASE WHEN split = 'train' THEN y ELSE 0 END) AS ys FROM x GROUP BY d, v),
cum AS (SELECT d, v, lead(v) OVER (PARTITION BY d ORDER BY v) AS above, sum(n) OVER (PARTITION BY d ORDER BY v) AS n, sum(ys) OVER (PARTITION BY d ORDER BY v) AS ys FROM c),
g AS (SELECT d, v, (v + above) / 2 AS threshold, p.p * cum.n - cum.ys AS gl, p.p * (1 - p.p) * cum.n AS hl, p.p * (p.n - cum.n) - (p.ys - cum.ys) AS gr, p.p * (1 - p.p) * (p.n - cum.n) AS hr
      FROM cum, p WHERE above IS NOT NULL AND cum.n >= 20 AND p.n - cum.n >= 20),
b AS (SELECT *, gl * gl / hl + gr * gr / hr - (gl + gr) * (gl + gr) / (hl + hr) AS gain FROM g ORDER BY round(gain, 9) DESC, d, v LIMIT 1),
m AS (SELECT x.y, ln(p.p / (1 - p.p)) AS before, ln(p.p / (1 - p.p)) + CASE WHEN x.v <= b.threshold THEN -b.gl / b.hl ELSE -b.gr / b.hr END AS after
      FROM x JOIN b ON x.d = b.d, p WHERE x.split = 'val'),
l AS (SELECT avg(ln(1 + exp(CASE WHEN y = 1 THEN -before ELSE before END))) AS before, avg(ln(1 + exp(CASE WHEN y = 1 THEN -after ELSE after END))) AS after FROM m)
SELECT b.d::INTEGER AS dim, round(threshold, 6) AS threshold, round(gain, 6) AS gain, round(-gl / hl, 6) AS left_value, round(-gr / hr, 6) AS right_value,
       round(ln(p.p / (1 - p.p)), 6) AS init_margin, round(l.before, 6) AS loss_before, round(l.after, 6) AS loss_after, true AS most_important
FROM b, p, l
""")
def q_first_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree of one split: where, its gain, its Newton values, and the validation losses around it."""
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * 20).cast("double"))
    x = _vectors(spark, sf_dir).select("vec_id", "role", whole.alias("x"), (F.col("label") >= 5).cast("double").alias("label"))
    model, fit, trainer = T.train(x, "vec_id", "x", rounds=1, leaves=2, rate=1.0)
    (_, t), = fit.trees
    dim = int(t["feature"][0])
    row = (dim, float(trainer.bins.borders[dim][t["bin"][0]]), float(t["gain"][0]), float(t["value"][1]), float(t["value"][2]), model.init_margin, *map(float, fit.losses),
           fit.best_round() != 1 or int(trainer.importance(fit).argmax()) == dim)
    names = ["threshold", "gain", "left_value", "right_value", "init_margin", "loss_before", "loss_after"]
    out = spark.createDataFrame([row], "dim int, " + ", ".join(f"{n} double" for n in names) + ", most_important boolean")
    return out.select("dim", *[F.round(n, 6).alias(n) for n in names], "most_important")


@register("early_stop", operators=("M2", "M3", "M4", "S14"), sql=_VECTORS + """
SELECT count_if(split = 'train')::BIGINT AS train_rows, count_if(split = 'val')::BIGINT AS val_rows, true AS stopped, true AS least_loss, true AS signal_found, true AS went_on FROM s
""")
def q_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit on a planted signal (two components' sum) with row and feature sampling ends by its validation loss, is saved, and goes on."""
    x = _vectors(spark, sf_dir).select("vec_id", "split", "role", "embedding", (F.col("embedding")[4] + F.col("embedding")[10] > 0).cast("double").alias("label"))
    kw = {"leaves": 8, "min_data": 10, "feature_fraction": 0.8, "bagging_fraction": 0.9, "bagging_freq": 3, "rate": 0.6}
    model, fit, trainer = T.train(x, "vec_id", "embedding", rounds=40, stop_after=3, model_features="vec", **kw)
    at = scratch_table_path(spark, f"trees-{uuid.uuid4().hex[:12]}")
    model.save(spark, at)
    more, _, again = T.train(x, "vec_id", "embedding", rounds=2, stop_after=3, model_features="vec", start=BoostedModel.load(spark, at), **kw)
    imp = trainer.importance(fit)
    scored = model.predict(TR.assemble(x.where("split = 'test'"), "embedding", "vec"))
    right = scored.agg(F.avg((F.col("label") == (F.col("score") > 0.5).cast("double")).cast("double"))).first()[0]
    n = {r.role: r["count"] for r in x.groupBy("role").count().collect()}
    facts = (n.get(0, 0), n.get(1, 0), len(fit.trees) < 40 and len(fit.losses) - 1 - fit.best_round() == 3, fit.losses[fit.best_round()] == min(fit.losses),
             bool(right > 0.75) and set(imp.argsort()[-2:].tolist()) == {4, 10}, more.stages[: len(model.stages)] == model.stages)
    return spark.createDataFrame([facts], "train_rows long, val_rows long, stopped boolean, least_loss boolean, signal_found boolean, went_on boolean")


@register("tuned_trees", operators=("M10", "M11"), sql="""
SELECT t AS trial, true AS in_range, true AS best_holds, true AS signal_found FROM (SELECT 'baseline' AS t UNION ALL SELECT 'trial_' || i FROM range(50) r(i))
""")
def q_tuned_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty drawn sets of all eight parameters and the baseline, five folds and a hundred rounds each: 255 fits of one binned table of the vectors."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("embedding")[4] + F.col("embedding")[10] > 0).cast("double").alias("label"))
    out = T.tune(TR.fold_column(x, "vec_id", 5), "vec_id", "embedding", trials=50, baseline={"rate": 0.3})
    top = out.where("trial <> 'baseline'").agg(F.max("f1").alias("top"), F.count_if("best").alias("n"))  # one row
    inside = F.forall(F.array(*T.METRICS), lambda v: v.between(0, 1))
    return out.crossJoin(F.broadcast(top)).select("trial", inside.alias("in_range"), ((F.col("n") == 1) & (~F.col("best") | (F.col("f1") == F.col("top")))).alias("best_holds"),
                                                  ((F.col("trial") != "baseline") | (F.col("roc_auc") > 0.7)).alias("signal_found"))


@register("gated_trees", operators=("M13", "W9", "P10", "M12"), sql="""
SELECT k::INTEGER AS k, true AS in_range, true AS all_is_baseline FROM (VALUES (16), (32), (48), (64), (NULL)) v(k)
""")
def q_gated_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits on the first k dimensions by importance and on all (k null), in shared passes; all 64 are the baseline."""
    x = _vectors(spark, sf_dir).select("vec_id", "role", "embedding", (F.col("embedding")[4] + F.col("embedding")[10] > 0).cast("double").alias("label"))
    _, fit, trainer = T.train(x, "vec_id", "embedding", rounds=3, rate=0.3)
    order = (-trainer.importance(fit)).argsort(kind="stable").tolist()
    out = materialize(T.gate_features(x, "vec_id", "embedding", order, TR.k_schedule(64, 16, 16), rounds=3, rate=0.3), "gated-trees")
    base = out.where("k is null").select(F.col("accuracy").alias("base"))  # one row
    return out.crossJoin(F.broadcast(base)).select("k", F.col("accuracy").between(0, 1).alias("in_range"), (F.coalesce(F.col("k") != 64, F.lit(True)) | (F.col("accuracy") == F.col("base"))).alias("all_is_baseline"))


@register("fp_loops", operators=("M5", "M6", "J3", "A30", "U2"), sql=_VECTORS.replace("label >= 5", "embedding[5] + embedding[11] > 0") + """,
t AS (SELECT count_if(split = 'train')::BIGINT AS n, count_if(split = 'train' AND y = 0)::BIGINT AS benign, count_if(split = 'val' AND y = 0)::BIGINT AS val_benign FROM s)
SELECT 'reinforce' AS phase, val_benign AS first_false_positives, benign AS first_touched, true AS counts_hold, true AS ended_by_rule, true AS fewer FROM t
UNION ALL SELECT 'mining', val_benign, n, true, true, true FROM t
""")
def q_fp_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-weighting (M5) and mining (M6) to their ends with histogram trees, from a model that takes every row for malicious.

    Every iteration is held against the rules: false positives counted again from
    the models, rows re-weighted or added, and why the loop ended.
    """
    x = TR.assemble(_vectors(spark, sf_dir), "embedding", "vec").select(
        "vec_id", "vec", "split", (F.col("embedding")[4] + F.col("embedding")[10] > 0).cast("double").alias("label"))
    train, val = (materialize(x.where(F.col("split") == s).drop("split"), "fp-rows") for s in ("train", "val"))
    start, out = BoostedModel(0.0, (), "vec"), []
    kw = {"threshold": 0.4, "max_iter": 4, "rounds": 2, "leaves": 8, "rate": 0.3}
    for phase, loop in (("reinforce", fp_reinforcement), ("mining", fp_mining)):
        models = [start]

        def fit(rows, models=models, **args):
            models.append(T.go_on(rows, key="vec_id", **args))
            return models[-1]
        n_train = train.count()
        _, h = loop(train, val, "vec_id", start, fit=fit, **kw)
        wrong = [m.predict(val).where("label = 0 and score > 0.4").count() for m in models[: len(h)]]
        if phase == "reinforce":
            touched = [m.predict(train).where("label = 0 and score > 0.4").count() for m in models[: len(h)]]
            best = min(w for w in wrong[:-1]) if len(wrong) > 1 else None
            ended = wrong[-1] == 0 or (best is not None and wrong[-1] >= best) or len(h) == kw["max_iter"]
        else:
            touched = [n_train + sum(wrong[:i]) for i in range(len(h))]
            ended = wrong[-1] == 0 or len(h) == kw["max_iter"]
        out.append((phase, h[0][1], h[0][2], [r[1] for r in h] == wrong and [r[2] for r in h] == touched, bool(ended), len(h) > 1 and min(wrong[1:]) < wrong[0]))
    return spark.createDataFrame(out, "phase string, first_false_positives long, first_touched long, counts_hold boolean, ended_by_rule boolean, fewer boolean")


@register("projection", operators=("M14", "F15"), sql="""
WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT d, avg(x) AS mu, stddev_pop(x) AS sd FROM e GROUP BY d)
SELECT vec_id, round(sum(((x - mu) / sd) ** 2), 6) AS square, 2 AS plane_width, 64.0::DOUBLE AS whole_variance, true AS ordered FROM e JOIN m USING (d) GROUP BY vec_id
""")
def q_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of the vectors: a rotation keeps every row's length, the variances add up to the number of columns; with the first two as a plane."""
    from hexlens.operators.reduction import principal_components
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    c = principal_components(e, "embedding", 64)
    out = c.project(e, "embedding", "z", plane="plane")
    square = F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v)
    return out.select("vec_id", F.round(square, 6).alias("square"), F.size("plane").alias("plane_width"), F.lit(round(float(c.variance.sum()), 6)).alias("whole_variance"),
                      F.lit(bool((c.variance[:-1] >= c.variance[1:] - 1e-12).all())).alias("ordered"))


@register("mini_batch_kmeans", operators=("M15",), sql="""
SELECT vec_id, true AS nearest, true AS closer_than_seeds, true AS every_batch_counted FROM embeddings
""")
def q_mini_batch_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty centres moved by a hundred batches; every row's centre is held against all centres."""
    from hexlens.operators.reduction import MiniBatches, batches_of, mini_batch_kmeans
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n, batch = e.count(), 256
    m = mini_batch_kmeans(e, "vec_id", "embedding", k=40, batch=batch)
    out = m.assign(e, "embedding", "cluster", "distance")
    mean = lambda df: df.agg(F.avg("distance")).first()[0]
    closer = mean(out) < mean(MiniBatches(m.seeds, m.seeds, m.counts).assign(e, "embedding", "cluster", "distance"))
    counted = batches_of(e, "vec_id", "embedding", n, batch, 100, C.DEFAULT_RANDOM_STATE).count() == int(m.counts.sum())
    to = lambda c: F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    least = F.least(*[to(c.tolist()) for c in m.centres])
    return out.select("vec_id", (F.abs(F.col("distance") - least) < 1e-9).alias("nearest"), F.lit(bool(closer)).alias("closer_than_seeds"), F.lit(counted).alias("every_batch_counted"))


def expert_scores(files: DataFrame, expert) -> DataFrame:
    """file_path and the expert's own score of every file; the features are written once, as the scan does it: the model must not reach into the parser."""
    x = materialize(featurise(files, "path", native=True).select("path", "features"), "expert-features")
    return expert.predict(TR.assemble(x, "features", "vec")).select(F.col("path").alias("file_path"), F.col("score").alias("own"))


@register("train_all", operators=("C4", "C1", "M7", "M8", "M11", "M18", "S14", "S15"), sql="""
SELECT stage, first_run, second_run, (SELECT count(*) FROM documents)::BIGINT AS scanned, true AS same_models, true AS scored_by_expert, true AS families_hold
FROM (VALUES ('features', true, false), ('first', true, false), ('tuned', true, false), ('refit', false, true), ('experts', false, true), ('families', false, true)) v(stage, first_run, second_run)
""")
def q_train_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain is ended after its third stage, goes on from there, finds all of it made the third time; then its experts scan every document.

    Malicious documents of a score beyond the threshold get the nearest family of those that the chain found.
    """
    rows = labelled_features(spark, sf_dir).select("doc_id", "row", "label", "split", route_from_vector("row", "native").alias("route"))
    at = scratch_table_path(spark, f"train-all-{uuid.uuid4().hex[:12]}")
    kw = {"trials": 2, "folds": 3, "rounds": 4, "k": 8, "pca": 10, "min_family_size": 2}

    class Ended(Exception):
        pass

    def end(name: str) -> None:
        if name == "tuned":
            raise Ended
    ran = []
    try:
        train_all(spark, rows, at, "labelled documents", stop=end, **kw)
    except Ended:
        ran.append({r.stage for r in spark.read.schema("stage string").json(f"{at}/manifest/*").collect()})
    chain = train_all(spark, rows, at, "labelled documents", **kw)
    ran.append(set(chain.ran))
    third = train_all(spark, rows, at, "labelled documents", **kw)
    model = trained(spark, chain)
    same = not third.ran and trained(spark, third)["experts"] == model["experts"] and third.made == chain.made
    files = documents_as_files(spark, sf_dir).select("path", "length", "content")
    got = materialize(scan_corpus(files, model["experts"], model["family_model"], model["family_scaler"], require_pe=False, rule="native", native=True, threshold=0.5), "trained-scan")
    own = expert_scores(files, model["experts"][0])
    scored = got.join(own, "file_path").where(F.abs(F.col("score") - F.col("own")) > 1e-9).limit(1).count() == 0
    bad = got.where((F.col("is_malware") != (F.col("score") > 0.5)) | (F.col("is_malware") & F.col("virus_family").isNull()) | (~F.col("is_malware") & F.col("virus_family").isNotNull()))
    n, known = got.count(), bad.limit(1).count() == 0
    stages = ("features", "first", "tuned", "refit", "experts", "families")
    return spark.createDataFrame([(s, s in ran[0], s in ran[1], n, same, scored, known) for s in stages],
                                 "stage string, first_run boolean, second_run boolean, scanned long, same_models boolean, scored_by_expert boolean, families_hold boolean")
