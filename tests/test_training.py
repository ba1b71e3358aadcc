import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hexlens.operators import metrics as M
from hexlens.operators import training as TR
from hexlens.operators.boosting import boost, warmup_rate


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(2)
    n = 300
    y = rng.integers(0, 2, n)
    X = rng.normal(size=(n, 5)) + y[:, None] * 1.5
    df = spark.createDataFrame([(i, X[i].tolist(), float(y[i])) for i in range(n)], "id long, f array<double>, label double")
    return df.withColumn("vec", array_to_vector("f"))


def test_split_is_stable_and_proportional(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r.k: r.split for r in TR.split_60_20_20(df, "k").collect()}
    b = {r.k: r.split for r in TR.split_60_20_20(df, "k").collect()}
    assert a == b
    shares = {s: sum(1 for v in a.values() if v == s) / 5000 for s in ("train", "val", "test")}
    assert abs(shares["test"] - 0.2) < 0.03 and abs(shares["val"] - 0.2) < 0.03


def test_boost_and_continue(separable):
    m = boost(separable, rounds=4, depth=2)
    auc1 = M.roc_auc(m.predict(separable)).first().auc
    m = boost(separable, rounds=4, depth=2, model=m, warmup=8)
    auc2 = M.roc_auc(m.predict(separable)).first().auc
    assert len(m.stages) == 8 and auc1 > 0.8 and auc2 >= auc1 - 0.02
    assert warmup_rate(0, 10, 0.001, 0.07) == pytest.approx(0.001)
    assert warmup_rate(10, 10, 0.001, 0.07) == pytest.approx(0.07)


def test_experts_and_missing_expert(separable):
    df = separable.withColumn("route", (F.col("id") < 280).cast("int") * 0 + (F.col("id") >= 295).cast("int"))
    experts = TR.train_experts(df, "route", features="vec", max_iter=5, max_depth=2)
    assert 0 in experts and 1 not in experts          # route 1 has 5 rows: no expert
    scored = TR.expert_predict(df, "route", experts, features="vec")
    zeros = scored.where("route = 1").select("score").distinct().collect()
    assert [r.score for r in zeros] == [0.0]


def test_calinski_harabasz_matches_numpy(spark):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(size=(40, 3)) + c for c in (0, 4, 8)])
    lab = np.repeat([0, 1, 2], 40)
    df = spark.createDataFrame([(X[i].tolist(), int(lab[i])) for i in range(len(X))], "v array<double>, c int")
    got = TR.calinski_harabasz(df, "v", "c").first().calinski_harabasz
    mu = X.mean(0)
    B = sum((lab == c).sum() * np.sum((X[lab == c].mean(0) - mu) ** 2) for c in range(3))
    W = sum(np.sum((X[lab == c] - X[lab == c].mean(0)) ** 2) for c in range(3))
    assert got == pytest.approx((B / 2) / (W / (len(X) - 3)), rel=1e-9)


def test_k_schedule():
    assert TR.k_schedule(120, 50, 50) == [50, 100, 120]
    assert TR.k_schedule(30, 50, 50) == [30]


def test_tuning_equals_sparks_own_trees(spark):
    """Without draws the fits are those of GBTClassifier: the same scores of held-out rows."""
    from pyspark.ml.classification import GBTClassifier
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (400, 4)).astype(float)
    y = ((x[:, 0] > 3) ^ (x[:, 1] > 5) ^ (rng.random(400) < 0.1)).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(400)], "id long, f array<double>, label double").withColumn("vec", array_to_vector("f"))
    got = {r.metric: r.score for r in TR.tune(df, "id", trials=0, folds=2).collect()}
    data = TR.fold_column(df, "id", 2)
    want = dict.fromkeys(TR.TUNE_METRICS, 0.0)
    for k in range(2):
        pred = GBTClassifier(maxIter=20, maxDepth=4, seed=42, featuresCol="vec").fit(data.where(f"fold <> {k}")).transform(data.where(f"fold = {k}")).localCheckpoint()
        for m in want:
            want[m] += TR.evaluator(m).evaluate(pred) / 2
    assert got.keys() == want.keys()
    assert all(got[m] == pytest.approx(want[m], abs=0.02) for m in want)


def test_cv_tune_is_all_trials_folds_and_features(spark, monkeypatch):
    from hexlens.plans import training as P
    seen = {}

    def tune(df, key, trials=50, folds=5, features="vec", **kw):
        seen.update(trials=trials, folds=folds, width=len(df.select(features).first()[0]))
        raise StopIteration
    monkeypatch.setattr(P.TR, "tune", tune)
    with pytest.raises(StopIteration):
        P.q_cv_tune(spark, "/root/testdata/sf0.001")
    assert seen == {"trials": 50, "folds": 5, "width": 1549}


def test_a_chain_leaves_no_binned_tables(spark, tmp_path):
    """Every model of the chain drops the table that it was fitted on, also with features that have one value."""
    import os

    from hexlens.operators.chain import train_all
    from hexlens.session import ensure_checkpoint_dir
    rng = np.random.default_rng(6)
    x = np.zeros((240, 30))
    x[:, 3], x[:, 9] = rng.normal(size=240), rng.normal(size=240)
    rows = [(i, x[i].tolist(), float(x[i, 3] > 0), i % 2, ("train", "val", "test")[i % 3]) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, row array<double>, label double, route int, split string")
    tables = f"{ensure_checkpoint_dir(spark)}/tables".removeprefix("file:")
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()

    class Ended(Exception):
        pass

    def end(name):
        if name == "experts":
            raise Ended
    with pytest.raises(Ended):
        train_all(spark, df, str(tmp_path / "chain"), "rows", trials=2, folds=2, rounds=2, stop=end)
    left = set(os.listdir(tables)) - before if os.path.isdir(tables) else set()
    assert not [t for t in left if t.startswith("tree-blocks")]
