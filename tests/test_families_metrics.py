import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlens.operators import families as FM
from hexlens.operators import metrics as M
from hexlens.operators.ranking import group_quantile, rank_within_group, running_totals


def test_group_quantile_exact_with_hot_group(spark):
    rng = np.random.default_rng(1)
    hot = rng.normal(size=3000)          # one group holds most rows
    rows = [(0, float(v)) for v in hot] + [(g, float(v)) for g in (1, 2) for v in rng.normal(size=7)] + [(3, 5.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r.q for r in group_quantile(df, ["g"], "v", 0.9, "q").collect()}
    for g in (0, 1, 2, 3):
        vals = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx(float(np.percentile(vals, 90)))


def test_rank_within_group_is_dense_and_ordered(spark):
    rows = [(i % 3, float((i * 7919) % 1000)) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, v double")
    r = rank_within_group(df, ["g"], ["v"]).collect()
    for g in range(3):
        ranks = sorted(x["rank"] for x in r if x.g == g)
        assert ranks == list(range(300))
        by_rank = sorted((x["rank"], x.v) for x in r if x.g == g)
        assert [v for _, v in by_rank] == sorted(v for k, v in rows if k == g)


def test_running_totals(spark):
    rows = [(float(i), 1.0, float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "t double, a double, b double")
    out = running_totals(df, [F.col("t").desc()], ["a", "b"], num_partitions=5).collect()
    for r in out:
        assert r.cum_a == 200 - r.t
        assert r.cum_b == sum(1 for i in range(int(r.t), 200) if i % 2)


def test_family_fit_and_nearest_centroid_vs_brute_force(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(4, 6)) * 5
    X = np.vstack([c + rng.normal(size=(30, 6)) for c in centers])
    lab = np.repeat(np.arange(4), 30)
    df = spark.createDataFrame([(i, X[i].tolist(), int(lab[i])) for i in range(len(X))],
                               "id long, v array<double>, cluster int")
    model, scaler = FM.family_fit(df, "v", "cluster")
    mu, sd = X.mean(0), X.std(0)
    sd[sd == 0] = 1
    Z = (X - mu) / sd
    m = {r.cluster_id: r for r in model.collect()}
    for c in range(4):
        cz = Z[lab == c].mean(0)
        np.testing.assert_allclose(m[c].centroid, cz, rtol=1e-9, atol=1e-9)
        d = np.linalg.norm(Z[lab == c] - cz, axis=1)
        assert m[c].threshold == pytest.approx(float(np.percentile(d, 90)))
        assert m[c].family_name == f"Malware_Family_{c}_Size30"
    x = FM.scaler_apply(df, "v", scaler, "x")
    out = {r.id: r for r in FM.nearest_centroid(x, "x", model).collect()}
    C_ = np.array([m[c].centroid for c in range(4)])
    for i in range(len(X)):
        dist = np.linalg.norm(C_ - Z[i], axis=1)
        j = int(np.argmin(dist))
        assert out[i].nearest_cluster_id == j
        assert out[i].distance == pytest.approx(float(dist[j]))
        known = dist[j] <= m[j].threshold
        assert out[i].is_new_family == (not known)
        assert out[i].family_name == (m[j].family_name if known else "New_Unknown_Family")


def test_single_member_cluster_threshold_is_one(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [3.0, 1.0], 1), (2, [3.5, 1.5], 1)],
                               "id long, v array<double>, cluster int")
    model, _ = FM.family_fit(df, "v", "cluster")
    th = {r.cluster_id: r.threshold for r in model.collect()}
    assert th[0] == 1.0


def test_noise_ids(spark):
    df = spark.createDataFrame([("b", -1), ("a", -1), ("c", 2), ("d", 0), ("e", -1)], "f string, c int")
    got = {r.f: r.fid for r in FM.noise_ids(df, "c", "f", out="fid").collect()}
    assert got == {"a": 3, "b": 4, "e": 5, "c": 2, "d": 0}


def test_analyze_clusters_rules(spark):
    df = spark.createDataFrame([(c,) for c in [0] * 25 + [1] * 3 + [-1] * 30], "cluster_id int")
    a = {r.cluster_id for r in FM.analyze_clusters(df, min_family_size=20).collect()}
    assert a == {0}
    b = {r.cluster_id for r in FM.analyze_clusters(df, min_family_size=20, treat_noise_as_family=True).collect()}
    assert b == {0, 1, -1}


def _scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def test_roc_auc_vs_rank_formula(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.5 + y * 0.3, 2)  # ties on purpose
    auc = M.roc_auc(_scored(spark, [(int(a), float(b)) for a, b in zip(y, s)])).first().auc
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert auc == pytest.approx(want)


def test_confusion_and_report(spark):
    rows = [(0, 0.1), (0, 0.99), (1, 0.985), (1, 0.98), (1, 0.2)]
    cm = M.confusion_counts(_scored(spark, rows)).first()
    assert (cm.tn, cm.fp, cm.fn, cm.tp) == (1, 1, 2, 1)   # 0.98 itself is benign
    rep = {r.class_name: r for r in M.classification_report(_scored(spark, rows)).collect()}
    assert rep["Malicious"].precision == pytest.approx(0.5)
    assert rep["Malicious"].recall == pytest.approx(1 / 3)
    one = {r.class_name: r for r in M.classification_report(_scored(spark, [(0, 0.1), (0, 0.2)])).collect()}
    assert one["Malicious"].precision == 0.0 and one["Malicious"].f1 == 0.0


def test_first_n_per_class_with_hot_label(spark):
    rows = [(i, 0 if i % 10 else 1) for i in range(1000)]   # label 0 holds 90 % of rows
    df = spark.createDataFrame(rows, "id long, label int")
    got = FM.first_n_per_class(df, "label", "id", n=5).collect()
    assert sorted(r.id for r in got if r.label == 0) == [1, 2, 3, 4, 5]
    assert sorted(r.id for r in got if r.label == 1) == [0, 10, 20, 30, 40]
