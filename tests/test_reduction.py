"""Principal components and mini-batch k-means against plain numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlens.operators import reduction as R


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)


def test_components_are_those_of_the_correlation_matrix(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 150)) + 0.3 * rng.normal(size=(400, 150)) + 1e3
    x[:, 7] = 5.0
    df = frame(spark, x).unionByName(spark.createDataFrame([(900, None), (901, [1.0])], "id long, v array<double>"))
    c = R.principal_components(df, "v", 6)
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)
    value, vector = np.linalg.eigh(z.T @ z / len(z))
    assert np.allclose(c.variance, value[::-1][:6], rtol=1e-3) and c.share.sum() == pytest.approx(value[::-1][:6].sum() / 149, rel=1e-3)
    for k in range(4):  # beyond the planted four the values lie close together
        assert abs(abs(vector[:, -1 - k] @ c.axes[:, k]) - 1) < 1e-3
    got = {r.id: r for r in c.project(df, "v", plane="p").collect()}
    assert got[900].projection is None and got[901].projection is None and len(got) == 402
    for i in (0, 17, 399):
        assert np.allclose(got[i].projection, z[i] @ c.axes) and got[i].p == got[i].projection[:2]
    with pytest.raises(ValueError):
        R.principal_components(df.limit(0), "v", 2)


def test_batches_move_centres_as_plain_numpy_does(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(120, 3)) + 6 * k for k in range(4)])
    df = frame(spark, x)
    m = R.mini_batch_kmeans(df, "id", "v", k=5, batch=60, iterations=7)
    rows = R.batches_of(df, "id", "v", len(x), 60, 7, 42).collect()
    assert 200 < len(rows) < 700
    centres, counts = m.seeds.copy(), np.zeros(5)
    for t in range(7):
        b = np.array([r.x for r in rows if r.batch == t])
        own = ((b[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(5):
            n = (own == c).sum()
            if n:
                counts[c] += n
                centres[c] += (b[own == c].sum(axis=0) - n * centres[c]) / counts[c]
    assert np.allclose(m.centres, centres) and (m.counts == counts).all()
    got = {r.id: r for r in m.assign(df, "v", distance="d").collect()}
    d = ((x[:, None] - m.centres[None]) ** 2).sum(axis=2)
    assert all(got[i].cluster_id == d[i].argmin() and got[i].d == pytest.approx(d[i].min()) for i in range(len(x)))
    with pytest.raises(ValueError):
        R.mini_batch_kmeans(df.where(F.col("id") < 3), "id", "v", k=5)


def test_seeds_are_far_apart():
    x = np.vstack([np.zeros((50, 2)), np.ones((50, 2)) * 9, np.ones((1, 2)) * 99])
    assert {tuple(s) for s in R.plus_plus(x, 3, 1)} == {(0, 0), (9, 9), (99, 99)}
    assert len(R.plus_plus(np.zeros((4, 2)), 3, 1)) == 3
