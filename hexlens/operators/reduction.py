"""Principal components by a randomised range finder, and mini-batch k-means.

Both send small sums through the shuffle and never a table: PCA the products of
the rows with a thin matrix, cut into chunks that meet in tasks of their own;
k-means the sums and counts of one batch's rows by centre.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexlens import config as C
from hexlens.session import materialize

#: Columns of a chunk of summed matrix rows; extra directions of the range finder; its power steps.
CHUNK, EXTRA, STEPS = 64, 10, 6
#: Rows of a batch on average, batches, and rows of the sample that centres are seeded from, at most about.
BATCH, ITERATIONS, SEED_ROWS = 4096, 100, 20_000


def rows_of(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def summed(rows: DataFrame, width: int, product, cols: int) -> np.ndarray:
    """The sum over all Arrow batches of ``product(x)``, a (width, cols) matrix; chunks of its rows are added up apart."""
    def partial(batches):
        total = np.zeros((width, cols))
        for b in batches:
            if b.num_rows:
                total += product(rows_of(b.column(0), width))
        starts = range(0, width, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([total[s : s + CHUNK].tobytes() for s in starts], pa.binary())], ["chunk", "m"])

    def meet(t: pa.Table) -> pa.Table:
        m = sum(np.frombuffer(x, np.float64) for x in t["m"].to_pylist())
        return pa.table({"chunk": t["chunk"][:1], "m": pa.array([m.tobytes()], pa.binary())})

    out = np.zeros((width, cols))
    for r in rows.mapInArrow(partial, "chunk int, m binary").groupBy("chunk").applyInArrow(meet, "chunk int, m binary").toLocalIterator():
        own = np.frombuffer(bytes(r.m), np.float64).reshape(-1, cols)
        out[r.chunk : r.chunk + len(own)] = own
    return out


@dataclass
class Components:
    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray        # (width, k), orthonormal columns
    variance: np.ndarray    # of the standardised rows along each
    share: np.ndarray       # of their whole variance

    def project(self, df: DataFrame, vec: str, out: str = "projection", plane: str | None = None) -> DataFrame:
        """Adds the row's coordinates, and its first two as ``plane`` if named; a null vector has none."""
        axes, mean, scale, width = self.axes, self.mean, self.scale, len(self.mean)

        @F.pandas_udf("array<double>")
        def coordinates(v):
            import pandas as pd
            ok = [k for k, x in enumerate(v) if x is not None and len(x) == width]
            res = [None] * len(v)
            if ok:
                z = (np.stack([np.asarray(v.iloc[k], np.float64) for k in ok]) - mean) / scale @ axes
                for k, x in zip(ok, z, strict=True):
                    res[k] = x.tolist()
            return pd.Series(res)

        df = df.withColumn(out, coordinates(F.col(vec).cast("array<double>")))
        return df.withColumn(plane, F.slice(out, 1, 2)) if plane else df


def principal_components(df: DataFrame, vec: str, k: int, steps: int = STEPS, extra: int = EXTRA, seed: int = C.DEFAULT_RANDOM_STATE) -> Components:
    """The first ``k`` components of the standardised rows (population deviation, 1 for a constant column).

    Rows whose vector is null or of another length than the first are left out;
    the sign of a component is that which makes its largest weight positive.
    """
    rows = df.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("x"))
    first = rows.first()
    if first is None or not first.x:
        raise ValueError("no rows to take components of")
    width = len(first.x)
    rows = rows.where(F.size("x") == width)
    k, l = min(k, width), min(k + extra, width)
    n = rows.count()
    mean = summed(rows, width, lambda x: x.sum(axis=0)[:, None], 1)[:, 0] / n
    scale = np.sqrt(summed(rows, width, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None], 1)[:, 0] / n)
    varies = scale > 0
    scale[~varies] = 1.0
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, l)))[0]

    def applied(q: np.ndarray) -> np.ndarray:
        def product(x):
            z = (x - mean) / scale
            return z.T @ (z @ q)
        return summed(rows, width, product, l) / n
    for _ in range(steps):
        q = np.linalg.qr(applied(q))[0]
    small = q.T @ applied(q)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-value)[:k]
    axes = q @ vector[:, order]
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    whole = float(varies.sum())  # each column that isn't constant has variance 1
    variance = np.maximum(value[order], 0.0)
    return Components(mean, scale, axes, variance, variance / whole if whole else variance)


def plus_plus(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ seeding: each centre drawn by the squared distance to those before."""
    rng = np.random.default_rng(seed)
    out = [x[rng.integers(len(x))]]
    near = ((x - out[0]) ** 2).sum(axis=1)
    while len(out) < k:
        total = near.sum()
        out.append(x[rng.choice(len(x), p=near / total)] if total > 0 else x[rng.integers(len(x))])
        near = np.minimum(near, ((x - out[-1]) ** 2).sum(axis=1))
    return np.stack(out)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest centre (ties to the first) and its squared distance."""
    d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None], 0.0)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


@dataclass
class MiniBatches:
    centres: np.ndarray
    seeds: np.ndarray
    counts: np.ndarray

    def assign(self, df: DataFrame, vec: str, out: str = "cluster_id", distance: str | None = None) -> DataFrame:
        """Adds each row's centre, and the squared distance to it if named."""
        centres = self.centres

        @F.pandas_udf("cluster int, distance double")
        def own(v):
            import pandas as pd
            x = np.stack([np.asarray(r, np.float64) for r in v]) if len(v) else np.zeros((0, centres.shape[1]))
            at, d = nearest(x, centres)
            return pd.DataFrame({"cluster": at.astype(np.int32), "distance": d})

        df = df.withColumn("_own", own(F.col(vec).cast("array<double>"))).withColumn(out, F.col("_own.cluster"))
        return (df.withColumn(distance, F.col("_own.distance")) if distance else df).drop("_own")


def batches_of(df: DataFrame, key: str, vec: str, n: int, batch: int, iterations: int, seed: int) -> DataFrame:
    """batch, x: every batch takes each row with probability batch / n, by a hash of its key."""
    share = int(min(1.0, batch / max(n, 1)) * (1 << 30))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(iterations - 1)), lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col(key)), F.lit(1 << 30)) < share)
    return df.select(F.col(key).alias("key"), F.explode(drawn).alias("batch"), F.col(vec).cast("array<double>").alias("x"))


def mini_batch_kmeans(df: DataFrame, key: str, vec: str, k: int = C.KMEANS_N_CLUSTERS, batch: int = BATCH, iterations: int = ITERATIONS,
                      seed: int = C.DEFAULT_RANDOM_STATE, sample: int = SEED_ROWS) -> MiniBatches:
    """Centres moved by one batch after another, each at a rate of one over the rows it has had.

    Seeds come from about ``sample`` rows at most; fewer rows than ``k`` raise.
    """
    rows = df.where(F.col(vec).isNotNull())
    n = rows.count()
    if n < k:
        raise ValueError(f"{n} rows for {k} clusters")
    share = int(min(1.0, sample / n) * (1 << 30))
    some = rows.where(F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(1 << 30)) < share).select(F.xxhash64(key).alias("h"), F.col(vec).cast("array<double>").alias("x"))
    x = np.array([r.x for r in some.orderBy("h", "x").limit(max(sample, k)).collect()], np.float64)
    if len(x) < k:
        raise ValueError(f"a sample of {len(x)} rows for {k} clusters")
    centres = plus_plus(x, k, seed)
    seeds, counts, width = centres.copy(), np.zeros(k), x.shape[1]
    drawn = materialize(batches_of(rows, key, vec, n, batch, iterations, seed).repartition("batch"), "kmeans-batches")
    for t in range(iterations):
        now = centres

        def partial(batches, now=now):
            total = np.zeros((k, width + 1))
            for b in batches:
                if b.num_rows:
                    x = rows_of(b.column(0), width)
                    at, _ = nearest(x, now)
                    np.add.at(total, at, np.column_stack([x, np.ones(len(x))]))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

        got = drawn.where(F.col("batch") == t).select("x").mapInArrow(partial, "m binary").collect()  # one batch's sums, k rows wide
        total = sum((np.frombuffer(bytes(r.m), np.float64).reshape(k, -1) for r in got), np.zeros((k, width + 1)))
        new = counts + total[:, -1]
        moved = total[:, -1] > 0
        centres = centres.copy()
        centres[moved] = (centres[moved] * counts[moved, None] + total[moved, :-1]) / new[moved, None]
        counts = new
    return MiniBatches(centres, seeds, counts)
