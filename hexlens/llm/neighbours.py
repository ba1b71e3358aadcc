"""Op 3: approximate nearest neighbours by a forest of sorted hash strings.

Every tree writes a vector as a long string of bits, one for each random
hyperplane, and keeps the strings sorted.  A query descends each tree to its
longest matching prefix by binary search, then ascends all trees together, one
bit at a time, until the prefixes shared so far hold enough candidates; those
are scored exactly.

The rows are dealt into shards of a bounded number of vectors, each with a
forest of its own, and the stated query set, in blocks, visits every shard;
the shards' nearest are merged by query.  Copies of a vector are one leaf.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, STRING_BITS = 64, 32
#: Vectors of a shard on average, and queries of a block at most on average.
SHARD, BLOCK = 4096, 4096
#: Leaves, over all trees, that a query ascends to: this share of the shard's vectors, but so many at least.
SHARE, LEAST = 1.0, 4096
FOUND = "query_id long, vec_id long, score double"


class Forest:
    """Sorted arrays of hash strings over the rows of ``x``."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = STRING_BITS, seed: int = 11):
        self.bits = bits
        self.planes = np.random.default_rng(seed).normal(size=(x.shape[1], trees * bits))
        self.weights = (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64))
        codes = self.strings(x)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows) strings as integers, the first bit the highest."""
        out = []
        for t in range(0, self.planes.shape[1], self.bits):
            out.append(((x @ self.planes[:, t : t + self.bits]) > 0).astype(np.uint64) @ self.weights)
        return np.stack(out)

    def candidates(self, x: np.ndarray, wanted: int):
        """For each query, the rows under the deepest prefixes that hold ``wanted`` leaves over all trees."""
        q = self.strings(x)
        lo, hi = np.zeros(q.shape, np.int64), np.zeros(q.shape, np.int64)
        todo = np.arange(q.shape[1])
        for depth in range(self.bits, -1, -1):  # all trees ascend together
            low = np.uint64((1 << (self.bits - depth)) - 1)
            for t in range(len(q)):
                lo[t, todo] = np.searchsorted(self.sorted[t], q[t, todo] & ~low, side="left")
                hi[t, todo] = np.searchsorted(self.sorted[t], q[t, todo] | low, side="right")
            todo = todo[(hi[:, todo] - lo[:, todo]).sum(axis=0) < wanted]
            if not len(todo):
                break
        seen = np.zeros(self.sorted.shape[1], bool)
        for k in range(q.shape[1]):
            seen[:] = False
            for t in range(len(q)):
                seen[self.order[t, lo[t, k] : hi[t, k]]] = True
            yield np.flatnonzero(seen)


def cosine(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines in double precision; each depends on its own two vectors only, so copies score alike."""
    return (rows * q).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((q * q).sum()))


def vectors(col: pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = col.chunk(0) if col.num_chunks else pa.array([], pa.list_(pa.float64()))
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


def search_shard(rows: pa.Table, queries: pa.Table, k: int, share: float, least: int) -> pa.Table:
    out: list[tuple[int, int, float]] = []
    if rows.num_rows and queries.num_rows:
        rows = rows.sort_by("vec_id")
        ids = rows["vec_id"].to_numpy()
        own, inverse = np.unique(vectors(rows["v"]), axis=0, return_inverse=True)
        by_leaf = np.argsort(inverse, kind="stable")  # copies of a vector, smaller ids first
        first = np.concatenate(([0], np.cumsum(np.bincount(inverse, minlength=len(own)))))
        forest = Forest(own)
        asked, x = queries["vec_id"].to_numpy(), vectors(queries["v"])
        for a, leaves in enumerate(forest.candidates(x, max(int(share * len(own)), least))):
            s = cosine(own[leaves], x[a])
            best = []
            for i in np.lexsort((first[leaves], -s)):
                if len(best) >= k and s[i] < best[k - 1][0]:
                    break
                same = ids[by_leaf[first[leaves[i]] : first[leaves[i] + 1]]][: k + 1]
                best += [(s[i], v) for v in same if v != asked[a]]
                best = sorted(best, key=lambda p: (-p[0], p[1]))[:k]
            out += [(int(asked[a]), int(v), float(p)) for p, v in best]
    cols = list(zip(*out, strict=True)) if out else [[]] * 3
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())],
                    names=["query_id", "vec_id", "score"])


def nearest(table: DataFrame, every: int = 50, k: int = 5, shard: int = SHARD, share: float = SHARE, least: int = LEAST,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found by cosine for ids divisible by ``every``.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null id, take no part; vectors of another length than the
    query's aren't compared with it.  Ties go to the smaller id; rows with the
    query's own id aren't its neighbours; repeated rows are one neighbour.
    Other columns are not read; an empty table gives no rows.
    """
    v = F.col("v")
    rows = (table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
            .filter(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0))
            .dropDuplicates())
    n, n_q = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n_q // BLOCK))
    dim = F.size(v).alias("dim")
    shard_of = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard")
    block_of = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).alias("block")
    each = lambda count, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias(name)
    left = rows.select("vec_id", "v", dim, shard_of, each(blocks, "block")) if blocks > 1 else rows.select("vec_id", "v", dim, shard_of, F.lit(0).cast("long").alias("block"))
    right = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v", dim, block_of, each(shards, "shard"))
    key = ["dim", "shard", "block"]
    found = left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(
        lambda a, b: search_shard(a, b, k, share, least), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.dropDuplicates().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
