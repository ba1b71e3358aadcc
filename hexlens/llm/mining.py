"""Op 11: hard negatives by a multiway hyperplane tree with distance ranges (GNAT).

With one more component, sqrt(M - |x|^2), all rows lie on a sphere, and a window
of inner products with an anchor is an annulus about it: the larger the product,
the nearer the row.  A node of the tree has several split points; each row goes to
the subtree of its nearest one, and each split point keeps the least and largest
distance to the rows of every subtree.  The distance of an anchor to one split
point then bounds its distance to all subtrees, and those whose range misses the
annulus are eliminated.  What is left is scored exactly in the leaves.

The root's split points are a bounded sample of the rows, its ranges are exact
over all rows.  Below it each task builds the tree of one shard, a bounded part of
a root cell, and searches it for a block of anchors at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexlens.llm.common import write_step

#: Split points of the root at most, and of the nodes below it; rows of a leaf at most.
ROOT, FAN, LEAF = 64, 16, 64
#: Rows of a shard on average, anchors of a block on average, and windows searched at once.
SHARD, BLOCK, AT_ONCE = 8192, 4096, 2048
#: Rows with a larger squared norm (of the integer components) have scores that needn't fit a long.
LARGEST_NORM = 2.0**56
NONE = -(1 << 62)
ITEM = "qid long, pos int, anchor_id long, label long, same boolean, lo long, hi long, dim int, v array<long>"
FOUND = "qid long, pos int, vec_id long, score long"


def matrix(col, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = col.chunk(0) if col.num_chunks else pa.array([], pa.list_(pa.int64()))
    return np.asarray(col.flatten(), np.int64).reshape(len(col), dim)


class Sphere:
    """Distances of rows and anchors on the sphere; ``slack`` covers their rounding."""

    def __init__(self, largest: float):
        self.m = float(largest) + 1.0
        self.slack = 1e-6 * np.sqrt(self.m)

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.m - (x * x).sum(axis=1), 0.0))])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of lifted rows."""
        return np.sqrt(np.maximum(2 * self.m - 2 * (a @ b.T), 0.0))

    def from_anchors(self, norms: np.ndarray, products: np.ndarray) -> np.ndarray:
        """Distances of anchors of these squared norms to rows with these inner products."""
        return np.sqrt(np.maximum(norms + self.m - 2.0 * products, 0.0))


def bounds(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance of each anchor to each subtree, from its distances to the split points."""
    least = np.maximum(d[:, :, None] - high[None], low[None] - d[:, :, None]).max(axis=1)
    return np.maximum(least, 0.0), (d[:, :, None] + high[None]).min(axis=1)


class Tree:
    """The tree of one shard."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, sphere: Sphere):
        self.x, self.ids, self.labels, self.sphere = x, ids, labels, sphere
        self.exact_floats = sphere.m < 2.0**53
        self.scored = x.astype(np.float64) if self.exact_floats else x
        self.lifted = sphere.lift(x)
        self.leaves_seen = 0
        self.root = self._node(np.arange(len(x)))

    def _split_points(self, rows: np.ndarray) -> np.ndarray:
        """Rows far from each other, out of an even sample."""
        some = rows[np.unique(np.linspace(0, len(rows) - 1, 4 * FAN).astype(int))]
        d = self.sphere.between(self.lifted[some], self.lifted[some])
        picked = [0]
        near = d[0].copy()
        while len(picked) < FAN and near.max() > self.sphere.slack:
            picked.append(int(near.argmax()))
            near = np.minimum(near, d[picked[-1]])
        return some[picked]

    def _node(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        points = self._split_points(rows)
        d = self.sphere.between(self.lifted[points], self.lifted[rows])
        own = d.argmin(axis=0)
        parts = [rows[own == j] for j in range(len(points))]
        if max(map(len, parts)) == len(rows):
            return rows  # copies of one vector
        full = [j for j in range(len(points)) if len(parts[j])]
        low = np.stack([d[:, own == j].min(axis=1) for j in full], axis=1)
        high = np.stack([d[:, own == j].max(axis=1) for j in full], axis=1)
        return self.x[points], low, high, [self._node(parts[j]) for j in full]

    def search(self, q: "Windows") -> None:
        self._visit(self.root, np.arange(len(q.norms)), q)

    def _visit(self, node, items: np.ndarray, q: "Windows") -> None:
        if isinstance(node, np.ndarray):
            self.leaves_seen += len(items)
            for s in range(0, len(node), 4 * LEAF):
                q.take(items, node[s : s + 4 * LEAF], self)
            return
        points, low, high, children = node
        d = self.sphere.from_anchors(q.norms[items, None], q.x[items].astype(np.float64) @ points.T.astype(np.float64))
        least, most = bounds(d, low, high)
        first = least.argmin(axis=1)  # the likeliest subtree of each anchor, then the rest with narrower windows
        for nearest in (True, False):
            for j, child in enumerate(children):
                alive = (least[:, j] <= q.outer[items] + self.sphere.slack) & (most[:, j] >= q.inner[items] - self.sphere.slack)
                alive &= (first == j) == nearest
                if alive.any():
                    self._visit(child, items[alive], q)


class Windows:
    """Windows of scores about anchors, with the ``k`` best rows found for each so far."""

    def __init__(self, t: pa.Table, dim: int, k: int, sphere: Sphere):
        self.x, self.k, self.sphere = matrix(t["v"], dim), k, sphere
        self.norms = (self.x.astype(np.float64) ** 2).sum(axis=1)
        self.own, self.label = t["anchor_id"].to_numpy(), t["label"].to_numpy()
        self.same = t["same"].to_numpy(zero_copy_only=False) if isinstance(t["same"], pa.Array) else t["same"].to_numpy()
        self.lo, self.hi = t["lo"].to_numpy(), t["hi"].to_numpy()
        self.scores = np.full((len(self.x), k), NONE, np.int64)
        self.ids = np.full((len(self.x), k), np.iinfo(np.int64).max, np.int64)
        self.inner = sphere.from_anchors(self.norms, self.hi.astype(np.float64))
        self.outer = sphere.from_anchors(self.norms, self.lo.astype(np.float64))

    def take(self, items: np.ndarray, rows: np.ndarray, tree: Tree) -> None:
        """Score the rows of a leaf for these windows."""
        if tree.exact_floats:
            s = (self.x[items].astype(np.float64) @ tree.scored[rows].T).astype(np.int64)
        else:
            s = self.x[items] @ tree.scored[rows].T
        worst = self.scores[items, -1]
        ok = (s >= np.maximum(self.lo[items], worst)[:, None]) & (s <= self.hi[items, None])
        ok &= (tree.labels[rows][None] == self.label[items, None]) == self.same[items, None]
        ok &= tree.ids[rows][None] != self.own[items, None]
        some = ok.any(axis=1)
        if not some.any():
            return
        items, s, ok = items[some], s[some], ok[some]
        score = np.concatenate([self.scores[items], np.where(ok, s, NONE)], axis=1)
        ids = np.concatenate([self.ids[items], np.broadcast_to(tree.ids[rows], s.shape)], axis=1)
        best = np.lexsort((ids, -score), axis=1)[:, : self.k]
        self.scores[items] = np.take_along_axis(score, best, axis=1)
        self.ids[items] = np.take_along_axis(ids, best, axis=1)
        full = items[self.scores[items, -1] > NONE]
        self.outer[full] = self.sphere.from_anchors(self.norms[full], self.scores[full, -1].astype(np.float64))


def search_shard(rows: pa.Table, items: pa.Table, k: int, largest: float) -> pa.Table:
    out = []
    if rows.num_rows and items.num_rows:
        dim, sphere = items["dim"][0].as_py(), Sphere(largest)
        x, ids, labels = matrix(rows["v"], dim), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        kept = np.unique(np.column_stack([ids, labels, x]), axis=0)  # repeated rows are one
        tree = Tree(np.ascontiguousarray(kept[:, 2:]), kept[:, 0].copy(), kept[:, 1].copy(), sphere)
        for s in range(0, items.num_rows, AT_ONCE):
            part = items.slice(s, AT_ONCE).combine_chunks()
            q = Windows(part, dim, k, sphere)
            tree.search(q)
            i, j = np.nonzero(q.scores > NONE)
            out.append([part["qid"].to_numpy()[i], part["pos"].to_numpy()[i], q.ids[i, j], q.scores[i, j]])
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.table([pa.array(c.astype(np.int64)).cast(t) for c, t in zip(cols, types, strict=True)], names=["qid", "pos", "vec_id", "score"])


class Index:
    """Rows dealt into the cells of the root and their shards, as a written table."""

    def __init__(self, points: DataFrame, shard: int):
        n, largest = points.agg(F.count("*"), F.max("norm")).first()
        self.largest = largest or 0.0
        wanted = min(ROOT, max(1, -(-n // shard)))
        sample = points.select("dim", "v", F.xxhash64("vec_id", F.lit(17)).alias("h")).orderBy("h", "dim", "v").limit(wanted).collect()
        self.roots: dict[int, np.ndarray] = {}
        for dim in {r.dim for r in sample} - {0}:
            self.roots[dim] = np.unique(np.array([r.v for r in sample if r.dim == dim], np.int64).reshape(-1, dim), axis=0)
        roots, sphere = self.roots, Sphere(self.largest)

        def place(batches):
            for b in batches:
                dims = b.column("dim").to_numpy()
                cell = np.full(len(dims), -1, np.int32)  # rows of a length that no split point has
                for dim in set(dims.tolist()) & set(roots):
                    at = np.flatnonzero(dims == dim)
                    x = matrix(b.column("v").take(pa.array(at)), dim)
                    cell[at] = sphere.between(sphere.lift(x), sphere.lift(roots[dim])).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["vec_id", "label", "dim", "v", "cell"])

        self.rows, self.path = write_step(points.select("vec_id", "label", "dim", "v").mapInArrow(
            place, "vec_id long, label long, dim int, v array<long>, cell int"), "mining-rows")
        largest_cell = self.rows.groupBy("dim", "cell").count().agg(F.max("count")).first()[0] or 0
        self.subs = max(1, -(-largest_cell // shard))

        def span(batches):
            for b in batches:
                dims, cells, out = b.column("dim").to_numpy(), b.column("cell").to_numpy(), []
                for dim in set(dims.tolist()) & set(roots):
                    at = np.flatnonzero(dims == dim)
                    d = sphere.between(sphere.lift(roots[dim]), sphere.lift(matrix(b.column("v").take(pa.array(at)), dim)))
                    for c in np.unique(cells[at]):
                        own = d[:, cells[at] == c]
                        out += [(dim, int(c), i, float(a), float(z)) for i, (a, z) in enumerate(zip(own.min(axis=1), own.max(axis=1), strict=True))]
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                types = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["dim", "cell", "point", "low", "high"])

        spans = self.rows.select("dim", "v", "cell").mapInArrow(span, "dim int, cell int, point int, low double, high double")
        #: least and largest distances of split points to cells: ROOT * ROOT at most
        self.ranges = {dim: (np.full((len(p), len(p)), np.inf), np.zeros((len(p), len(p)))) for dim, p in roots.items()}
        for r in spans.groupBy("dim", "cell", "point").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            self.ranges[r.dim][0][r.point, r.cell], self.ranges[r.dim][1][r.point, r.cell] = r.low, r.high

    def search(self, items: DataFrame, blocks: int, k: int) -> DataFrame:
        """qid, pos, rank, vec_id, score: the ``k`` best rows in each item's window."""
        roots, ranges, largest = self.roots, self.ranges, self.largest
        names = [f.split()[0] for f in ITEM.split(", ")]

        def route(batches):
            sphere = Sphere(largest)
            for b in batches:
                dims, cells = b.column("dim").to_numpy(), [[-1]] * b.num_rows
                for dim in set(dims.tolist()) & set(roots):
                    at = np.flatnonzero(dims == dim)
                    t = pa.Table.from_batches([b.take(pa.array(at))])
                    q = Windows(t, dim, k, sphere)
                    low, high = ranges[dim]
                    d = sphere.from_anchors(q.norms[:, None], q.x.astype(np.float64) @ roots[dim].T.astype(np.float64))
                    least, most = bounds(d, np.where(np.isinf(low), 0.0, low), high)
                    alive = (least <= q.outer[:, None] + sphere.slack) & (most >= q.inner[:, None] - sphere.slack) & ~np.isinf(low).any(axis=0)
                    for i, a in zip(at, alive, strict=True):
                        cells[i] = np.flatnonzero(a).tolist()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], [*names, "cells"])

        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        right = (items.select(*names).mapInArrow(route, ITEM + ", cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")
                 .withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("sub", each(self.subs)))
        left = (self.rows.withColumn("sub", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(self.subs)).cast("int"))
                .withColumn("block", each(blocks) if blocks > 1 else F.lit(0)))
        key = ["dim", "cell", "sub", "block"]
        found = left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(lambda a, b: search_shard(a, b, k, largest), FOUND)
        best = Window.partitionBy("qid", "pos").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(table: DataFrame, every: int = 100, shift_every: int | None = None, positives: int = 5, negatives: int = 5, low_percent: int = 80,
         shard: int = SHARD, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(256 * x); scores are integer inner products, higher first,
    ties by smaller id.  Anchors are the rows whose id is divisible by ``every``; an
    anchor's positives are its first ``positives`` other rows of its label; for each,
    the first ``negatives`` rows of another label whose score is ``low_percent`` to 100
    per cent of the positive's.  Where the id is divisible by ``shift_every``, the
    label is first (label + 1) % 10.

    Rows with a null id, label or vector, or a null or non-finite component, take no
    part, nor do rows whose integer components have squares that add up to more than
    2**56, for scores must fit a long.  Vectors of another length aren't compared.
    Repeated rows are one row; rows of the anchor's own id are neither its positives
    nor its negatives.  Other columns are not read; an empty table gives no rows.
    """
    v = F.col("v")
    label = F.col(label_col).cast("long")
    given = (table.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
             .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull())
             .filter(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
             .withColumn("f", F.transform(v, lambda c: F.lit(256.0) * c))
             .withColumn("norm", F.aggregate("f", F.lit(0.0), lambda s, c: s + F.pow(F.abs(c) + 1, F.lit(2.0))))
             .filter(F.col("norm") <= LARGEST_NORM))
    if shift_every:
        given = given.withColumn("label", F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    points = given.select("vec_id", "label", "norm", F.size("f").alias("dim"), F.transform("f", lambda c: F.floor(c).cast("long")).alias("v"))
    index = Index(points, shard)
    anchors, _ = write_step(index.rows.filter(F.col("vec_id") % every == 0).select("vec_id", "label", "dim", "v").dropDuplicates()
                            .withColumn("qid", F.monotonically_increasing_id()), "mining-anchors")
    blocks = max(1, -(-anchors.count() // block))
    item = ["qid", F.col("vec_id").alias("anchor_id"), "label", "dim", "v"]
    first = anchors.select(*item, F.lit(0).alias("pos"), F.lit(True).alias("same"), F.lit(NONE).alias("lo"), F.lit(-NONE).alias("hi"))
    nearest, _ = write_step(index.search(first, blocks, positives).select(
        "qid", F.col("rank").cast("int").alias("pos"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "mining-positives")
    # 100 * negative >= low_percent * positive, in whole numbers; nothing fits under a negative positive score
    p = F.col("positive_score")
    windows = nearest.join(anchors, "qid").select(
        *item, "pos", F.lit(False).alias("same"), F.ceil(F.expr(f"({low_percent} * positive_score) / 100BD")).cast("long").alias("lo"), p.alias("hi")).filter("lo <= hi")
    hard = index.search(windows, blocks, negatives).select("qid", "pos", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (hard.join(nearest, ["qid", "pos"]).join(anchors.select("qid", F.col("vec_id").alias("anchor_id")), "qid")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
