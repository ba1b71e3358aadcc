import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from hexlens.llm import mining, queries

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, shift=7, positives=5, negatives=5):
    own = set()
    for i, v, y in rows:
        if i is None or v is None or y is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        own.add((i, (y + 1) % 10 if shift and i % shift == 0 else y, tuple(math.floor(256 * float(np.float32(c))) for c in v)))
    out = set()
    for a, y, v in own:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, u)), i, z) for i, z, u in own if i != a and len(u) == len(v))
        for s, i, _ in [x for x in scored if x[2] == y][:positives]:
            hard = [x for x in scored if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out |= {(a, i, n, j, -s, -t) for n, (t, j, _) in enumerate(hard, 1)}
    return out


def vectors(seed, n, dim=8, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(k, [c + r.gauss(0, spread) for c in r.choice(centres)], r.randrange(4)) for k in range(n)]


def rows_of(df):
    got = [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("shard,block", [(8192, 4096), (120, 3)])
def test_against_brute_force_with_odd_rows(spark, shard, block):
    rows = vectors(1, 900, spread=0.3)
    hot = rows[5][1]
    rows += [(k, hot, k % 3) for k in range(2000, 2300)]  # copies of a vector with other ids
    rows += [rows[100], rows[200], (None, hot, 1), (3000, None, 1), (3100, [1.0, None] + [0.0] * 6, 1), (3200, [float("nan")] * 8, 1), (3300, hot, None),
             (3400, [float("inf")] * 8, 1), (3500, [], 1), (3501, [], 2), (3600, [1.0, 2.0], 1), (3601, [1.0, 2.0], 1), (3603, [0.9, 2.0], 2), (3700, [0.0] * 8, 1),
             (3800, [3e38] * 8, 1)]
    d = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as v", "2 as cell", "3 as qid", "4 as norm").repartition(4)
    rows = [x for x in rows if x[0] != 3800]  # too large for a long
    assert rows_of(mining.mine(d, shift_every=7, shard=shard, block=block)) == brute(rows)


def test_other_numbers_and_an_empty_table(spark):
    rows = vectors(2, 300, dim=3)
    d = spark.createDataFrame(rows, VECTORS)
    assert rows_of(mining.mine(d, every=30, positives=2, negatives=3)) == brute(rows, 30, None, 2, 3)
    assert mining.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert mining.mine(spark.createDataFrame([(1, [0.5], 1)], VECTORS)).count() == 0


@pytest.mark.parametrize("size", [17, 19])  # in floats, and beyond them
def test_large_components_are_exact(spark, size):
    rows = [(k, [float(2**size + k), 1.0 + k, -2.0], k % 2) for k in range(240)]
    assert rows_of(mining.mine(spark.createDataFrame(rows, VECTORS), shift_every=7)) == brute(rows)


def test_the_query_and_its_sql_on_driver_vectors(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows)
    assert rows_of(queries.op11_hard_negatives(spark, folder)) == want
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    assert set(con.sql(queries.OP11_SQL).fetchall()) == want


def test_ranges_eliminate_subtrees_of_structured_rows():
    r = np.random.default_rng(3)
    x = np.floor(256 * (np.repeat(r.normal(size=(20, 8)) * 4, 200, axis=0) + r.normal(size=(4000, 8)) * 0.1)).astype(np.int64)
    labels = np.arange(4000) % 5
    sphere = mining.Sphere(float((x.astype(float) ** 2).sum(axis=1).max()))
    tree = mining.Tree(x, np.arange(4000), labels, sphere)
    some = np.arange(0, 4000, 100)
    t = pa.table({"v": pa.array(x[some].tolist(), pa.list_(pa.int64())), "anchor_id": some, "label": labels[some], "same": [True] * 40, "lo": [mining.NONE] * 40, "hi": [-mining.NONE] * 40}).combine_chunks()
    q = mining.Windows(t, 8, 5, sphere)
    tree.search(q)
    for k, a in enumerate(some):
        want = sorted((-int(x[a] @ x[i]), i) for i in range(4000) if i != a and labels[i] == labels[a])[:5]
        assert [(-s, i) for s, i in zip(q.scores[k], q.ids[k])] == want

    def leaves(node):
        return 1 if isinstance(node, np.ndarray) else sum(map(leaves, node[3]))
    assert tree.leaves_seen < 0.5 * 40 * leaves(tree.root)
