import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlens.functions.bytes import exploded_bytes, slice_histograms
from hexlens.operators import byte_stats as B

from reference_impl import block_entropies, entropy8, window_stats

CASES = {
    "empty": b"",
    "one": b"\x07",
    "two": b"\x01\xff",
    "three": b"abc",
    "nine": bytes(range(9)),
    "ten": bytes(range(10, 20)),
    "eleven": bytes(range(100, 111)),
    "all_equal": b"\x41" * 500,
    "uniform": bytes(range(256)),
    "random": bytes(np.random.default_rng(7).integers(0, 256, 5000, dtype=np.uint8)),
}


@pytest.fixture(scope="module")
def stats(spark):
    rows = [(k, v) for k, v in CASES.items()]
    df = spark.createDataFrame(rows, "name string, window binary")
    out = B.byte_statistics(df, "window").select("name", *B.STAT_NAMES).collect()
    return {r["name"]: [r[n] for n in B.STAT_NAMES] for r in out}


@pytest.mark.parametrize("case", list(CASES))
def test_49_statistics_match_numpy(stats, case):
    got = stats[case]
    want = window_stats(np.frombuffer(CASES[case], np.uint8))
    assert len(got) == 49
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def test_entropy_edges(stats):
    assert stats["empty"][11] == 0.0
    assert stats["all_equal"][11] == 0.0 and stats["all_equal"][1] == 0.0
    assert stats["uniform"][11] == pytest.approx(1.0) and stats["uniform"][0] == pytest.approx(127.5)
    for v in stats.values():
        assert 0.0 <= v[11] <= 1.0


def test_histogram_udf_matches_exploded_sql(spark):
    rows = [(i, v) for i, v in enumerate(CASES.values())]
    df = spark.createDataFrame(rows, "id int, content binary")
    h = B.byte_histogram(df, "content").select("id", F.posexplode("hist").alias("b", "c")).where("c > 0")
    sql_form = exploded_bytes(df, "content", ["id"]).groupBy("id", "b").agg(F.count(F.lit(1)).alias("c"))
    a = sorted((r.id, r.b, r.c) for r in h.collect())
    b = sorted((r.id, r.b, r.c) for r in sql_form.collect())
    assert a == b
    sums = {r.id: sum(r.hist) for r in B.byte_histogram(df, "content").collect()}
    assert sums == {i: len(v) for i, v in enumerate(CASES.values())}


def test_overlapping_and_out_of_range_slices(spark):
    data = bytes(range(50))
    df = spark.createDataFrame([(data,)], "c binary")
    starts = F.array(F.lit(0), F.lit(10), F.lit(5), F.lit(45), F.lit(60), F.lit(-5)).cast("array<int>")
    lens = F.array(F.lit(50), F.lit(10), F.lit(20), F.lit(20), F.lit(5), F.lit(3)).cast("array<int>")
    hs = df.select(slice_histograms("c", starts, lens).alias("h")).first().h
    arr = np.frombuffer(data, np.uint8)
    want = [arr[0:50], arr[10:20], arr[5:25], arr[45:50], arr[0:0], arr[0:0]]
    for got, w in zip(hs, want):
        assert list(got) == list(np.bincount(w, minlength=256))


def test_byte_window_skips_header_and_truncates(spark):
    df = spark.createDataFrame([(bytes(range(100)),), (b"short",)], "content binary")
    out = B.byte_window(df, "content", max_file_size=40).collect()
    assert out[0].window == bytes(range(8, 40)) and out[0].orig_length == 32
    assert out[1].window == b"" and out[1].orig_length == 0


def test_file_attributes_match_numpy(spark):
    rng = np.random.default_rng(3)
    blobs = [b"", b"x", bytes(rng.integers(0, 256, 3000, dtype=np.uint8)), bytes(rng.integers(0, 40, 25000, dtype=np.uint8))]
    df = spark.createDataFrame([(i, b, len(b)) for i, b in enumerate(blobs)], "id int, content binary, length long")
    for bound in (None, 10240):
        got = {r.id: r for r in B.file_attributes(df, sample_size=bound).collect()}
        check_attributes(got, blobs, bound)


def check_attributes(got, blobs, bound):
    for i, b in enumerate(blobs):
        s = np.frombuffer(b[:bound], np.uint8)
        ents = block_entropies(s)
        overall = entropy8(s)
        r = got[i]
        assert r.file_entropy_avg == pytest.approx(overall)
        assert r.file_entropy_min == pytest.approx(min(ents) if ents else overall)
        assert r.file_entropy_std == pytest.approx(float(np.std(ents)) if ents else 0.0)
        assert r.file_entropy_median == pytest.approx(float(np.median(ents)) if ents else 0.0)
        assert r.high_entropy_ratio == pytest.approx(sum(e > 0.8 for e in ents) / len(ents) if ents else 0.0)
        if len(ents) > 1:
            assert r.entropy_change_rate == pytest.approx(float(np.mean(np.abs(np.diff(ents)))))
        assert r.log_size == pytest.approx(np.log(len(b) + 1))
