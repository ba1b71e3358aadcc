"""Per-file byte statistics.

All operators are narrow (no shuffle): each output row depends on one input
file.  Slice bounds are Catalyst expressions, one Arrow call per batch counts
bytes for every slice of every file, and the combination of slice summaries
(differences, block percentiles, ratios) is Catalyst again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexlens import config as C
from hexlens.functions.bytes import slice_histograms, slice_profiles

STAT_NAMES = (
    ["mean", "std", "min", "max", "median", "q25", "q75",
     "count_zero", "count_ff", "count_nop", "count_printable", "entropy"]
    + [f"third{i}_{s}" for i in range(3) for s in ("mean", "std", "entropy")]
    + [f"chunk{i}_mean" for i in range(C.STAT_CHUNK_COUNT)]
    + [f"chunk{i}_std" for i in range(C.STAT_CHUNK_COUNT)]
    + [f"chunk_mean_diff_{s}" for s in ("abs_mean", "std", "max", "min")]
    + [f"chunk_std_diff_{s}" for s in ("abs_mean", "std", "max", "min")]
)
assert len(STAT_NAMES) == C.STAT_FEATURE_DIM

FILE_ATTR_NAMES = ["size", "log_size", "file_entropy_avg", "file_entropy_min", "file_entropy_max",
                   "file_entropy_range", "file_entropy_std", "file_entropy_q25", "file_entropy_q75",
                   "file_entropy_median", "high_entropy_ratio", "low_entropy_ratio",
                   "entropy_change_rate", "entropy_change_std", "zero_byte_ratio",
                   "printable_byte_ratio"]


def _col(c):
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# S3 byte window
# ---------------------------------------------------------------------------

def byte_window(df: DataFrame, content: str = "content", max_file_size: int | None = None,
                pad: bool = False) -> DataFrame:
    """Skip the first 8 bytes; keep all others, or at most ``max_file_size - 8`` of them.

    Adds ``window binary`` and ``orig_length int`` (real bytes kept).  With
    ``pad=True`` the window is zero padded to ``max_file_size`` like the
    stored samples; statistics always use the unpadded window.
    """
    if pad and max_file_size is None:
        raise ValueError("padding needs max_file_size")
    keep = (1 << 31) - 1 if max_file_size is None else max_file_size - C.HEADER_SKIP
    w = F.substring(_col(content), C.HEADER_SKIP + 1, keep)
    out = df.withColumn("window", F.coalesce(w, F.lit(b"").cast("binary")))
    out = out.withColumn("orig_length", F.length("window").cast("int"))
    if pad:
        out = out.withColumn("padded", F.concat("window", F.unhex(F.repeat(F.lit("00"), F.lit(max_file_size) - F.col("orig_length")))))
    return out


# ---------------------------------------------------------------------------
# slice layouts (W2: equal blocks, remainder to the last block)
# ---------------------------------------------------------------------------

def _stat_slices(n: Column, base: int = 0):
    """Bounds of whole, 3 thirds and 10 chunks of an n-byte window that begins at ``base``."""
    t = F.floor(n / 3).cast("int")
    short = n < 3
    third_s = [F.lit(0), F.when(short, 0).otherwise(t), F.when(short, 0).otherwise(2 * t)]
    third_l = [F.when(short, n).otherwise(t), F.when(short, n).otherwise(t),
               F.when(short, n).otherwise(n - 2 * t)]
    cs = F.greatest(F.lit(1), F.floor(n / C.STAT_CHUNK_COUNT).cast("int"))
    last = C.STAT_CHUNK_COUNT - 1
    chunk_s = [cs * i for i in range(C.STAT_CHUNK_COUNT)]
    chunk_l = [cs for _ in range(last)] + [n - cs * last]
    starts = F.array(*[x + base if base else x for x in (F.lit(0), *third_s, *chunk_s)]).cast("array<int>")
    lens = F.array(n, *third_l, *chunk_l).cast("array<int>")
    return starts, lens


def _with_diff_stats(df: DataFrame, groups: list[tuple[Column, list[str], str]]) -> DataFrame:
    """Mean |d|, population std, max, min of consecutive differences.

    Values are rounded to float32 first and differenced in float32, as the
    reference does; the four summaries are then taken in double.  The
    difference arrays and their means are materialised as columns first (one
    projection per level for all groups), so each higher-order function runs
    once per row.
    """
    out = df.withColumns({tmp + "_v": values for values, _, tmp in groups})

    def diffs(v):
        return F.transform(F.sequence(F.lit(1), F.size(v) - 1),
                           lambda i: (F.element_at(v, i + 1) - F.element_at(v, i)).cast("double"))

    out = out.withColumns({tmp + "_d": diffs(F.col(tmp + "_v")) for _, _, tmp in groups})
    out = out.withColumns({tmp + "_m": F.aggregate(F.col(tmp + "_d"), F.lit(0.0), lambda a, x: a + x)
                           / F.size(F.col(tmp + "_d")) for _, _, tmp in groups})
    stats = {}
    for _, names, tmp in groups:
        d, mean, m = F.col(tmp + "_d"), F.col(tmp + "_m"), F.size(F.col(tmp + "_d"))
        vals = [F.aggregate(d, F.lit(0.0), lambda a, x: a + F.abs(x)) / m,
                F.sqrt(F.aggregate(d, F.lit(0.0), _sq_dev(mean)) / m),
                F.array_max(d), F.array_min(d)]
        stats.update({n: v.cast("double") for n, v in zip(names, vals)})
    out = out.withColumns(stats)
    return out.drop(*[tmp + sfx for _, _, tmp in groups for sfx in ("_v", "_d", "_m")])


def _sq_dev(mean: Column):
    return lambda a, x: a + (x - mean) * (x - mean)


def window_slices(n: Column, base: int = 0):
    """Bounds of the 14 slices behind the 49 statistics of a window that begins at ``base``."""
    return _stat_slices(n, base)


WINDOW_SLICES = 1 + 3 + C.STAT_CHUNK_COUNT


def stats_from_profiles(df: DataFrame, prof: str, first: int = 0, prefix: str = "") -> DataFrame:
    """The 49 statistics from 14 slice profiles starting at index ``first`` of ``prof``."""
    p = lambda i: F.col(prof)[first + i]
    whole = p(0)
    cols = [whole["mean"], whole["std"], whole["min"], whole["max"], whole["median"], whole["q25"],
            whole["q75"], whole["zeros"].cast("double"), whole["ffs"].cast("double"),
            whole["nops"].cast("double"), whole["printable"].cast("double"), whole["entropy"]]
    for i in range(3):
        cols += [p(1 + i)["mean"], p(1 + i)["std"], p(1 + i)["entropy"]]
    cols += [p(4 + i)["mean"] for i in range(C.STAT_CHUNK_COUNT)]
    cols += [p(4 + i)["std"] for i in range(C.STAT_CHUNK_COUNT)]
    n_direct = len(cols)
    out = df.select("*", *[c.cast("double").alias(prefix + name) for c, name in zip(cols, STAT_NAMES)])
    chunk_means = F.array(*[F.col(prefix + f"chunk{i}_mean").cast("float") for i in range(C.STAT_CHUNK_COUNT)])
    chunk_stds = F.array(*[F.col(prefix + f"chunk{i}_std").cast("float") for i in range(C.STAT_CHUNK_COUNT)])
    out = _with_diff_stats(out, [(chunk_means, [prefix + n for n in STAT_NAMES[n_direct:n_direct + 4]], "_cmd"),
                                 (chunk_stds, [prefix + n for n in STAT_NAMES[n_direct + 4:]], "_csd")])
    return out.withColumn(prefix + "stats", F.array(*[F.col(prefix + n).cast("float") for n in STAT_NAMES]))


def byte_statistics(df: DataFrame, window: str = "window", prefix: str = "") -> DataFrame:
    """The 49 window statistics as named double columns plus ``stats array<float>``."""
    n = F.length(_col(window)).cast("int")
    starts, lens = _stat_slices(n)
    out = df.withColumn("_prof", slice_profiles(_col(window), starts, lens))
    return stats_from_profiles(out, "_prof", 0, prefix).drop("_prof")


# ---------------------------------------------------------------------------
# A8-A10 file attributes over the first 10240 bytes
# ---------------------------------------------------------------------------

def _quantile_sorted(sorted_arr: Column, k: Column, q: float) -> Column:
    """numpy-style linear-interpolated quantile of a sorted array of length k."""
    pos = (k - 1) * F.lit(q)
    lo = F.floor(pos).cast("int")
    hi = F.least(lo + 1, k - 1)
    v0 = F.element_at(sorted_arr, lo + 1)
    v1 = F.element_at(sorted_arr, hi + 1)
    return v0 + (v1 - v0) * (pos - lo)


def block_layout(m: Column, block_size: int = C.ENTROPY_BLOCK_SIZE, max_blocks: int | None = C.ENTROPY_MAX_BLOCKS,
                 stride: bool = False):
    """(starts, lens, count) of the entropy blocks of an m-byte sample.

    Python profile (W2): ``k = min(10, max(1, m // 2048))`` equal blocks of
    ``m // k`` bytes, the last taking the remainder.  Native profile (W3):
    fixed 2048-byte stride blocks, all of them or at most ``max_blocks``.
    """
    if stride:
        k = F.ceil(m / block_size).cast("int")
        k = k if max_blocks is None else F.least(F.lit(max_blocks), k)
        idx = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.transform(idx, lambda i: i * block_size)
        lens = F.transform(idx, lambda i: F.least(F.lit(block_size), m - i * block_size))
        return starts, lens, k
    k = F.when(m > 0, F.least(F.lit(max_blocks), F.greatest(F.lit(1), F.floor(m / block_size).cast("int")))).otherwise(0)
    bs = F.when(k > 0, F.floor(m / k).cast("int")).otherwise(0)
    idx = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.transform(idx, lambda i: i * bs)
    lens = F.transform(idx, lambda i: F.when(i < k - 1, bs).otherwise(m - i * bs))
    return starts, lens, k


def attr_slices(m: Column, sample_size: int | None = None, stride_blocks: bool = False):
    """(starts, lens, k): the whole content of m bytes (or its first ``sample_size``), then its k blocks."""
    m = (m if sample_size is None else F.least(m, F.lit(sample_size))).cast("int")
    b_starts, b_lens, k = block_layout(m, stride=stride_blocks, max_blocks=None if stride_blocks and sample_size is None else C.ENTROPY_MAX_BLOCKS)
    return F.concat(F.array(F.lit(0)), b_starts), F.concat(F.array(m), b_lens), k


def attrs_from_profiles(df: DataFrame, prof_col: str, first: int | Column, k: Column, size: str = "length") -> DataFrame:
    """size, log_size and the 14 entropy/ratio features from 1 + k profiles at ``first``."""
    prof = F.col(prof_col)
    kk = F.col("_fa_k")
    out = df.withColumn("_fa_k", k)
    out = out.withColumn("_fa_e", F.transform(F.slice(prof, first + 2, kk), lambda s: s["entropy"]))
    ents = F.col("_fa_e")
    steps = F.when(kk > 1, F.sequence(F.lit(1), kk - 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumns({
        "_fa_mean": F.when(kk > 0, F.aggregate(ents, F.lit(0.0), lambda a, x: a + x) / kk),
        "_fa_d": F.transform(steps, lambda i: F.element_at(ents, i + 1) - F.element_at(ents, i)),
        "_fa_srt": F.array_sort(ents)})
    d = F.col("_fa_d")
    out = out.withColumn("_fa_dmean", F.when(kk > 1, F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / (kk - 1)))
    srt, mean_e, ch_mean = F.col("_fa_srt"), F.col("_fa_mean"), F.col("_fa_dmean")
    whole = prof[first]
    overall = whole["entropy"]
    has = kk > 0
    std_e = F.sqrt(F.aggregate(ents, F.lit(0.0), lambda a, x: a + (x - mean_e) * (x - mean_e)) / kk)
    change_rate = F.aggregate(d, F.lit(0.0), lambda a, x: a + F.abs(x)) / (kk - 1)
    change_std = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + (x - ch_mean) * (x - ch_mean)) / (kk - 1))
    zero = F.lit(0.0)
    mn = F.when(has, F.array_min(ents)).otherwise(overall)
    mx = F.when(has, F.array_max(ents)).otherwise(overall)
    n_sample = whole["n"]
    cols = {
        "size": _col(size).cast("double"),
        "log_size": F.log(_col(size).cast("double") + 1),
        "file_entropy_avg": overall,
        "file_entropy_min": mn,
        "file_entropy_max": mx,
        "file_entropy_range": mx - mn,
        "file_entropy_std": F.when(has, std_e).otherwise(zero),
        "file_entropy_q25": F.when(has, _quantile_sorted(srt, kk, 0.25)).otherwise(zero),
        "file_entropy_q75": F.when(has, _quantile_sorted(srt, kk, 0.75)).otherwise(zero),
        "file_entropy_median": F.when(has, _quantile_sorted(srt, kk, 0.5)).otherwise(zero),
        "high_entropy_ratio": F.when(has, F.size(F.filter(ents, lambda e: e > C.ENTROPY_HIGH_THRESHOLD)) / kk).otherwise(zero),
        "low_entropy_ratio": F.when(has, F.size(F.filter(ents, lambda e: e < C.ENTROPY_LOW_THRESHOLD)) / kk).otherwise(zero),
        "entropy_change_rate": F.when(kk > 1, change_rate).otherwise(zero),
        "entropy_change_std": F.when(kk > 1, change_std).otherwise(zero),
        "zero_byte_ratio": F.when(n_sample > 0, whole["zeros"] / n_sample).otherwise(zero),
        "printable_byte_ratio": F.when(n_sample > 0, whole["printable"] / n_sample).otherwise(zero),
    }
    out = out.select("*", *[c.cast("double").alias(name) for name, c in cols.items()])
    return out.drop("_fa_k", "_fa_e", "_fa_mean", "_fa_d", "_fa_dmean", "_fa_srt")


def file_attributes(df: DataFrame, content: str = "content", size: str = "length",
                    sample_size: int | None = None, stride_blocks: bool = False) -> DataFrame:
    """size, log_size and the 14 entropy/ratio features of the whole file, or of its first ``sample_size`` bytes."""
    starts, lens, k = attr_slices(F.length(_col(content)), sample_size, stride_blocks)
    sample = _col(content) if sample_size is None else F.substring(_col(content), 1, sample_size)
    out = df.withColumn("_fa_prof", slice_profiles(sample, starts, lens))
    return attrs_from_profiles(out, "_fa_prof", 0, k, size).drop("_fa_prof")


# ---------------------------------------------------------------------------
# A1 histogram and A2 entropy of arbitrary slices
# ---------------------------------------------------------------------------

def byte_histogram(df: DataFrame, content: str = "content", start: Column | int = 0,
                   length: Column | int | None = None, out: str = "hist") -> DataFrame:
    """256-bin counts of ``content[start : start+length]`` as ``array<bigint>``."""
    s = F.lit(start) if isinstance(start, int) else start
    ln = F.length(_col(content)) if length is None else (F.lit(length) if isinstance(length, int) else length)
    h = slice_histograms(_col(content), F.array(s).cast("array<int>"), F.array(ln).cast("array<int>"))
    return df.withColumn(out, h[0])


def slice_entropy(df: DataFrame, content: str, start: Column, length: Column, out: str) -> DataFrame:
    """A2 on one slice (start is 0-based)."""
    p = slice_profiles(_col(content), F.array(start).cast("array<int>"), F.array(length).cast("array<int>"))
    return df.withColumn(out, p[0]["entropy"])
