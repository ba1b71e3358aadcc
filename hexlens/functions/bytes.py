"""Byte-level primitives.

One Arrow UDF does the only thing Spark SQL cannot do cheaply: count the 256
byte values of many slices of a ``binary`` column.  It works on a whole Arrow
batch at once (zero-copy view of the binary buffer, one ``bincount`` per group
of rows), so the Python side is a short vectorised helper; everything that
decides *which* slices to count (thirds, chunks, blocks, sections, overlay) is
ordinary Catalyst expressions computed before the call, and everything that
combines slice summaries (differences, ratios, percentiles of block values) is
Catalyst again after it.

Two UDFs share the counting core:

* ``slice_histograms(content, starts, lens) -> array<array<bigint>>``
* ``slice_profiles(content, starts, lens)   -> array<struct<...>>``: per slice
  count, mean, population std, min, max, q25/median/q75 (linear
  interpolation), Shannon entropy / 8 and the four class counts.

Slice bounds are clipped to the content, so an out-of-range or negative slice
is simply empty (all statistics 0).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexlens import config as C

PROFILE_FIELDS = [
    ("n", T.LongType()),
    ("mean", T.DoubleType()),
    ("std", T.DoubleType()),
    ("min", T.DoubleType()),
    ("max", T.DoubleType()),
    ("q25", T.DoubleType()),
    ("median", T.DoubleType()),
    ("q75", T.DoubleType()),
    ("entropy", T.DoubleType()),
    ("zeros", T.LongType()),
    ("ffs", T.LongType()),
    ("nops", T.LongType()),
    ("printable", T.LongType()),
]
PROFILE_TYPE = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in PROFILE_FIELDS]))
HIST_TYPE = T.ArrayType(T.ArrayType(T.LongType()))

_GROUP_BYTES = 1 << 20         # content bytes, and 8-byte segment numbers, that one step works on
_GROUP_ROWS = 32               # of small files: a step's counts stay in the cache
_IDX = np.arange(256, dtype=np.float64)


def _binary_parts(arr: pa.Array):
    """Zero-copy (offsets, data, valid) views of a (large_)binary Arrow array."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    bufs = arr.buffers()
    off_dtype = np.int64 if pa.types.is_large_binary(arr.type) else np.int32
    offs = np.frombuffer(bufs[1], dtype=off_dtype, count=arr.offset + n + 1)[arr.offset:]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    valid = arr.is_valid().to_numpy(zero_copy_only=False)
    return offs.astype(np.int64), data, valid


def _list_parts(arr: pa.Array, n_rows: int):
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    counts = arr.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = arr.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return counts, values


def iter_slice_hists(offs, data, valid, counts, starts, lens):
    """Yield ``(a, b, hist)``: byte counts (b-a, 256) of slices a..b-1.

    Rows are handled in groups of about ``_GROUP_BYTES``, and a larger row in
    steps of as many, so temporaries stay small whatever the files' sizes:
    inside a group the union of all slice bounds splits the bytes into
    disjoint segments, ``bincount`` counts every segment, and each slice is a
    difference of cumulative segment counts (slices may overlap freely).
    """
    n_rows = len(offs) - 1
    row_len = np.where(valid, offs[1:] - offs[:-1], 0)
    row_of = np.repeat(np.arange(n_rows), counts)
    if len(row_of) == 0:
        return
    rl = row_len[row_of]
    s = np.clip(starts, 0, rl)
    e = np.clip(starts + lens, s, rl)
    base = offs[:-1][row_of]
    gs, ge = base + s, base + e
    first_slice = np.concatenate([[0], np.cumsum(counts)])
    r0 = 0
    while r0 < n_rows:
        r1 = int(np.searchsorted(offs, offs[r0] + _GROUP_BYTES, side="right")) - 1
        r1 = min(max(r1, r0 + 1), r0 + _GROUP_ROWS, n_rows)
        a, b = first_slice[r0], first_slice[r1]
        lo, hi = offs[r0], offs[r1]
        r0 = r1
        if a == b:
            continue
        bounds = np.unique(np.concatenate([gs[a:b], ge[a:b], [lo, hi]]))
        hist = np.zeros((len(bounds) - 1, 256), np.int64)
        for at in range(lo, hi, _GROUP_BYTES):
            end = min(hi, at + _GROUP_BYTES)
            f = int(np.searchsorted(bounds, at, side="right")) - 1
            l = int(np.searchsorted(bounds, end, side="left"))
            cuts = np.clip(bounds[f:l + 1], at, end)
            seg = np.repeat(np.arange(l - f, dtype=np.int64), np.diff(cuts))
            hist[f:l] += np.bincount(seg * 256 + data[at:end], minlength=(l - f) * 256).reshape(-1, 256)
        cum = np.zeros((len(bounds), 256), dtype=np.int64)
        np.cumsum(hist, axis=0, out=cum[1:])
        yield a, b, cum[np.searchsorted(bounds, ge[a:b])] - cum[np.searchsorted(bounds, gs[a:b])]


def slice_hist_matrix(offs, data, valid, counts, starts, lens) -> np.ndarray:
    """(total_slices, 256) byte counts for every (row, slice) pair."""
    out = np.zeros((int(np.sum(counts)), 256), dtype=np.int64)
    for a, b, h in iter_slice_hists(offs, data, valid, counts, starts, lens):
        out[a:b] = h
    return out


def profiles_from_hist(h: np.ndarray) -> dict[str, np.ndarray]:
    """Vectorised slice statistics from a (S, 256) histogram matrix."""
    n = h.sum(axis=1)
    nz = n > 0
    nf = np.where(nz, n, 1).astype(np.float64)
    mean = (h @ _IDX) / nf
    dev = _IDX[None, :] - mean[:, None]
    dev *= dev
    dev *= h
    var = dev.sum(axis=1) / nf
    present = h > 0
    mn = np.argmax(present, axis=1).astype(np.float64)
    mx = (255 - np.argmax(present[:, ::-1], axis=1)).astype(np.float64)
    row, value = np.nonzero(present)  # most slices hold few of the 256 values
    p = h[row, value] / nf[row]
    plogp = dev
    plogp.fill(0.0)
    plogp[row, value] = p * np.log2(p)
    entropy = -plogp.sum(axis=1) / 8.0 + 0.0
    cum = np.cumsum(h.ravel())  # over all slices: increasing, so that a rank is found by bisection
    before, at = np.cumsum(n) - n, 256 * np.arange(len(n))

    def quant(q):
        pos = q * (n - 1).clip(min=0)
        k0 = np.floor(pos).astype(np.int64)
        k1 = np.minimum(k0 + 1, np.maximum(n - 1, 0))
        v0 = (np.searchsorted(cum, before + k0, side="right") - at).astype(np.float64)
        v1 = (np.searchsorted(cum, before + k1, side="right") - at).astype(np.float64)
        return v0 + (v1 - v0) * (pos - k0)

    zero = lambda x: np.where(nz, x, 0.0)
    return {
        "n": n,
        "mean": zero(mean), "std": zero(np.sqrt(var)), "min": zero(mn), "max": zero(mx),
        "q25": zero(quant(0.25)), "median": zero(quant(0.5)), "q75": zero(quant(0.75)),
        "entropy": zero(entropy),
        "zeros": h[:, 0], "ffs": h[:, 255], "nops": h[:, C.NOP_BYTE],
        "printable": h[:, C.PRINTABLE_LOW:C.PRINTABLE_HIGH + 1].sum(axis=1),
    }


def _wrap_lists(counts: np.ndarray, child: pa.Array, valid: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    mask = pa.array(~valid) if not valid.all() else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), child, mask=mask)


def _prepare(content, starts, lens):
    offs, data, valid = _binary_parts(content)
    n_rows = len(offs) - 1
    raw_counts, s = _list_parts(starts, n_rows)
    counts2, l = _list_parts(lens, n_rows)
    if not np.array_equal(raw_counts, counts2):
        raise ValueError("starts and lens must have the same length per row")
    keep = np.repeat(valid, raw_counts)
    counts = np.where(valid, raw_counts, 0)
    return offs, data, valid, counts, s[keep], l[keep]


@F.arrow_udf(HIST_TYPE)
def slice_histograms(content: pa.Array, starts: pa.Array, lens: pa.Array) -> pa.Array:
    offs, data, valid, counts, s, l = _prepare(content, starts, lens)
    h = slice_hist_matrix(offs, data, valid, counts, s, l)
    inner_offsets = pa.array(np.arange(0, h.size + 1, 256, dtype=np.int32), pa.int32())
    inner = pa.ListArray.from_arrays(inner_offsets, pa.array(h.ravel(), pa.int64()))
    return _wrap_lists(counts, inner, valid)


@F.arrow_udf(PROFILE_TYPE)
def slice_profiles(content: pa.Array, starts: pa.Array, lens: pa.Array) -> pa.Array:
    offs, data, valid, counts, s, l = _prepare(content, starts, lens)
    total = int(np.sum(counts))
    cols = {name: np.zeros(total, np.int64 if isinstance(typ, T.LongType) else np.float64)
            for name, typ in PROFILE_FIELDS}
    for a, b, h in iter_slice_hists(offs, data, valid, counts, s, l):
        for name, values in profiles_from_hist(h).items():
            cols[name][a:b] = values
    fields = [pa.array(cols[name]) for name, _ in PROFILE_FIELDS]
    child = pa.StructArray.from_arrays(fields, names=[n for n, _ in PROFILE_FIELDS])
    return _wrap_lists(counts, child, valid)


# ---------------------------------------------------------------------------
# Catalyst helpers
# ---------------------------------------------------------------------------

def utf8_bytes(text_col: str | Column) -> Column:
    """``binary`` UTF-8 encoding of a string column (the byte view of a text)."""
    return F.encode(F.col(text_col) if isinstance(text_col, str) else text_col, "UTF-8")


def shannon_entropy_of_counts(counts: Column, total: Column) -> Column:
    """-sum(p*log2 p)/8 over an ``array<bigint>`` of counts (small arrays only)."""
    return F.aggregate(
        counts, F.lit(0.0),
        lambda acc, c: acc - F.when(c > 0, (c / total) * F.log2(c / total)).otherwise(F.lit(0.0)),
    ) / F.lit(8.0) + F.lit(0.0)


def exploded_bytes(df, content_col: str, keys: list[str]):
    """Pure-SQL form: one row per byte ``(keys..., pos, b)``.

    Only for cross-checks on small fixtures; the production path is the
    Arrow histogram above (64 KiB per file would be 65,536 rows per file).
    """
    hexed = F.hex(F.col(content_col))
    n = F.length(F.col(content_col))
    positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return (df.select(*keys, hexed.alias("_hex"), F.explode(positions).alias("pos"))
              .select(*keys, "pos",
                      F.expr("cast(conv(substr(_hex, 2 * pos + 1, 2), 16, 10) as int)").alias("b")))
