"""Op 1: substring dedup by fixed-block anchors.

Every document's non-overlapping blocks of 18 words are the reference; every
rolling window of 18 words of every document probes it.  A repeat of 35 words
holds at least one whole block, wherever it begins, so a block whose words
start anywhere else is an anchor, and each anchor is extended over the 35-word
windows around it.  A window that starts elsewhere too is a repeat; the words
of all such windows join to maximal repeats and go.

Nothing travels a row a word.  Documents are dealt into groups of a few MB,
and a group sends the distinct hashes it holds, sorted and packed, to the
buckets that own them; a bucket answers each group with those that count.  So
a passage that a third of all documents share is one entry from each group,
and no pairs of copies are ever formed.  The three rounds (anchors, windows,
removal) are steps written to the shared folder.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexlens.llm import hashing
from hexlens.llm.common import passes, release, string_buffer, text_bytes, write_step

WINDOW = 35
#: Bytes of text of a group of documents, and of text behind a bucket of hashes, on average.
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 12 << 20
GROUP = "ss_group"
U = np.uint64


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending 64-bit values as byte planes of their differences; the high planes compress away."""
    d = a.copy()
    d[1:] -= a[:-1]
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def pack_plain(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(raw: bytes, ascending: bool) -> np.ndarray:
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(U)
    return np.cumsum(a, dtype=U) if ascending else a


def bucket_bounds(sorted_keys: np.ndarray, buckets: int):
    """(bucket, from, to) for the runs of ascending 64-bit keys that belong to each bucket."""
    of = ((sorted_keys >> U(32)) * U(buckets)) >> U(32)
    at = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)])) if len(of) else np.zeros(1, np.int64)
    for a, z in zip(at[:-1], at[1:], strict=True):
        yield int(of[a]), a, z


def merge_flags(values: np.ndarray) -> np.ndarray:
    """Distinct keys (all bits but the low two); low bits: 1 if any is a block, 2 if there are two or more."""
    s = np.sort(values)
    key = s >> U(2)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(s) else np.zeros(0, np.int64)
    if not len(at):
        return s
    flags = np.bitwise_or.reduceat(s & U(3), at)
    many = np.diff(np.append(at, len(s))) > 1
    return (key[at] << U(2)) | flags | (many.astype(U) << U(1))


def merge_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (a, all bits of b but the lowest), ascending; the low bit of b: there are two or more."""
    if not len(a):
        return a, b
    o = np.argsort(a, kind="stable")
    x, y = a[o], b[o]
    if np.any((x[1:] == x[:-1]) & (y[1:] >> U(1) != y[:-1] >> U(1))):
        o = np.lexsort((b, a))
        x, y = a[o], b[o]
    at = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] >> U(1) != y[:-1] >> U(1)))))
    many = np.bitwise_or.reduceat(y & U(1), at) | (np.diff(np.append(at, len(x))) > 1).astype(U)
    return x[at], (y[at] >> U(1) << U(1)) | many


def member(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in ascending keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == values, at, -1)


def each_pass(col):
    buf, off = string_buffer(col)
    for i, j in passes(off):
        part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, first = hashing.spans(part, o, hashing.space_table())
        yield part, o, starts, ends, first


def block_probes(part, starts, ends, first, block: int) -> np.ndarray:
    """Hash of the window at every position, low bits cleared; low bit 1 where it is a reference block."""
    h = hashing.window_hashes(hashing.word_hashes(part, starts, ends), block) & ~U(3)
    inner = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))[: len(h)]
    return h | (inner % block == 0).astype(U)


def table_of(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table([pa.array(v, t) for v, t in columns.values()], names=list(columns))


SENT = "bucket long, home long, payload binary, more binary"
BACK = "home long, payload binary, more binary"


def sent(rows: list[tuple]) -> pa.Table:
    b, h, p, m = zip(*rows, strict=True) if rows else ((), (), (), ())
    return table_of({"bucket": (b, pa.int64()), "home": (h, pa.int64()), "payload": (p, pa.binary()), "more": (m, pa.binary())})


def back(rows: list[tuple]) -> pa.Table:
    h, p, m = zip(*rows, strict=True) if rows else ((), (), ())
    return table_of({"home": (h, pa.int64()), "payload": (p, pa.binary()), "more": (m, pa.binary())})


def send_probes(docs: pa.Table, block: int, buckets: int) -> pa.Table:
    found = []
    for part, _, starts, ends, first in each_pass(docs["text"]):
        h = block_probes(part, starts, ends, first, block)
        found.append(merge_flags(h[hashing.window_valid(first, block)]))
    v = merge_flags(np.concatenate(found)) if found else np.zeros(0, U)
    home = docs[GROUP][0].as_py()
    return sent([(b, home, pack_sorted(v[i:j]), b"") for b, i, j in bucket_bounds(v, buckets)])


def answer_probes(t: pa.Table) -> pa.Table:
    """To each group, those of its hashes that are a block somewhere and start in two places or more."""
    each = [unpack(p, True) for p in t["payload"].to_pylist()]
    all_ = merge_flags(np.concatenate(each))
    hits = all_[(all_ & U(3)) == U(3)] >> U(2)
    rows = []
    for home, v in zip(t["home"].to_pylist(), each, strict=True):
        own = v[member(hits, v >> U(2)) >= 0]
        if len(own):
            rows.append((home, pack_sorted(own), b""))
    return back(rows)


def window_pairs(part, starts, ends) -> tuple[np.ndarray, np.ndarray]:
    a = hashing.window_hashes(hashing.word_hashes(part, starts, ends), WINDOW)
    b = hashing.window_hashes(hashing.word_hashes(part, starts, ends, 1), WINDOW, 1)
    return a, b & ~U(1)


def send_windows(docs: pa.Table, anchors: pa.Table, block: int, buckets: int) -> pa.Table:
    """The windows around anchors, as pairs of independent hashes."""
    if not docs.num_rows or not anchors.num_rows:
        return sent([])
    hits = np.unique(np.concatenate([unpack(p, True) >> U(2) for p in anchors["payload"].to_pylist()]))
    found = []
    for part, _, starts, ends, first in each_pass(docs["text"]):
        ok = hashing.window_valid(first, WINDOW)
        if not len(ok):
            continue
        hit = (member(hits, block_probes(part, starts, ends, first, block) >> U(2)) >= 0) & hashing.window_valid(first, block)
        seen = np.concatenate(([0], np.cumsum(hit)))
        reach = WINDOW - block + 1  # blocks that lie in the window from i start in [i, i + reach)
        near = ok & (seen[reach : reach + len(ok)] > seen[: len(ok)])
        if near.any():
            a, b = window_pairs(part, starts, ends)
            found.append(merge_pairs(a[near], b[near]))
    if not found:
        return sent([])
    a, b = merge_pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))
    home = docs[GROUP][0].as_py()
    return sent([(k, home, pack_sorted(a[i:j]), pack_plain(b[i:j])) for k, i, j in bucket_bounds(a, buckets)])


def answer_windows(t: pa.Table) -> pa.Table:
    """To each group, those of its windows that start in two places or more."""
    each = [(unpack(p, True), unpack(m, False)) for p, m in zip(t["payload"].to_pylist(), t["more"].to_pylist(), strict=True)]
    a, b = merge_pairs(*(np.concatenate(x) for x in zip(*each, strict=True)))
    keep = b & U(1) == U(1)
    a, b = a[keep], b[keep]
    rows = []
    for home, (x, y) in zip(t["home"].to_pylist(), each, strict=True):
        at = member(a, x)
        own = (at >= 0) & (b[np.maximum(at, 0)] >> U(1) == y >> U(1)) if len(a) else at >= 0
        if own.any():
            rows.append((home, pack_sorted(x[own]), pack_plain(y[own])))
    return back(rows)


def remove(docs: pa.Table, repeats: pa.Table) -> pa.Table:
    """The documents with what is left of each, and the maximal repeats as word intervals."""
    known = [(unpack(p, True), unpack(m, False)) for p, m in zip(repeats["payload"].to_pylist(), repeats["more"].to_pylist(), strict=True)]
    a, b = merge_pairs(*(np.concatenate(x) for x in zip(*known, strict=True))) if known else (np.zeros(0, U), np.zeros(0, U))
    n_words, n_removed, kept, spans = [], [], [], []
    for part, o, starts, ends, first in each_pass(docs["text"]):
        gone = np.zeros(len(starts) + 1, np.int32)
        if len(a) and len(starts) >= WINDOW:
            x, y = window_pairs(part, starts, ends)
            at = member(a, x)
            again = np.flatnonzero((at >= 0) & (b[np.maximum(at, 0)] >> U(1) == y >> U(1)) & hashing.window_valid(first, WINDOW))
            np.add.at(gone, again, 1)
            np.add.at(gone, again + WINDOW, -1)
        gone = np.cumsum(gone)[:-1] > 0
        raw = part.tobytes()
        n_words.append(np.diff(first))
        for r in range(len(o) - 1):
            own = gone[first[r] : first[r + 1]]
            words = raw[o[r] : o[r + 1]].split()
            n = int(own.sum())
            n_removed.append(n)
            if n:
                words = list(compress(words, ~own))
                edge = np.diff(np.concatenate(([False], own, [False])).astype(np.int8))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
            else:
                spans.append([])
            kept.append(b" ".join(words))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    out = docs.drop_columns([GROUP])
    for name, values, kind in (("ss_n_words", np.concatenate([np.zeros(0, np.int64), *n_words]), pa.int64()), ("ss_n_removed", n_removed, pa.int64()),
                               ("ss_kept", kept, pa.binary()), ("ss_removed", spans, pa.list_(span))):
        out = out.append_column(name, pa.array(values, kind))
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, ss_n_words, ss_n_removed, ss_kept, ss_removed, and ``carried``, a struct of the ``carry`` columns if any.

    Words are maximal runs of bytes other than space and 0x09-0x0D.  ss_kept:
    the words left, joined by a space; ss_removed: the maximal repeats as
    intervals [start, end) of words.  Equality is that of two independent
    64-bit hashes of the words.  A null or empty text has no words and keeps
    ''; texts of fewer than 35 words lose none; every row is a document of its
    own, so repeated rows of 35 words or more lose all they share.  Only the
    columns named are read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.struct(*(F.col(f"`{c}`").alias(c) for c in carry)).alias("carried")] if carry else []))
    total, deal = text_bytes(base), int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups, buckets = max(-(-total // GROUP_BYTES), deal), max(-(-total // BUCKET_BYTES), deal)
    block = (WINDOW + 1) // 2
    base = base.withColumn(GROUP, F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    texts = base.select("text", GROUP)
    probes = texts.groupBy(GROUP).applyInArrow(lambda t: send_probes(t, block, buckets), SENT)
    anchors, at1 = write_step(probes.groupBy("bucket").applyInArrow(answer_probes, BACK), "substring-anchors")
    windows = texts.groupBy(GROUP).cogroup(anchors.groupBy("home")).applyInArrow(lambda d, a: send_windows(d, a, block, buckets), SENT)
    repeats, at2 = write_step(windows.groupBy("bucket").applyInArrow(answer_windows, BACK), "substring-repeats")
    release(spark, at1)
    schema = T.StructType([f for f in base.schema if f.name != GROUP])
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    for name, kind in (("ss_n_words", T.LongType()), ("ss_n_removed", T.LongType()), ("ss_kept", T.BinaryType()), ("ss_removed", T.ArrayType(span))):
        schema.add(name, kind)
    out = base.groupBy(GROUP).cogroup(repeats.groupBy("home")).applyInArrow(remove, schema)
    return out.withColumn("ss_kept", F.col("ss_kept").cast("string"))
