"""Op 7: pack documents into token sequences of bounded length with best-fit decreasing.

Each document is encoded once, in the task that reads it, and cut into full
windows and one remainder; only the pieces' sizes and checksums travel.  The
pieces are dealt into shards of a bounded number of documents, and each shard
packs its remainders by best-fit decreasing: a segment tree over the remaining
capacities finds the tightest open window that still has room.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexlens.llm import tokenizer

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Documents of a shard, on average; a shard is packed in one task.
SHARD_DOCS = 4096


class CapacityTree:
    """Segment tree over remaining capacities: the smallest one >= need that has an open window."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves < size + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the tightest window with room, or None."""
        i = need + self.leaves
        if not self.count[i]:
            while True:  # up to the first subtree on the right that isn't empty, then down its left side
                if i & (i + 1) == 0:
                    return None
                if not i & 1 and self.count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; pieces are taken longest first, ties in the order given."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, made = CapacityTree(size), 0
    for k in np.argsort(-lengths, kind="stable"):
        n = int(lengths[k])
        found = tree.take(n) if n < size else None
        if found is None:
            room, w, made = size, made, made + 1
        else:
            room, w = found
        window[k], offset[k] = w, size - room
        if room > n:
            tree.add(room - n, w)
    return window, offset


def cut_documents(docs: DataFrame, tokenizer_path: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    def cut(batches):
        enc = tokenizer.encoder(tokenizer_path)
        for b in batches:
            ids_of, rows = b.column(0).to_pylist(), []
            for doc, text in zip(ids_of, b.column(1).to_pylist(), strict=True):
                ids = enc.ids(text) if text else []
                ids.append(end_id)
                raw, n = np.array(ids, "<u4").tobytes(), len(ids)
                rows += [(doc, s, min(size, n - s), zlib.crc32(raw[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str | None = None, size: int = 1024, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids, then ``end_id``, lie in the pieces in order; a
    sequence holds its pieces from offset 0 without gaps, ``size`` ids at most.
    A null or empty text is ``end_id`` alone.  Rows are documents of their own
    even if ids or texts repeat (a null id stays null); other columns are not
    read; an empty table gives no rows.  Very long texts are cut into full
    windows, which fill sequences of their own.
    """
    path = tokenizer_path or tokenizer.default_path()
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    pieces = cut_documents(docs, path, size, end_id, id_col, text_col)
    # pieces of one document may go to different shards, so a very long one is spread, and so are rows that are all alike
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        window, offset = best_fit_decreasing(t["length"].to_numpy(), size)
        base = (t["shard"][0].as_py() if len(t) else 0) << 32
        return t.drop_columns(["shard"]).append_column("sequence_id", pa.array(base + window)).append_column("offset", pa.array(offset))

    return dealt.groupBy("shard").applyInArrow(fill, PACKED)
