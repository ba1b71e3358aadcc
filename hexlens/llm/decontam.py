"""Op 10: benchmark decontamination with BM25 retrieval of test items by block-max WAND.

The inverted index holds the test items as entries of at most one stride of
words; the last entry of a longer item is its last stride of words, so that no
entry is a short rest.  Every training passage (a window of two strides, one every
stride) is a query, and all entries that score above the threshold are
retrieved.  A BM25 score is taken relative to the entry's own score against
itself, so that 1 means that all of the entry's terms are there.

Entries lie in blocks, and a term's posting list keeps the largest weight in
each block.  As in WAND, the most frequent terms, which can't lift any entry
over the threshold without others, never open a passage: a (passage, block) is
looked at only if the block maxima of its other terms, and the most that the
frequent ones could add, reach the threshold.  Those passages are scored
exactly.  Entries only retrieve: an item is verified on the word n-grams of its
whole question (all but the last sentence) and its whole answer (the last
sentence), of each of which a stated share must occur.  An item of one entry
must have them in one passage; of a longer one they are sought in all passages
of the document that its entries retrieve, together.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexlens.llm import hashing
from hexlens.llm.common import passes, rows_in_arrow, string_buffer

#: Words between passages; a passage has twice as many, so that an entry lies whole in one.
STRIDE = 64
#: Entries of a block; most bytes of test items in one index (further items go to further indexes).
BLOCK, INDEX_BYTES = 8, 32 << 20
#: BM25 relative to the entry's own score, and the share of question and of answer n-grams, that a leak needs.
THRESHOLD, OVERLAP, WORDS = 0.5, 0.5, 5
K1, B = 1.2, 0.75
FILTER_BITS = 20
U = np.uint64
ITEMS = "item_id long, words array<long>, n_question int"
PAIRS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and the index of each row's first."""
    starts, ends, first = hashing.spans(buf, off, hashing.letter_table())
    return hashing.word_hashes(hashing.lower_table()[buf], starts, ends), first


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: all but the last sentence, and the last; of a single sentence the last quarter of its words."""
    cuts = [m.end() for m in re.finditer(r"[.!?]+\s+(?=\S)", text)]
    if cuts:
        return text[: cuts[-1]], text[cuts[-1] :]
    words = text.split()
    n = max(1, len(words) - max(1, len(words) // 4))
    return " ".join(words[:n]), " ".join(words[n:])


def items_of(items: DataFrame) -> DataFrame:
    """Test items that have words: word hashes, and how many of them belong to the question."""
    def hashed(batches):
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = []
                for part in split_item(text or ""):
                    raw = np.frombuffer(part.encode(), np.uint8)
                    parts.append(words_of(raw, np.array([0, len(raw)]))[0])
                words = np.concatenate(parts)
                if len(words):
                    rows.append((item, words.view(np.int64), len(parts[0]) if len(words) >= WORDS else len(words)))  # a shorter item is all question
            i, w, q = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(w, pa.list_(pa.int64())), pa.array(q, pa.int32())],
                                             ["item_id", "words", "n_question"])

    return items.mapInArrow(hashed, ITEMS)


def entry_starts(n: int) -> list[int]:
    """First words of the entries of an item of ``n`` words; the last entry ends with the item."""
    return [*range(0, n - STRIDE, STRIDE), max(n - STRIDE, 0)] if n else []


def entries_of(items: DataFrame) -> DataFrame:
    """Words of the entries of the items."""
    def cut(batches):
        for b in batches:
            own = [w[a : a + STRIDE] for w in b.column(0).to_pylist() for a in entry_starts(len(w))]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int64()))], ["words"])

    return items.select("words").mapInArrow(cut, "words array<long>")


def gram_hashes(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    n = min(n, len(words))
    return np.unique(hashing.window_hashes(words, n)) if n else np.zeros(0, U)


class Index:
    """Inverted index of the entries of items, with block maxima."""

    def __init__(self, items: list[int], words: list[np.ndarray], n_question: list[int], n_all: int, mean: float, df: dict[int, int], threshold: float):
        self.items, self.threshold = items, threshold
        self.parts = [(gram_hashes(w[:q]), gram_hashes(w[q:])) for w, q in zip(words, n_question, strict=True)]
        self.n = [(min(WORDS, q), min(WORDS, len(w) - q)) for w, q in zip(words, n_question, strict=True)]
        cuts = [entry_starts(len(w)) for w in words]
        self.n_entries = [len(c) for c in cuts]
        self.item = np.repeat(np.arange(len(words)), self.n_entries).tolist()
        words = [w[a : a + STRIDE] for w, c in zip(words, cuts, strict=True) for a in c]
        self.terms = np.unique(np.concatenate([np.zeros(0, U), *words]))
        count = np.array([df[int(t)] for t in self.terms.view(np.int64)], np.float64)
        idf = np.log1p((n_all - count + 0.5) / (count + 0.5))
        self.own, self.weight = [], []
        for w in words:
            t, tf = np.unique(np.searchsorted(self.terms, w), return_counts=True)
            v = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            self.own.append(t)
            self.weight.append(v / v.sum())
        entry = np.repeat(np.arange(len(words)), [len(t) for t in self.own])
        term, w = np.concatenate([np.zeros(0, np.int64), *self.own]), np.concatenate([np.zeros(0), *self.weight])
        # the most frequent terms, as long as no entry gets more than half the threshold from them
        self.essential = np.ones(len(self.terms), bool)
        got = np.zeros(len(words))
        by_term = np.argsort(term, kind="stable")
        cuts = np.searchsorted(term[by_term], np.arange(len(self.terms) + 1))
        for t in np.argsort(idf, kind="stable"):
            rows = by_term[cuts[t] : cuts[t + 1]]
            if np.any(got[entry[rows]] + w[rows] > threshold / 2):
                break
            got[entry[rows]] += w[rows]
            self.essential[t] = False
        self.blocks = -(-len(words) // BLOCK)
        self.rest = np.zeros(max(self.blocks, 1))
        np.maximum.at(self.rest, np.arange(len(words)) // BLOCK, got)
        key, at = np.unique(term * max(self.blocks, 1) + entry // BLOCK, return_inverse=True)
        self.block_max = np.zeros(len(key))
        np.maximum.at(self.block_max, at, w)
        self.post_block = key % max(self.blocks, 1)
        self.post = np.searchsorted(key // max(self.blocks, 1), np.arange(len(self.terms) + 1))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.terms[self.essential] >> U(64 - FILTER_BITS)] = True

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Term of each word, or -1."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def opened(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, passage, block) triples whose bound reaches the threshold."""
        none = np.zeros(0, np.int64)
        at = np.flatnonzero(self.filter[words >> U(64 - FILTER_BITS)])
        term = self.lookup(words[at])
        keep = (term >= 0) & self.essential[term]
        at, term = at[keep], term[keep]
        if not len(at):
            return none, none, none
        row = np.searchsorted(first, at, side="right") - 1
        step = (at - first[row]) // STRIDE
        base = np.concatenate(([0], np.cumsum((first[1:] - first[:-1]) // STRIDE + 1)))
        passage = np.concatenate((base[row] + step, (base[row] + step - 1)[step > 0]))
        pair = np.unique(passage * len(self.terms) + np.concatenate((term, term[step > 0])))
        passage, term = pair // len(self.terms), pair % len(self.terms)
        n = self.post[term + 1] - self.post[term]
        where = np.repeat(self.post[term] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        key, inverse = np.unique(np.repeat(passage, n) * self.blocks + self.post_block[where], return_inverse=True)
        bound = np.bincount(inverse, self.block_max[where])
        block = key % self.blocks
        ok = bound + self.rest[block] >= self.threshold - 1e-9
        passage, block = key[ok] // self.blocks, block[ok]
        row = np.searchsorted(base, passage, side="right") - 1
        return row, passage - base[row], block

    def leaks(self, words: np.ndarray, first: np.ndarray, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(row, item) -> (score, question overlap, answer overlap) of the verified items, the best of each."""
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        hits: dict[int, tuple[float, list[np.ndarray]]] = {}

        def verify(r: int, i: int, score: float, found: list[np.ndarray]) -> None:
            share = [float(f.mean()) if len(f) else 1.0 for f in found]
            if min(share) >= overlap:
                out[r, self.items[i]] = max(out.get((r, self.items[i]), (0.0, 0.0, 0.0)), (score, *share))

        present = np.zeros(len(self.terms) + 1, bool)
        row, step, block = self.opened(words, first)
        last, own, terms = None, None, None
        for r, s, b in zip(row.tolist(), step.tolist(), block.tolist(), strict=True):
            if last != (r, s):
                if last and last[0] != r:
                    for i, hit in hits.items():
                        verify(last[0], i, *hit)
                    hits = {}
                own = words[first[r] + s * STRIDE : min(first[r] + (s + 2) * STRIDE, first[r + 1])]
                if terms is not None:
                    present[terms] = False
                terms = self.lookup(own)
                present[terms] = True
                present[-1] = False
                last, grams, seen = (r, s), {}, set()
            for e in range(b * BLOCK, min((b + 1) * BLOCK, len(self.own))):
                score = float(self.weight[e][present[self.own[e]]].sum())
                if score < self.threshold - 1e-9:
                    continue
                i = self.item[e]
                best, found = hits.get(i, (0.0, None))
                if found is None:
                    found = [np.zeros(len(known), bool) for known in self.parts[i]]
                if i not in seen:  # the passage's n-grams, once for each item that it may hold
                    for f, known, n in zip(found, self.parts[i], self.n[i], strict=True):
                        if n and n not in grams:
                            grams[n] = np.unique(hashing.window_hashes(own, n))
                        if n:
                            at = np.minimum(np.searchsorted(known, grams[n]), len(known) - 1)
                            f[at[known[at] == grams[n]]] = True
                    seen.add(i)
                if self.n_entries[i] == 1:
                    verify(r, i, score, found)
                else:
                    hits[i] = (max(best, score), found)
        for i, hit in hits.items():
            verify(last[0], i, *hit)
        return out


def build_indexes(items: DataFrame, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES, id_col: str = "item_id",
                  text_col: str = "text") -> list[Index]:
    """One index for each ``index_bytes`` of test items, each item whole in one; document frequencies are those of all entries.

    Each is small enough to be broadcast; a larger benchmark only makes more of
    them.  Null and empty items, and those without a letter or digit, have no entry.
    """
    items = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-size // index_bytes))
    whole = items_of(items)
    entries = entries_of(whole)
    n_all, total = entries.agg(F.count("*"), F.sum(F.size("words"))).first()
    if not n_all:
        return []
    df = entries.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").count()
    out = []
    for k in range(parts):
        own = whole.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        got = own.toArrow().to_pylist()
        got.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["words"]))
        terms = own.select(F.explode("words").alias("term")).distinct()
        counts = dict(df.join(terms, "term", "left_semi").toPandas().itertuples(index=False))
        if got:
            out.append(Index([r["item_id"] for r in got], [np.array(r["words"], np.int64).view(U) for r in got], [r["n_question"] for r in got],
                             n_all, total / n_all, counts, threshold))
    return out


def batch_leaks(index: Index, col: pa.Array, overlap: float):
    """(row, item, score, question overlap, answer overlap) of an Arrow column of texts."""
    buf, off = string_buffer(col)
    for i, j in passes(off):
        words, first = words_of(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        for (r, item), found in index.leaks(words, first, overlap).items():
            yield (i + r, item, *found)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: each row of ``docs`` with each item that it leaks.

    Words are lower-cased runs of letters and digits.  Null and empty texts and
    items leak nothing; repeated documents or items have pairs of their own
    (items that share an id are one); ids may be null.  An item of fewer than
    five words must occur word for word.  The score is that of the best entry of
    the item; an item of more than 64 words leaks if the passages that its
    entries retrieve hold the stated shares together.  Other columns are not read; empty
    tables give no rows.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index in build_indexes(items, threshold, index_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # built from at most index_bytes of text

        def find(batches, shared=shared):
            for b in batches:
                rows = list(batch_leaks(shared.value, b.column(1), overlap))
                if rows:
                    r, *cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[1:])],
                                                     ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = text.mapInArrow(find, PAIRS)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], PAIRS) if out is None else out


def drop_leaking(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
                 index_bytes: int = INDEX_BYTES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that leak no test item; one narrow pass for each index.

    Null and empty texts and null ids leak nothing by themselves; repeated rows are judged one by one.
    """
    at = docs.columns.index(text_col)
    for index in build_indexes(items, threshold, index_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches, shared=shared):
            for b in batches:
                bad = {x[0] for x in batch_leaks(shared.value, b.column(at), overlap)}
                yield b.filter(pa.array([r not in bad for r in range(b.num_rows)], pa.bool_()))

        docs = rows_in_arrow(docs, clean)
    return docs
