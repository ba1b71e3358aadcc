"""Op 6: document quality from random-indexing word vectors and a two-layer network.

Every token has a sparse ternary index vector given by its hash.  A token's
word vector is the sum of the index vectors around it over the whole corpus
(sums of integers, added up by Spark).  A document is the mean of its tokens'
vectors and of the products of neighbours' index vectors (which a repeated
token makes large); a two-layer network in numpy turns that into a
probability, calibrated by a temperature on rows that it wasn't fitted on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexlens.llm import hashing
from hexlens.llm.common import crc_mod, passes, rows_in_arrow, string_buffer
from hexlens.llm.learning import fit_temperature, sample_ids, sigmoid

#: Slots that tokens are hashed to, length of their vectors, tokens of context on either side.
BITS, DIM, REACH = 14, 32, 2
#: Most labelled rows that the network is fitted on.
SAMPLE = 8000


def index_vectors(dim: int = DIM) -> np.ndarray:
    """A ternary vector with a quarter of its entries set, for each slot."""
    h = hashing.mix(np.arange(1, (dim << BITS) + 1, dtype=hashing.U64)).reshape(1 << BITS, dim)
    return np.where(h & hashing.U64(3) == 0, np.where(h & hashing.U64(4) == 0, 1, -1), 0).astype(np.int8)


def token_slots(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = hashing.tokens(buf, off)
    return (hashing.word_hashes(buf, starts, ends) >> hashing.U64(64 - BITS)).astype(np.int64), first


def context_sums(slots: np.ndarray, first: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each token, the sum of the index vectors of up to REACH tokens on either side in its row."""
    n = len(slots)
    out = np.zeros((n, index.shape[1]), np.int16)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    vec = index[slots]
    for d in range(1, REACH + 1):
        if n > d:
            same = (row[d:] == row[:-d])[:, None]
            out[d:] += vec[:-d] * same
            out[:-d] += vec[d:] * same
    return out


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit word vectors of all slots, from every text of the corpus.

    Tasks add up what they read and Spark adds up the tasks' integers, so the
    result does not depend on the order; at most 2**BITS rows reach the driver.
    """
    index = index_vectors()
    cols = [f"d{k}" for k in range(DIM)]

    def partial(batches):
        total = np.zeros((1 << BITS, DIM), np.int64)
        for b in batches:
            buf, off = string_buffer(b.column(0))
            for i, j in passes(off):
                slots, first = token_slots(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                if not len(slots):
                    continue
                order = np.argsort(slots.astype(np.uint16), kind="stable")
                got, at = np.unique(slots[order], return_index=True)
                total[got] += np.add.reduceat(context_sums(slots, first, index)[order], at, axis=0, dtype=np.int64)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, k]) for k in range(DIM))], ["slot", *cols])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(partial, "slot long, " + ", ".join(f"{c} long" for c in cols))
    got = sums.groupBy("slot").agg(*(F.sum(c).alias(c) for c in cols)).toArrow()
    out = np.zeros((1 << BITS, DIM), np.float32)
    if got.num_rows:
        v = np.stack([got[c].to_numpy() for c in cols], axis=1).astype(np.float64)
        out[got["slot"].to_numpy()] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return out


def pooled(buf: np.ndarray, off: np.ndarray, words: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Features of each row: mean word vector, mean product of neighbours' index vectors."""
    slots, first = token_slots(buf, off)
    n = np.maximum(np.diff(first), 1)[:, None]
    mean = hashing.row_sums(words[slots], first) / n
    pair = np.zeros((len(slots), index.shape[1]), np.int8)
    if len(slots) > 1:
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        vec = index[slots]
        pair[:-1] = vec[:-1] * vec[1:] * (row[1:] == row[:-1])[:, None]
    return np.concatenate((mean, hashing.row_sums(pair, first) / n), axis=1)


class Network:
    """Standardised inputs, one hidden tanh layer, a logistic output and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4):
        rng = np.random.default_rng(5)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        late = np.arange(len(x)) % 5 == 4
        z = (x - self.mean) / self.scale
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
             rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        early = np.flatnonzero(~late)
        for _ in range(epochs):
            order = rng.permutation(early)
            for k in range(0, len(order), 128):
                b = order[k : k + 128]
                h = np.tanh(z[b] @ p[0] + p[1])
                e = (sigmoid(h @ p[2] + p[3][0]) - y[b]) / len(b)
                dh = np.outer(e, p[2]) * (1 - h * h)
                g = [z[b].T @ dh + decay * p[0], dh.sum(axis=0), h.T @ e + decay * p[2], np.array([e.sum()])]
                t += 1
                for a, d, mm, vv in zip(p, g, m, v, strict=True):
                    mm *= 0.9
                    mm += 0.1 * d
                    vv *= 0.999
                    vv += 0.001 * d * d
                    a -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if late.any():
            raw, yl = self.logit(x[late]), y[late]
            self.temperature = fit_temperature(lambda t: np.mean(np.logaddexp(0, raw / t) - yl * raw / t), low=0.5)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -30, 30)
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature)


def train(docs: DataFrame, labels: DataFrame, words: np.ndarray, sample: int = SAMPLE, label_col: str = "quality") -> Network | None:
    """Fit on at most ``sample`` labelled rows, whatever ids they repeat (they should be training rows only); None without labels."""
    index = index_vectors()
    of = labels.filter(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).alias("y"))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample_ids(of, "doc_id", sample)), "doc_id")  # at most ``sample`` rows
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def features(batches):
        for b in batches:
            buf, off = string_buffer(b.column(2))
            for i, j in passes(off):
                x = pooled(buf[off[i] : off[j]], off[i : j + 1] - off[i], shared.value, index)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    vectors = rows.select("doc_id", F.col("y").cast("int").alias("y"), "text").mapInArrow(features, "doc_id long, y int, x array<double>")
    # an id may be on any number of rows: what reaches the driver is bounded by rows
    got = vectors.orderBy(F.xxhash64("doc_id", "y"), "doc_id", "x").limit(sample).toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by("doc_id")
    return Network(np.stack([np.asarray(v.values) for v in got["x"]]), got["y"].to_numpy().astype(np.float64))


def score(docs: DataFrame, words: np.ndarray, net: Network | None, cut: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with columns score (0 to 1) and predicted (1 if score >= cut), in one narrow pass.

    Needs doc_id and text and returns doc_id, score, predicted.  An empty or
    null text is scored as zero vectors; without a network the score is 0.5.
    """
    index = index_vectors()
    shared = docs.sparkSession.sparkContext.broadcast(words)  # 2**BITS x DIM floats at any input size

    def run(batches):
        for b in batches:
            buf, off = string_buffer(b.column(1))
            p = np.full(len(off) - 1, 0.5)
            for i, j in passes(off):
                if net:
                    p[i:j] = net.probability(pooled(buf[off[i] : off[j]], off[i : j + 1] - off[i], shared.value, index))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, words: np.ndarray, net: Network | None, cut: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score ``cut`` or more; without a network all of them.

    Null and empty texts are scored as zero vectors; repeated rows one by one.
    """
    if net is None:
        return docs
    index, at = index_vectors(), docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for b in batches:
            buf, off = string_buffer(b.column(at))
            ok = np.ones(b.num_rows, bool)
            for i, j in passes(off):
                ok[i:j] = net.probability(pooled(buf[off[i] : off[j]], off[i : j + 1] - off[i], shared.value, index)) >= cut
            yield b.filter(pa.array(ok))

    return rows_in_arrow(docs, run)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, sample: int = SAMPLE) -> tuple[np.ndarray, Network | None]:
    """Word vectors from all texts; a network from labels outside the held fold of crc32(doc_id)."""
    words = word_vectors(docs)
    seen = crc_mod("doc_id", folds) != held_fold
    return words, train(docs.filter(seen), labels.filter(seen), words, sample)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, cut: float = 0.7) -> DataFrame:
    """Fit, then score everything: doc_id, held_out, score, predicted.

    Rows with repeated ids are scored one by one; null labels don't count,
    repeated ones count once (the largest); columns other than doc_id, text and
    the label are not read.  Empty tables give no rows.
    """
    words, net = fit(docs, labels, folds, held_fold)
    return score(docs, words, net, cut).select("doc_id", (crc_mod("doc_id", folds) == held_fold).alias("held_out"), "score", "predicted")
