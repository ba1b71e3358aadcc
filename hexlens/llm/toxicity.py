"""Op 8: toxicity by non-negative positive-unlabelled learning.

The classifier is logistic over the distinct hashed words of a text.  It
learns from confirmed toxic documents and unlabelled text only: the risk of
calling text clean is estimated on the unlabelled rows and corrected by the
class prior, and where that estimate turns negative the step goes the other
way, so that a flexible model can't drive it below zero.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexlens.llm import hashing
from hexlens.llm.common import crc_mod, passes, string_buffer
from hexlens.llm.learning import sample_ids, sigmoid

#: Slots that words are hashed to; the model is one weight for each.
BITS = 18
#: Most rows of either kind that the classifier is fitted on (a bounded sample of labelled rows).
POSITIVES, UNLABELLED = 2000, 8000
#: Penalties on the weights, as tried.
PENALTIES = (1e-4, 1e-3)
#: Standard errors by which a word's share must differ between the two kinds of rows, as tried.
SCREENS = (4.0, 0.0)


def distinct_slots(buf: np.ndarray, off: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) pairs of the distinct lower-cased words of each row; ``keep``: only slots where it is true."""
    starts, ends, first = hashing.spans(buf, off, hashing.letter_table())
    slot = (hashing.word_hashes(hashing.lower_table()[buf], starts, ends) >> hashing.U64(64 - BITS)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    if keep is not None:
        of = keep[slot]
        row, slot = row[of], slot[of]
    key = np.unique((row << BITS) | slot)
    return key >> BITS, key & ((1 << BITS) - 1)


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, l1: float, epochs: int = 200, rate: float = 0.1,
             least_df: int = 3, screen: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights of the slots and the bias; ``pos`` and ``unl`` hold each row's slots.

    ``l1`` penalises weights.  Slots in fewer than ``least_df`` rows get none,
    nor do those whose share of positives differs from that of unlabelled rows
    by fewer than ``screen`` standard errors.
    """
    flat = [np.concatenate([np.zeros(0, np.int64), *rows]) for rows in (pos, unl)]
    rows = [np.repeat(np.arange(len(r)), [len(x) for x in r]) for r in (pos, unl)]
    slots, at, n = np.unique(np.concatenate(flat), return_inverse=True, return_counts=True)
    n_p, n_u = max(len(pos), 1), max(len(unl), 1)
    in_p = np.bincount(at[: len(flat[0])], minlength=len(slots)) / n_p
    share = n / (n_p + n_u)
    z = (in_p - (n - in_p * n_p) / n_u) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_p + 1 / n_u))
    used = (n >= least_df) & (np.abs(z) >= screen)
    place, keep = np.cumsum(used) - 1, used[at]
    slots, at = slots[used], place[at]
    kp, ku = keep[: len(flat[0])], keep[len(flat[0]) :]
    (ip, iu), (rp, ru) = (at[: len(kp)][kp], at[len(kp) :][ku]), (rows[0][kp], rows[1][ku])
    w, b = np.zeros(len(slots)), -2.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, epochs + 1):
        gp = np.bincount(rp, w[ip], len(pos)) + b
        gu = np.bincount(ru, w[iu], len(unl)) + b
        clean = (np.logaddexp(0, gu).sum() / n_u) - prior * np.logaddexp(0, gp).sum() / n_p
        dp, du = -prior * sigmoid(gp) / n_p, sigmoid(gu) / n_u
        if clean >= 0:
            dp = dp + prior * (sigmoid(gp) - 1) / n_p
        else:
            dp, du = -dp, -du
        g = np.bincount(ip, dp[rp], len(w)) + np.bincount(iu, du[ru], len(w))
        gb = dp.sum() + du.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = np.sqrt(v / (1 - 0.999**t)) + 1e-8
        w = w - rate * (m / (1 - 0.9**t)) / step
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / step, 0)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    out = np.zeros(1 << BITS, np.float32)
    out[slots] = w
    return out, float(b)


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, penalties: tuple[float, ...] = PENALTIES,
        screens: tuple[float, ...] = SCREENS) -> tuple[np.ndarray, float]:
    """``fit_nnpu`` with the penalty and screen that best rank left-out positives above left-out unlabelled rows.

    That ranking needs no clean labels and orders the choices as the true one does.
    """
    late = lambda rows, k: [r for n, r in enumerate(rows) if (n % 4 == 3) == k]
    p, u = late(pos, True), late(unl, True)
    best, chosen = -1.0, (penalties[0], screens[0])
    for screen in screens if p and u else ():
        for l1 in penalties:
            w, _ = fit_nnpu(late(pos, False), late(unl, False), prior, l1, epochs=100, screen=screen)
            s, t = np.array([w[r].sum() for r in p]), np.sort([w[r].sum() for r in u])
            rank = (np.searchsorted(t, s, side="left") + np.searchsorted(t, s, side="right")).mean()
            if rank > best + 1e-9:
                best, chosen = rank, (l1, screen)
    return fit_nnpu(pos, unl, prior, chosen[0], screen=chosen[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample of the rows given (they should be training rows only).

    The prior is the share of toxic rows among all labelled ones.  Without
    positives every weight is zero.
    """
    of = labels.filter(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    n, n_pos = of.agg(F.count("*"), F.sum("y")).first()
    if not n or not n_pos:
        return np.zeros(1 << BITS, np.float32), -2.0
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    some_pos = sample_ids(of.filter("y = 1").select(F.col(id_col).alias("doc_id")), "doc_id", positives)
    some_unl = sample_ids(text.select("doc_id"), "doc_id", unlabelled, seed=8)
    picked = some_pos.withColumn("kind", F.lit(1)).unionByName(some_unl.dropDuplicates().withColumn("kind", F.lit(0)))
    rows = text.join(F.broadcast(picked), "doc_id").select("kind", "text")  # at most positives + unlabelled ids

    def features(batches):
        for b in batches:
            buf, off = string_buffer(b.column(1))
            out = []
            for i, j in passes(off):
                r, s = distinct_slots(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                out += np.split(s.astype(np.int32), np.searchsorted(r, np.arange(1, j - i)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["kind", "slots"])

    found = rows.mapInArrow(features, "kind int, slots array<int>")
    # an id may be on any number of rows: what reaches the driver is bounded by rows
    part = lambda kind, n: found.filter(F.col("kind") == kind).orderBy(F.xxhash64("slots"), "slots").limit(n)
    got = part(1, positives).unionByName(part(0, unlabelled)).toArrow()
    kind, slots = got["kind"].to_numpy(), [np.asarray(x.values, np.int64) for x in got["slots"]]
    order = sorted(range(len(slots)), key=lambda k: (kind[k], zlib.crc32(slots[k].tobytes()), slots[k].tobytes()))  # the same fit in any task order
    return fit([slots[k] for k in order if kind[k] == 1], [slots[k] for k in order if kind[k] == 0], n_pos / n)


def score(docs: DataFrame, model: tuple[np.ndarray, float], cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= cut) for every row, in one narrow pass.

    A null or empty text has no words and gets the score of the bias alone.
    """
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS floats at any input size

    def run(batches):
        w = shared.value
        keep = w != 0
        for b in batches:
            buf, off = string_buffer(b.column(1))
            g = np.full(len(off) - 1, bias)
            for i, j in passes(off):
                r, s = distinct_slots(buf[off[i] : off[j]], off[i : j + 1] - off[i], keep)
                g[i:j] += np.bincount(r, w[s], j - i)
            p = sigmoid(g)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= cut).astype(np.int32))],
                                             ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, cut: float = 0.3) -> DataFrame:
    """Train outside the held fold of crc32(doc_id), score everything: doc_id, held_out, score, predicted.

    Rows with repeated ids are scored one by one; labels that are null don't
    count, repeated ones count once (1 if any is); other columns are not read.
    Empty tables give no rows, and without labels the score is constant.
    """
    model = train(docs.filter(crc_mod("doc_id", folds) != held_fold), labels.filter(crc_mod("doc_id", folds) != held_fold))
    out = score(docs, model, cut)
    return out.select("doc_id", (crc_mod("doc_id", folds) == held_fold).alias("held_out"), "score", "predicted")
