"""Op 4: language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams of the lower-cased
text, normalised to sum to one, so that a text's scores are weighted means
over its n-grams and are summed up without a sort.  Document frequencies come
from every training text.  The weights are fitted by follow-the-regularised-
leader with elastic-net penalties on a bounded sample of each language, and
the probabilities are calibrated by a temperature on rows left out of the fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexlens.llm import hashing
from hexlens.llm.common import crc_mod
from hexlens.llm.learning import fit_temperature, softmax

#: Longest n-gram, slots that n-grams are hashed to, most labelled rows of a language that the fit takes.
LONGEST, BITS, SAMPLE = 3, 15, 1000
#: Most frequent languages that are told apart, at most: each has 2**BITS weights.
LANGUAGES = 500
#: Characters of one numpy pass.
PASS_CHARS = 1 << 19
#: Scale of the features, for the learning rate.
SCALE = 30.0


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def text_passes(texts: list[str | None]):
    """(first row, lower-cased texts) of about PASS_CHARS characters each."""
    at, own, size = 0, [], 0
    for k, t in enumerate(texts):
        t = (t or "").lower()
        if own and size + len(t) > PASS_CHARS:
            yield at, own
            at, own, size = k, [], 0
        own.append(t)
        size += len(t)
    if own:
        yield at, own


def ngram_slots(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Slots of the n-grams from each character, one array an order (-1: it ends beyond its text), and offsets."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    out, v = [], cp.copy()
    for k in range(1, LONGEST + 1):
        if k > 1:
            v = v[:-1] * np.uint32(0x01000193) + cp[k - 1 :] if len(cp) >= k else np.zeros(0, np.uint32)
        h = (v ^ (v >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
        slot = ((h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39) >> np.uint32(32 - BITS)).astype(np.int32)
        out.append(slot)
    return out, off


def row_slots(slots: list[np.ndarray], off: np.ndarray, r: int) -> np.ndarray:
    return np.concatenate([s[off[r] : max(off[r], off[r + 1] - k)] for k, s in enumerate(slots)])


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts that hold each slot; summed by Spark, 2**BITS rows at most on the driver."""
    def count(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        seen = np.zeros(1 << BITS, bool)
        for b in batches:
            for _, own in text_passes(b.column(0).to_pylist()):
                slots, off = ngram_slots(own)
                for r in range(len(own)):
                    seen[:] = False
                    seen[row_slots(slots, off, r)] = True
                    df += seen
                n += len(own)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], n))], ["slot", "n"])

    got = texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = got["slot"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(1 << BITS, np.int64)
    df[slot[slot >= 0]] = n[slot >= 0]
    return int(n[slot < 0].sum()), df


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 4, alpha: float = 0.5,
             beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights (slots x classes) by per-coordinate FTRL-proximal; each row is (slots, values)."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    w = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    order = np.random.default_rng(3)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            s, x = rows[r]
            own = w(z[s], n[s])
            p = softmax((x @ own)[None, :])[0]
            p[y[r]] -= 1
            g = np.outer(x, p)
            z[s] += g - (np.sqrt(n[s] + g * g) - np.sqrt(n[s])) / alpha * own
            n[s] += g * g
    return w(z, n)


class Model:
    """Learned languages, slot weights times IDF, IDF, and the temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float):
        self.langs, self.temperature = langs, temperature
        self.idf = idf.astype(np.float32)
        self.weights = (weights * idf[:, None] * SCALE).astype(np.float32)

    def logits(self, texts: list[str]) -> np.ndarray:
        slots, off = ngram_slots(texts)
        top, norm = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for k, s in enumerate(slots):
            last = np.maximum(off[1:] - k, off[:-1])
            cuts = np.stack((off[:-1], last), axis=1).ravel()  # n-grams that begin in [off, last) are the row's
            some = last > off[:-1]
            if not some.any():
                continue
            edges = cuts.reshape(-1, 2)[some].ravel()
            stop = edges[-1] == len(s)
            e = edges[:-1] if stop else edges
            top[some] += np.add.reduceat(self.weights[s], e, axis=0, dtype=np.float64)[::2]
            norm[some] += np.add.reduceat(self.idf[s], e, dtype=np.float64)[::2]
        return top / np.maximum(norm, 1e-9)[:, None]


def train(docs: DataFrame, sample: int = SAMPLE, epochs: int = 4, languages: int = LANGUAGES) -> Model | None:
    """Fit on the rows given (training rows only: doc_id, text, lang); None if no row has a language.

    The classes are the ``languages`` most frequent values of lang; equal texts
    of one id and language are one row of the sample.
    """
    docs = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    count, df = document_frequencies(docs)
    if not count:
        return None
    idf = np.log((1 + count) / (1 + df)) + 1
    # the first rows of each language by a hash: a threshold leaves about three times as many as are ranked
    place = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    counts = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    same = F.xxhash64("text").alias("same")
    near = docs.select("doc_id", "lang", same, place.alias("place")).join(F.broadcast(counts), "lang").filter(
        F.col("place") < 3.0 * sample / F.col("count")).dropDuplicates(["doc_id", "lang", "same"])  # an id may be on any number of rows
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "same"))
    ids = near.withColumn("rank", rank).filter(F.col("rank") <= sample).select("doc_id", "lang", "same")
    rows = docs.withColumn("same", same).join(F.broadcast(ids), ["doc_id", "lang", "same"])  # repeats of ``sample`` rows a language

    def features(batches):
        for b in batches:
            out_s, out_n = [], []
            for _, own in text_passes(b.column(2).to_pylist()):
                slots, off = ngram_slots(own)
                for r in range(len(own)):
                    s, n = np.unique(row_slots(slots, off, r), return_counts=True)
                    out_s.append(s)
                    out_n.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out_s, pa.list_(pa.int32())), pa.array(out_n, pa.list_(pa.int32())), b.column(3)],
                                             ["doc_id", "lang", "slots", "n", "same"])

    got = (rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", "same")
           .mapInArrow(features, "doc_id long, lang string, slots array<int>, n array<int>, same long").dropDuplicates(["doc_id", "lang", "same"])
           .toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("same", "ascending")]))
    langs = sorted(set(got["lang"].to_pylist()))
    y = np.array([langs.index(v) for v in got["lang"].to_pylist()])
    x = []
    for s, n in zip(got["slots"], got["n"], strict=True):
        s, v = np.asarray(s.values, np.int64), np.asarray(n.values, np.float64)
        v = v * idf[s]
        x.append((s, SCALE * v / max(v.sum(), 1e-9)))
    late = np.flatnonzero(np.arange(len(x)) % 6 == 5)
    early = np.setdiff1d(np.arange(len(x)), late)
    weights = fit_ftrl([x[k] for k in early], y[early], len(langs), epochs)
    temperature = 1.0
    if len(late) and len(langs) > 1:
        z = np.stack([x[k][1] @ weights[x[k][0]] for k in late])
        temperature = fit_temperature(lambda t: -np.mean(np.log(softmax(z / t)[np.arange(len(late)), y[late]] + 1e-12)))
    return Model(langs, weights, idf, temperature)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every row; ``und`` with score 0 where there is no letter or no model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS x languages floats

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for at, own in text_passes(texts) if m else ():
                p = softmax(m.logits(own) / m.temperature)
                best = p.argmax(axis=1)
                for r in range(len(own)):
                    if has_letter(texts[at + r]):
                        lang[at + r], score[at + r] = m.langs[best[r]], p[r, best[r]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """Train outside the held fold of crc32(doc_id), predict everything: doc_id, held_out, lang_pred, score.

    Null texts and null languages teach nothing; a text that is null or has no
    letter is ``und``.  Rows with repeated ids are predicted one by one; other
    columns are not read; an empty table gives no rows.
    """
    held = crc_mod("doc_id", folds) == held_fold
    return predict(docs, train(docs.filter(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score")
