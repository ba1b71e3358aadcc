"""Model-evaluation metrics (A28-A34, W6) over a scored table.

Input: ``(label int 0/1, score double[, route int])``.  Every metric is one
partial-aggregated pass (conditional counts) or, for ROC, a pre-aggregation
per distinct score followed by the two-pass running total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexlens import config as C
from hexlens.operators.ranking import running_totals


def _cnt(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def confusion_counts(df: DataFrame, label: str = "label", score: str = "score",
                     threshold: float = C.PREDICTION_THRESHOLD) -> DataFrame:
    """One row ``tn, fp, fn, tp`` at ``score > threshold``."""
    pred = F.col(score) > threshold
    y = F.col(label) == 1
    return df.agg(_cnt(~y & ~pred).alias("tn"), _cnt(~y & pred).alias("fp"),
                  _cnt(y & ~pred).alias("fn"), _cnt(y & pred).alias("tp"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, label: str = "label", score: str = "score",
                          threshold: float = C.PREDICTION_THRESHOLD) -> DataFrame:
    """Per class precision/recall/f1/support, accuracy, macro and weighted avg.

    Zero division gives 0.  The accuracy row carries the value in ``f1``.
    """
    cm = confusion_counts(df, label, score, threshold)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    f0 = _safe_div(2 * p0 * r0, p0 + r0)
    f1 = _safe_div(2 * p1 * r1, p1 + r1)
    s0, s1 = tn + fp, fn + tp
    row = lambda name, p, r, f, s: F.struct(F.lit(name).alias("class_name"), p.cast("double").alias("precision"),
                                            r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                                            s.cast("bigint").alias("support"))
    rows = F.array(
        row("Benign", p0, r0, f0, s0),
        row("Malicious", p1, r1, f1, s1),
        row("accuracy", F.lit(None), F.lit(None), _safe_div(tn + tp, total), total),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, total),
        row("weighted avg", _safe_div(p0 * s0 + p1 * s1, total), _safe_div(r0 * s0 + r1 * s1, total),
            _safe_div(f0 * s0 + f1 * s1, total), total),
    )
    return cm.select(F.inline(rows))


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score",
                    start: float = 0.90, step: float = 0.01, count: int = 10) -> DataFrame:
    """Acc, precision, recall, FPR, TPR, FP at ``start + i*step``.

    One scan computes the four cells for every threshold as conditional
    counts (no join with a threshold table), then the small result is
    unpivoted.
    """
    y = F.col(label) == 1
    ts = [(i, start + i * step) for i in range(count)]
    cells = []
    for i, t in ts:
        pred = F.col(score) > F.lit(start) + F.lit(float(i)) * F.lit(step)
        cells += [_cnt(~y & ~pred).alias(f"tn{i}"), _cnt(~y & pred).alias(f"fp{i}"),
                  _cnt(y & ~pred).alias(f"fn{i}"), _cnt(y & pred).alias(f"tp{i}")]
    wide = df.agg(*cells)
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"tn{i}").alias("tn"), F.col(f"fp{i}").alias("fp"),
                              F.col(f"fn{i}").alias("fn"), F.col(f"tp{i}").alias("tp")) for i, _ in ts])
    long = wide.select(F.inline(rows))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return long.select(
        (F.lit(start) + F.col("i").cast("double") * F.lit(step)).alias("threshold"),
        _safe_div(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        _safe_div(tp, tp + fp).alias("precision"),
        _safe_div(tp, tp + fn).alias("recall"),
        _safe_div(fp, fp + tn).alias("fpr"),
        _safe_div(tp, tp + fn).alias("tpr"),
        fp.alias("fp"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One ROC point per distinct score, in descending score order.

    ``threshold, fpr, tpr`` with cumulative counts of rows scoring >= threshold
    (ties grouped).  Pre-aggregation per score shrinks the data before the
    global running total, which is computed in two passes (no single-task
    window).
    """
    per = df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("double").alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("double").alias("neg"))
    tot = per.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum = running_totals(per, [F.col("threshold").desc()], ["pos", "neg"])
    return (cum.crossJoin(F.broadcast(tot))  # one-row totals
               .select("threshold", "pos", "neg", "cum_pos", "cum_neg",
                       _safe_div(F.col("cum_neg"), F.col("N")).alias("fpr"),
                       _safe_div(F.col("cum_pos"), F.col("P")).alias("tpr"), "P", "N"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Trapezoidal area under the ROC curve (ties as one segment)."""
    pts = roc_points(df, label, score)
    seg = (F.col("neg") / F.col("N")) * (2 * F.col("cum_pos") - F.col("pos")) / (2 * F.col("P"))
    return pts.agg(F.when(F.first("P") * F.first("N") > 0, F.sum(seg)).alias("auc"),
                   F.count(F.lit(1)).alias("points"))


def score_histogram(df: DataFrame, label: str = "label", score: str = "score",
                    bins: int = C.EVAL_HIST_BINS) -> DataFrame:
    """Per class, ``bins`` equal bins over that class's [min, max], right edge closed.

    Follows numpy's binning: floor((s-min)*bins/(max-min)), corrected against
    the edges ``min + i*(max-min)/bins``; a constant class uses [v-0.5, v+0.5].
    Non-empty bins only.
    """
    rng = df.groupBy(label).agg(F.min(score).alias("_lo0"), F.max(score).alias("_hi0"))
    rng = rng.select(label,
                     F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
                     F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
    j = df.select(label, score).join(F.broadcast(rng), label)  # one row per class
    width = (F.col("_hi") - F.col("_lo")) / bins
    i0 = F.least(F.floor((F.col(score) - F.col("_lo")) * (F.lit(bins) / (F.col("_hi") - F.col("_lo")))),
                 F.lit(bins - 1))
    edge = lambda i: F.col("_lo") + i * width
    i1 = F.when(F.col(score) < edge(i0), i0 - 1).when(
        (F.col(score) >= edge(i0 + 1)) & (i0 != bins - 1), i0 + 1).otherwise(i0)
    return (j.withColumn("bin", i1.cast("int"))
             .groupBy(label, "bin").agg(F.count(F.lit(1)).alias("n"), F.first(edge(F.col("bin"))).alias("bin_left")))


def routing_stats(df: DataFrame, route: str = "route") -> DataFrame:
    """Total, normal, packed, packed ratio."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.sum(F.when(F.col(route) == 0, 1).otherwise(0)).cast("bigint").alias("normal"),
                  F.sum(F.when(F.col(route) == 1, 1).otherwise(0)).cast("bigint").alias("packed"),
                  F.avg((F.col(route) == 1).cast("double")).alias("packed_ratio"))


def false_positives(df: DataFrame, key: str, label: str = "label", score: str = "score",
                    threshold: float = C.PREDICTION_THRESHOLD) -> DataFrame:
    """All false positives (label 0, predicted 1) with their total."""
    fp = df.where((F.col(label) == 0) & (F.col(score) > threshold))
    total = fp.agg(F.count(F.lit(1)).alias("fp_total"))  # one row
    return fp.select(key, score).crossJoin(F.broadcast(total))
