"""Evaluation-metric queries over a scored table derived from ``labels`` + ``documents``.

Stand-in (SURVEY §7.3): label = ``labels.toxic``; score = ``(n_chars % 1000)/1000``,
a deterministic function of the row so an exact oracle exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexlens.catalog import register
from hexlens.operators import metrics as M
from hexlens.plans.corpus import round6
from hexlens.plans.sqlparts import r6
from hexlens.sources.tables import table

SCORED_CTE = """scored AS (
  SELECT d.doc_id, d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.' || d.lang AS path,
         l.toxic AS label, (d.n_chars % 1000) / 1000.0::DOUBLE AS score
  FROM labels l JOIN documents d USING (doc_id)
)"""
CM_CTE = SCORED_CTE + """,
cm AS (
  SELECT count_if(label <> 1 AND NOT score > 0.98)::BIGINT AS tn, count_if(label <> 1 AND score > 0.98)::BIGINT AS fp,
         count_if(label = 1 AND NOT score > 0.98)::BIGINT AS fn, count_if(label = 1 AND score > 0.98)::BIGINT AS tp
  FROM scored
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return lab.join(docs, "doc_id").select(
        "doc_id",
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang")).alias("path"),
        F.col("toxic").alias("label"),
        ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("score"))


@register("confusion_matrix", operators=("A28", "P5"), sql=f"WITH {CM_CTE} SELECT * FROM cm")
def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion_counts(scored(spark, sf_dir))


def _sdiv(a, b):
    return f"CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"


@register("classification_report", operators=("A29",), sql=f"""
WITH {CM_CTE},
pr AS (
  SELECT *, {_sdiv('tn', 'tn + fn')} AS p0, {_sdiv('tn', 'tn + fp')} AS r0,
            {_sdiv('tp', 'tp + fp')} AS p1, {_sdiv('tp', 'tp + fn')} AS r1,
            tn + fp AS s0, fn + tp AS s1, tn + fp + fn + tp AS total FROM cm
),
f AS (SELECT *, {_sdiv('2 * p0 * r0', 'p0 + r0')} AS f0, {_sdiv('2 * p1 * r1', 'p1 + r1')} AS f1 FROM pr)
SELECT 'Benign' AS class_name, {r6('p0')} AS precision, {r6('r0')} AS recall, {r6('f0')} AS f1, s0::BIGINT AS support FROM f
UNION ALL SELECT 'Malicious', {r6('p1')}, {r6('r1')}, {r6('f1')}, s1::BIGINT FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, {r6(_sdiv('tn + tp', 'total'))}, total::BIGINT FROM f
UNION ALL SELECT 'macro avg', {r6('(p0 + p1) / 2')}, {r6('(r0 + r1) / 2')}, {r6('(f0 + f1) / 2')}, total::BIGINT FROM f
UNION ALL SELECT 'weighted avg', {r6(_sdiv('p0 * s0 + p1 * s1', 'total'))}, {r6(_sdiv('r0 * s0 + r1 * s1', 'total'))},
                 {r6(_sdiv('f0 * s0 + f1 * s1', 'total'))}, total::BIGINT FROM f
""")
def q_classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round6(M.classification_report(scored(spark, sf_dir)), ["precision", "recall", "f1"])


@register("false_positives", operators=("A30",), sql=f"""
WITH {SCORED_CTE},
fp AS (SELECT path, score FROM scored WHERE label = 0 AND score > 0.98)
SELECT path, {r6('score')} AS score, (SELECT count(*) FROM fp)::BIGINT AS fp_total
FROM fp
""")
def q_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round6(M.false_positives(scored(spark, sf_dir), "path"), ["score"])


@register("threshold_sweep", operators=("A32",), sql=f"""
WITH {SCORED_CTE},
t AS (SELECT i, 0.9::DOUBLE + i::DOUBLE * 0.01::DOUBLE AS thr FROM range(10) r(i)),
c AS (
  SELECT t.i, t.thr,
         count_if(s.label <> 1 AND NOT s.score > t.thr) AS tn, count_if(s.label <> 1 AND s.score > t.thr) AS fp,
         count_if(s.label = 1 AND NOT s.score > t.thr) AS fn, count_if(s.label = 1 AND s.score > t.thr) AS tp
  FROM t, scored s GROUP BY t.i, t.thr
)
SELECT {r6('thr')} AS threshold, {r6(_sdiv('tn + tp', 'tn + fp + fn + tp'))} AS accuracy,
       {r6(_sdiv('tp', 'tp + fp'))} AS precision, {r6(_sdiv('tp', 'tp + fn'))} AS recall,
       {r6(_sdiv('fp', 'fp + tn'))} AS fpr, {r6(_sdiv('tp', 'tp + fn'))} AS tpr, fp::BIGINT AS fp
FROM c
""")
def q_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.threshold_sweep(scored(spark, sf_dir))
    return round6(out, ["threshold", "accuracy", "precision", "recall", "fpr", "tpr"])


_ROC_CTE = SCORED_CTE + """,
per AS (SELECT score AS threshold, count_if(label = 1)::DOUBLE AS pos, count_if(label <> 1)::DOUBLE AS neg
        FROM scored GROUP BY score),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM per),
cum AS (SELECT threshold, pos, neg,
               sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
               sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
        FROM per)"""


@register("roc_curve", operators=("W6", "A31"), sql=f"""
WITH {_ROC_CTE}
SELECT {r6('threshold')} AS threshold, {r6(_sdiv('cum_neg', 'N'))} AS fpr, {r6(_sdiv('cum_pos', 'P'))} AS tpr
FROM cum, tot
""")
def q_roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = M.roc_points(scored(spark, sf_dir)).select("threshold", "fpr", "tpr")
    return round6(pts, ["threshold", "fpr", "tpr"])


@register("roc_auc", operators=("A31", "W6"), sql=f"""
WITH {_ROC_CTE}
SELECT {r6('CASE WHEN P * N > 0 THEN sum((neg / N) * (2 * cum_pos - pos) / (2 * P)) END')} AS auc,
       count(*)::BIGINT AS points
FROM cum, tot GROUP BY P, N
""")
def q_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round6(M.roc_auc(scored(spark, sf_dir)), ["auc"])


@register("score_histogram", operators=("A33",), sql=f"""
WITH {SCORED_CTE},
rng0 AS (SELECT label, min(score) AS lo0, max(score) AS hi0 FROM scored GROUP BY label),
rng AS (SELECT label, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
               CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM rng0),
j AS (SELECT s.label, s.score, r.lo, r.hi, (r.hi - r.lo) / 100 AS w,
             least(floor((s.score - r.lo) * (100 / (r.hi - r.lo))), 99) AS i0
      FROM scored s JOIN rng r USING (label)),
b AS (SELECT label, lo, w, CASE WHEN score < lo + i0 * w THEN i0 - 1
                            WHEN score >= lo + (i0 + 1) * w AND i0 <> 99 THEN i0 + 1 ELSE i0 END AS bin FROM j)
SELECT label, CAST(bin AS INTEGER) AS bin, count(*)::BIGINT AS n, {r6('min(lo + bin * w)')} AS bin_left
FROM b GROUP BY label, bin
""")
def q_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round6(M.score_histogram(scored(spark, sf_dir)), ["bin_left"])


@register("scan_summary", operators=("P5",), sql=f"""
WITH {SCORED_CTE},
v AS (SELECT split_part(path, '/', 1) AS source, score > 0.98 AS is_malware,
             CASE WHEN score > 0.98 THEN score ELSE 1.0 - score END AS confidence FROM scored)
SELECT source, count(*)::BIGINT AS files, count_if(is_malware)::BIGINT AS malware,
       {r6('avg(confidence)')} AS avg_confidence, {r6('min(confidence)')} AS min_confidence
FROM v GROUP BY source
""")
def q_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts (strictly above 0.98) and confidences, summarised per source folder."""
    from hexlens.functions.routing import verdict
    s = scored(spark, sf_dir)
    is_mal, conf = verdict("score")
    v = s.select(F.split("path", "/")[0].alias("source"), is_mal.alias("is_malware"), conf.alias("confidence"))
    out = v.groupBy("source").agg(F.count(F.lit(1)).alias("files"),
                                  F.sum(F.col("is_malware").cast("int")).cast("bigint").alias("malware"),
                                  F.avg("confidence").alias("avg_confidence"),
                                  F.min("confidence").alias("min_confidence"))
    return round6(out, ["avg_confidence", "min_confidence"])


@register("malicious_only", operators=("P4", "A22"), sql=f"""
WITH {SCORED_CTE}
SELECT path, {r6('score')} AS score, (SELECT count_if(label = 1) FROM scored)::BIGINT AS n_malicious,
       (SELECT count_if(label <> 1) FROM scored)::BIGINT AS n_benign
FROM scored WHERE label = 1
""")
def q_malicious_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malicious rows (label 1) with the counts of both classes (one pass for the counts)."""
    s = scored(spark, sf_dir)
    counts = s.agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("bigint").alias("n_malicious"),
                   F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).cast("bigint").alias("n_benign"))
    return round6(s.where("label = 1").select("path", "score").crossJoin(F.broadcast(counts)), ["score"])
