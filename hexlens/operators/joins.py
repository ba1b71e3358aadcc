"""Lookup / anti / keyword joins and set operations.

Join sides are projected to their keys before any shuffle, so file bytes are
never shuffled: a cache lookup moves ``(sha256, verdict)`` rows, not content.
Broadcast hints are only used for sides whose size is fixed (keyword lists,
one-row tables); everything else is left to AQE, which switches to a
broadcast at runtime when the measured side is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexlens import config as C


def cache_lookup(files: DataFrame, cache: DataFrame, key: str = "sha256", hit: str = "cache_hit") -> DataFrame:
    """Every file with the cached verdict columns (null on a miss) and the marker ``hit``.

    One left join on key rows: hits reuse the verdict (the current path is
    kept, quirk Q7 fixed), misses are the work set.  Keys of one very common
    content are split by AQE's skew join.
    """
    c = cache.dropDuplicates([key]).withColumn(hit, F.lit(True))
    return files.join(c, key, "left").withColumn(hit, F.coalesce(hit, F.lit(False)))


def dedupe_content(df: DataFrame, key: str = "sha256", order: str = "path", copies: str | None = None) -> DataFrame:
    """One row per content key, the representative is the smallest ``order`` value; ``copies`` names a count.

    Use on compact rows (features, verdicts): equal content gives equal
    features, so bytes never need to be shuffled for deduplication.
    """
    others = [c for c in df.columns if c != key]
    count = [F.count(F.lit(1)).alias(copies)] if copies else []
    return (df.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r"), *count)
              .select(key, "_r.*", *([copies] if copies else [])))


def fp_weight(train: DataFrame, false_pos: DataFrame, key: str, iteration: int = 0,
              incremental: bool = False) -> DataFrame:
    """weight = min(5 + 3*iteration, 100) (10 when incremental) for known FPs, else 1."""
    w = C.FP_WEIGHT_INCREMENTAL if incremental else min(C.FP_WEIGHT_BASE + C.FP_WEIGHT_GROWTH_PER_ITER * iteration,
                                                         C.FP_WEIGHT_MAX)
    fp = false_pos.select(F.col(key).alias("_fpk")).distinct()
    j = train.join(fp, train[key] == fp["_fpk"], "left")
    return j.withColumn("weight", F.when(F.col("_fpk").isNotNull(), F.lit(float(w))).otherwise(F.lit(1.0))).drop("_fpk")


def keyword_hits(text, keywords: list[str]) -> Column:
    """Number of listed keywords contained in ``lower(text)``.

    The keyword list is fixed at plan time, so the 'join' is a sum of
    ``contains`` tests - one codegen'd expression, no join, no shuffle.
    """
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    if not keywords:
        return F.lit(0)
    return sum(F.when(F.instr(t, kw.lower()) > 0, 1).otherwise(0) for kw in keywords)


def keyword_hits_sql(text_sql: str, keywords: list[str]) -> Column:
    """J6 as one SQL expression over a SQL text expression (cheap to plan for long lists)."""
    if not keywords:
        return F.lit(0)
    t = f"lower({text_sql})"
    body = " + ".join(f"CASE WHEN instr({t}, '{kw.lower()}') > 0 THEN 1 ELSE 0 END" for kw in keywords)
    return F.expr(f"({body})")


def any_keyword(text, keywords: list[str]) -> Column:
    return keyword_hits(text, keywords) > 0


def key_intersect(*tables: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Keys present in every table (inner joins on distinct keys)."""
    out = tables[0].select(key).distinct()
    for t in tables[1:]:
        out = out.join(t.select(key).distinct(), key, "inner")
    return out


def skip_existing(candidates: DataFrame, existing: DataFrame, key: str = "sha256") -> DataFrame:
    """Candidates whose key is not already stored (left anti)."""
    return candidates.join(existing.select(key).distinct(), key, "left_anti")


def merge_maps(older: DataFrame, newer: DataFrame, key: str, value: str) -> DataFrame:
    """Union of two key->value maps, the newer value wins."""
    u = (older.select(key, value, F.lit(0).alias("_v"))
              .unionByName(newer.select(key, value, F.lit(1).alias("_v"))))
    return u.groupBy(key).agg(F.max_by(value, "_v").alias(value))
