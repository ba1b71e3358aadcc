"""Global ordering primitives that never put a whole group in one task.

A window without ``partitionBy`` (or partitioned by a hot key) sends all of
its rows to one task.  These helpers use the two-pass form instead:

1. range-partition on (group, order) - the sampler splits a hot group across
   many partitions because the order columns vary inside it;
2. number rows inside each sorted partition (``monotonically_increasing_id``
   is consecutive inside a partition), and aggregate per (partition, group)
   counts - a table of at most #groups + #partitions rows;
3. add the per-(partition, group) offsets back with a join.

The numbered (or locally accumulated) rows are written once to the shared
checkpoint folder before the two branches read them, so the per-partition
offsets and the rows always agree - even if an executor is lost and a stage
is recomputed with a different row order.  Used by exact per-group
quantiles (A27), ROC cumulative counts (W6) and noise-id numbering (W7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexlens.session import materialize


def _partitions(df: DataFrame, n: int | None) -> int:
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def rank_within_group(df: DataFrame, group_cols: list[str], order_cols: list[Column | str],
                      out: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """0-based row number of each row inside its group, ordered by ``order_cols``.

    Group keys must be non-null.  Ties get distinct consecutive numbers.
    """
    keys = [F.col(g) for g in group_cols] + [F.col(o) if isinstance(o, str) else o for o in order_cols]
    s = (df.repartitionByRange(_partitions(df, num_partitions), *keys)
           .sortWithinPartitions(*keys)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id()))
    s = materialize(s, "rank-within-group")
    stats = s.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    ranked = s.join(stats.select("_pid", *group_cols, "_off", "_first"), ["_pid", *group_cols])
    return ranked.withColumn(out, F.col("_off") + F.col("_mid") - F.col("_first")).drop(
        "_pid", "_mid", "_off", "_first")


def counted_values(df: DataFrame, group_cols: list[str], value: str, num_partitions: int | None = None) -> DataFrame:
    """Distinct values of each group with their count ``_c`` and the cumulative count ``_cum`` in ascending order.

    Rows are aggregated to (group, value, count) before they are ranged, so a
    group of many equal values is one row; the cumulative counts of a group
    that spans partitions are local sums plus the offsets of earlier ones.
    """
    per = df.groupBy(*group_cols, value).agg(F.count(F.lit(1)).alias("_c"))
    keys = [*group_cols, value]
    s = (per.repartitionByRange(_partitions(df, num_partitions), *keys).sortWithinPartitions(*keys)
            .withColumn("_pid", F.spark_partition_id()))
    schema = T.StructType([*s.schema.fields, T.StructField("_cum", T.LongType())])

    def local(batches):
        last, carry = None, 0
        for pdf in batches:
            if pdf.empty:
                continue
            own = pdf.groupby(group_cols, sort=False, dropna=False)
            pdf["_cum"] = own["_c"].cumsum()
            ids = list(pdf[group_cols].itertuples(index=False, name=None))
            if ids[0] == last:  # the group goes on from the batch before
                pdf.loc[own.ngroup() == 0, "_cum"] += carry
            last, carry = ids[-1], int(pdf["_cum"].iloc[-1])
            yield pdf

    s = materialize(s.mapInPandas(local, schema), "counted-values")
    totals = s.groupBy("_pid", *group_cols).agg(F.sum("_c").alias("_t"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    return s.join(totals.select("_pid", *group_cols, "_off"), ["_pid", *group_cols]).withColumn(
        "_cum", F.col("_cum") + F.col("_off")).drop("_pid", "_off")


def group_quantile(df: DataFrame, group_cols: list[str], value: str, q: float, out: str) -> DataFrame:
    """Exact numpy-style (linear) quantile of ``value`` per group.

    Equivalent to ``percentile(value, q)`` but with bounded memory per task:
    a hot group is counted across partitions, and only the values at the two
    interpolation ranks survive the filter.
    """
    base = df.select(*group_cols, value).where(F.col(value).isNotNull())
    ranked = counted_values(base, group_cols, value)
    counts = ranked.groupBy(*group_cols).agg(F.sum("_c").alias("_n"))
    at = lambda k: (F.col("_cum") - F.col("_c") <= F.col(k)) & (F.col(k) < F.col("_cum"))
    sel = (ranked.join(counts, group_cols).withColumn("_pos", (F.col("_n") - 1) * F.lit(q))
                 .withColumn("_k0", F.floor("_pos")).withColumn("_k1", F.least(F.col("_k0") + 1, F.col("_n") - 1))
                 .where(at("_k0") | at("_k1")))
    agg = sel.groupBy(*group_cols).agg(F.max(F.when(at("_k0"), F.col(value))).alias("_v0"), F.max(F.when(at("_k1"), F.col(value))).alias("_v1"),
                                       F.first("_pos").alias("_pos"), F.first("_k0").alias("_k0"))
    return agg.select(*group_cols, (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_pos") - F.col("_k0"))).alias(out))


def running_totals(df: DataFrame, order_cols: list[Column], sum_cols: list[str],
                   num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in global ``order_cols`` order.

    Per-partition cumulative sums run in ``mapInPandas`` over range-sorted
    partitions (no extra shuffle); per-partition totals (one row per
    partition) give the offsets, joined back by broadcast - their size is the
    partition count, a proven bound.
    """
    s = (df.repartitionByRange(_partitions(df, num_partitions), *order_cols)
           .sortWithinPartitions(*order_cols)
           .withColumn("_pid", F.spark_partition_id()))
    schema = T.StructType(list(s.schema.fields) + [T.StructField(f"_cum_{c}", T.DoubleType()) for c in sum_cols])

    def local_cumsum(batches):
        carry: dict[int, dict[str, float]] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            pid = int(pdf["_pid"].iloc[0])
            prev = carry.setdefault(pid, {c: 0.0 for c in sum_cols})
            for c in sum_cols:
                cs = pdf[c].astype("float64").cumsum() + prev[c]
                pdf[f"_cum_{c}"] = cs
                prev[c] = float(cs.iloc[-1])
            yield pdf

    local = materialize(s.mapInPandas(local_cumsum, schema), "running-totals")
    totals = local.groupBy("_pid").agg(*[F.sum(F.col(c).cast("double")).alias(f"_tot_{c}") for c in sum_cols])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0.0)).alias(f"_off_{c}")
                                      for c in sum_cols])
    joined = local.join(F.broadcast(offsets), "_pid")
    for c in sum_cols:
        joined = joined.withColumn(f"cum_{c}", F.col(f"_cum_{c}") + F.col(f"_off_{c}"))
    return joined.drop("_pid", *[f"_cum_{c}" for c in sum_cols], *[f"_off_{c}" for c in sum_cols])

