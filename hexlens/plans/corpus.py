"""Queries over the file corpus (``documents`` seen as files): byte features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexlens import config as C
from hexlens.catalog import register
from hexlens.functions.bytes import slice_profiles
from hexlens.functions.routing import sigmoid_gate
from hexlens.operators import byte_stats as B
from hexlens.plans.sqlparts import FILES_CTE, bytes_cte, entropy_sql, r6
from hexlens.sources.tables import documents_as_files


def round6(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


# ---------------------------------------------------------------------------
# Flagship: hash -> dedupe -> block entropy -> gate -> routing stats per source
# ---------------------------------------------------------------------------

def routed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per distinct content: representative path/source, high-entropy ratio, route.

    Features depend only on content, so they are computed per file (narrow)
    and the compact rows - never the bytes - are deduplicated by sha256
    (one partial-aggregated shuffle of ~100 bytes per file).
    """
    f = documents_as_files(spark, sf_dir).select("path", "source", "length", "content")
    f = f.withColumn("sha256", F.sha2("content", 256))
    fa = B.file_attributes(f)
    fa = fa.withColumn("route", sigmoid_gate("high_entropy_ratio", 0.0, 0.0))
    rep = F.min_by(F.struct("path", "source", "route", "high_entropy_ratio"), "path")
    return (fa.select("sha256", "path", "source", "route", "high_entropy_ratio")
              .groupBy("sha256").agg(rep.alias("r"))
              .select("sha256", "r.*"))


@register("routing_by_source", operators=("F1", "U3", "A8", "A9", "F11", "A34"), sql=f"""
WITH {FILES_CTE},
sample AS (SELECT doc_id, path, source, sha256(content) AS sha256, content FROM files),
{bytes_cte('sb', 'sample')},
meta AS (SELECT doc_id, n AS m, CASE WHEN n > 0 THEN least(10, greatest(1, n // 2048)) ELSE 0 END AS k FROM sb_hex),
blk AS (SELECT s.doc_id, least(s.pos // (m.m // m.k), m.k - 1) AS blk, s.b FROM sb s JOIN meta m USING (doc_id)),
cnt AS (SELECT doc_id, blk, b, count(*) AS c FROM blk GROUP BY ALL),
tot AS (SELECT doc_id, blk, sum(c) AS t FROM cnt GROUP BY ALL),
ent AS (SELECT doc_id, blk, {entropy_sql('c', 't')} AS e FROM cnt JOIN tot USING (doc_id, blk) GROUP BY doc_id, blk),
he AS (
  SELECT m.doc_id,
         CASE WHEN m.k > 0 THEN coalesce(sum(CASE WHEN e.e > 0.8 THEN 1 ELSE 0 END), 0)::DOUBLE / m.k ELSE 0.0 END AS he
  FROM meta m LEFT JOIN ent e USING (doc_id) GROUP BY m.doc_id, m.k
),
routed AS (
  SELECT s.sha256, s.path, s.source, h.he,
         CASE WHEN 1.0 / (1.0 + exp(-10.0 * greatest(h.he - 0.8, 0.0 - 0.3, 0.0 - 0.1))) > 0.5 THEN 1 ELSE 0 END AS route
  FROM sample s JOIN he h USING (doc_id)
),
uniq AS (
  SELECT sha256, arg_min(source, path) AS source, arg_min(route, path) AS route, arg_min(he, path) AS he
  FROM routed GROUP BY sha256
)
SELECT source, count(*)::BIGINT AS files, sum(1 - route)::BIGINT AS normal, sum(route)::BIGINT AS packed,
       {r6('avg(route)')} AS packed_ratio, {r6('avg(he)')} AS avg_high_entropy_ratio
FROM uniq GROUP BY source
""")
def routing_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = routed_files(spark, sf_dir)
    out = u.groupBy("source").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(1 - F.col("route")).cast("bigint").alias("normal"),
        F.sum("route").cast("bigint").alias("packed"),
        F.avg("route").alias("packed_ratio"),
        F.avg("high_entropy_ratio").alias("avg_high_entropy_ratio"),
    )
    return round6(out, ["packed_ratio", "avg_high_entropy_ratio"])


# ---------------------------------------------------------------------------
# A1 byte histogram (whole content), long form
# ---------------------------------------------------------------------------

@register("byte_histogram", operators=("A1",), sql=f"""
WITH {FILES_CTE},
{bytes_cte('hb', 'files')}
SELECT doc_id, b, count(*)::BIGINT AS cnt FROM hb GROUP BY doc_id, b
""")
def q_byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = documents_as_files(spark, sf_dir).select("doc_id", "content")
    h = B.byte_histogram(f, "content").select("doc_id", F.posexplode("hist").alias("b", "cnt"))
    return h.where("cnt > 0").select("doc_id", F.col("b").cast("int").alias("b"), F.col("cnt").cast("bigint"))


# ---------------------------------------------------------------------------
# S3 + A2-A5 over whole contents, and the bounded window of S3
# ---------------------------------------------------------------------------

WINDOW_BOUND = 4096
WIN_STATS = ["mean", "std", "min", "max", "median", "q25", "q75", "count_zero", "count_ff",
             "count_nop", "count_printable", "entropy"]


def _window_stats(spark, sf_dir, bound=None):
    f = documents_as_files(spark, sf_dir).select("doc_id", "content")
    w = B.byte_window(f, "content", bound)
    return B.byte_statistics(w, "window")


def _win_sql(bound=None):
    limit = "n" if bound is None else str(bound - 8)
    return f"""
WITH {FILES_CTE},
{bytes_cte('wb', 'files', 8, limit)},
wn AS (SELECT doc_id, CAST(greatest(least(n - 8, {limit}), 0) AS BIGINT) AS n FROM wb_hex)"""


_WIN_STATS_SQL = f""",
agg AS (
  SELECT doc_id, avg(b) AS mean, stddev_pop(b) AS std, min(b) AS mn, max(b) AS mx,
         quantile_cont(b, 0.5) AS median, quantile_cont(b, 0.25) AS q25, quantile_cont(b, 0.75) AS q75,
         count_if(b = 0) AS c0, count_if(b = 255) AS cff, count_if(b = 144) AS cnop,
         count_if(b BETWEEN 32 AND 126) AS cpr
  FROM wb GROUP BY doc_id
),
cnt AS (SELECT doc_id, b, count(*) AS c FROM wb GROUP BY ALL),
ent AS (SELECT cnt.doc_id, {entropy_sql('c', 'wn.n')} AS e FROM cnt JOIN wn USING (doc_id) GROUP BY cnt.doc_id)
SELECT wn.doc_id, CAST(wn.n AS INTEGER) AS orig_length,
  {r6('coalesce(mean, 0)')} AS mean, {r6('coalesce(std, 0)')} AS std,
  {r6('coalesce(mn, 0)')} AS min, {r6('coalesce(mx, 0)')} AS max,
  {r6('coalesce(median, 0)')} AS median, {r6('coalesce(q25, 0)')} AS q25, {r6('coalesce(q75, 0)')} AS q75,
  {r6('coalesce(c0, 0)')} AS count_zero, {r6('coalesce(cff, 0)')} AS count_ff,
  {r6('coalesce(cnop, 0)')} AS count_nop, {r6('coalesce(cpr, 0)')} AS count_printable,
  {r6('coalesce(e, 0)')} AS entropy
FROM wn LEFT JOIN agg USING (doc_id) LEFT JOIN ent USING (doc_id)
"""


@register("byte_window_stats", operators=("A2", "A3", "A4", "A5"), sql=_win_sql() + _WIN_STATS_SQL)
def byte_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _window_stats(spark, sf_dir)
    return round6(s.select("doc_id", "orig_length", *WIN_STATS), WIN_STATS)


@register("byte_window_bounded", operators=("S3",), sql=_win_sql(WINDOW_BOUND) + _WIN_STATS_SQL)
def byte_window_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's bounded window as an explicit parameter (4 KiB here, so that texts are longer)."""
    s = _window_stats(spark, sf_dir, WINDOW_BOUND)
    return round6(s.select("doc_id", "orig_length", *WIN_STATS), WIN_STATS)


@register("thirds_stats", operators=("A6",), sql=_win_sql() + f""",
part AS (
  SELECT wb.doc_id, CASE WHEN wn.n < 3 THEN t.third ELSE least(wb.pos // (wn.n // 3), 2) END AS third, wb.b
  FROM wb JOIN wn USING (doc_id)
  JOIN range(3) t(third) ON (wn.n < 3 OR t.third = 0)
),
agg AS (SELECT doc_id, third, avg(b) AS mean, stddev_pop(b) AS std, count(*) AS t FROM part GROUP BY ALL),
cnt AS (SELECT doc_id, third, b, count(*) AS c FROM part GROUP BY ALL),
ent AS (SELECT cnt.doc_id, cnt.third, {entropy_sql('c', 'agg.t')} AS e
        FROM cnt JOIN agg USING (doc_id, third) GROUP BY cnt.doc_id, cnt.third),
grid AS (SELECT doc_id, t.third FROM wn, range(3) t(third))
SELECT g.doc_id, CAST(g.third AS INTEGER) AS third, {r6('coalesce(mean, 0)')} AS mean,
       {r6('coalesce(std, 0)')} AS std, {r6('coalesce(e, 0)')} AS entropy
FROM grid g LEFT JOIN agg USING (doc_id, third) LEFT JOIN ent USING (doc_id, third)
""")
def thirds_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _window_stats(spark, sf_dir)
    rows = F.array(*[F.struct(F.lit(i).alias("third"), F.col(f"third{i}_mean").alias("mean"),
                              F.col(f"third{i}_std").alias("std"), F.col(f"third{i}_entropy").alias("entropy"))
                     for i in range(3)])
    out = s.select("doc_id", F.inline(rows))
    return round6(out, ["mean", "std", "entropy"])


_CHUNK_SQL = _win_sql() + """,
part AS (
  SELECT wb.doc_id, least(wb.pos // greatest(1, wn.n // 10), 9) AS chunk, wb.b FROM wb JOIN wn USING (doc_id)
),
agg AS (SELECT doc_id, chunk, avg(b) AS mean, stddev_pop(b) AS std FROM part GROUP BY ALL),
grid AS (SELECT doc_id, t.chunk FROM wn, range(10) t(chunk)),
chunks AS (
  SELECT g.doc_id, g.chunk, coalesce(mean, 0) AS mean, coalesce(std, 0) AS std
  FROM grid g LEFT JOIN agg USING (doc_id, chunk)
)"""


@register("chunk_stats", operators=("A7", "W2"), sql=_CHUNK_SQL + f"""
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, {r6('mean')} AS mean, {r6('std')} AS std FROM chunks
""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _window_stats(spark, sf_dir)
    rows = F.array(*[F.struct(F.lit(i).alias("chunk"), F.col(f"chunk{i}_mean").alias("mean"),
                              F.col(f"chunk{i}_std").alias("std")) for i in range(C.STAT_CHUNK_COUNT)])
    return round6(s.select("doc_id", F.inline(rows)), ["mean", "std"])


_DIFF_NAMES = [f"chunk_{k}_diff_{s}" for k in ("mean", "std") for s in ("abs_mean", "std", "max", "min")]


@register("chunk_diff_stats", operators=("W1",), sql=_CHUNK_SQL + f""",
d AS (
  SELECT doc_id, chunk,
         CAST(mean AS FLOAT) - lag(CAST(mean AS FLOAT)) OVER (PARTITION BY doc_id ORDER BY chunk) AS dm,
         CAST(std AS FLOAT) - lag(CAST(std AS FLOAT)) OVER (PARTITION BY doc_id ORDER BY chunk) AS ds
  FROM chunks
)
SELECT doc_id,
  {r6('avg(abs(dm::DOUBLE))')} AS chunk_mean_diff_abs_mean, {r6('stddev_pop(dm::DOUBLE)')} AS chunk_mean_diff_std,
  {r6('max(dm)')} AS chunk_mean_diff_max, {r6('min(dm)')} AS chunk_mean_diff_min,
  {r6('avg(abs(ds::DOUBLE))')} AS chunk_std_diff_abs_mean, {r6('stddev_pop(ds::DOUBLE)')} AS chunk_std_diff_std,
  {r6('max(ds)')} AS chunk_std_diff_max, {r6('min(ds)')} AS chunk_std_diff_min
FROM d WHERE chunk > 0 GROUP BY doc_id
""")
def chunk_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _window_stats(spark, sf_dir)
    names = [n for n in B.STAT_NAMES if "_diff_" in n]
    return round6(s.select("doc_id", *names), names)


# ---------------------------------------------------------------------------
# A8-A10 file attributes (Python profile blocks, W2) and W3 stride blocks
# ---------------------------------------------------------------------------

_FA_SQL = f"""
WITH {FILES_CTE},
{bytes_cte('sb', 'files', 0, 'BOUND')},
meta AS (
  SELECT doc_id, n AS size, least(n, BOUND) AS m,
         CASE WHEN least(n, BOUND) > 0 THEN least(10, greatest(1, least(n, BOUND) // 2048)) ELSE 0 END AS k
  FROM sb_hex
),
blk AS (SELECT s.doc_id, least(s.pos // (m.m // m.k), m.k - 1) AS blk, s.b FROM sb s JOIN meta m USING (doc_id)),
cnt AS (SELECT doc_id, blk, b, count(*) AS c FROM blk GROUP BY ALL),
tot AS (SELECT doc_id, blk, sum(c) AS t FROM cnt GROUP BY ALL),
ent AS (SELECT doc_id, blk, {entropy_sql('c', 't')} AS e FROM cnt JOIN tot USING (doc_id, blk) GROUP BY doc_id, blk),
allc AS (SELECT doc_id, b, count(*) AS c FROM sb GROUP BY ALL),
overall AS (
  SELECT allc.doc_id, {entropy_sql('c', 'meta.m')} AS e,
         sum(CASE WHEN b = 0 THEN c ELSE 0 END)::DOUBLE / meta.m AS zr,
         sum(CASE WHEN b BETWEEN 32 AND 126 THEN c ELSE 0 END)::DOUBLE / meta.m AS pr
  FROM allc JOIN meta USING (doc_id) GROUP BY allc.doc_id, meta.m
),
chg AS (
  SELECT doc_id, e - lag(e) OVER (PARTITION BY doc_id ORDER BY blk) AS d FROM ent
),
chs AS (SELECT doc_id, avg(abs(d)) AS rate, stddev_pop(d) AS sd FROM chg WHERE d IS NOT NULL GROUP BY doc_id),
bs AS (
  SELECT doc_id, min(e) AS mn, max(e) AS mx, stddev_pop(e) AS sd, quantile_cont(e, 0.25) AS q25,
         quantile_cont(e, 0.75) AS q75, quantile_cont(e, 0.5) AS med,
         avg(CASE WHEN e > 0.8 THEN 1.0 ELSE 0.0 END) AS hi, avg(CASE WHEN e < 0.2 THEN 1.0 ELSE 0.0 END) AS lo
  FROM ent GROUP BY doc_id
)"""


def _fa_sql(bound=None):
    """The attribute CTEs over whole contents, or over a prefix."""
    return _FA_SQL.replace("BOUND", "n" if bound is None else str(bound))


_FA_SELECT = f"""
SELECT meta.doc_id, {r6('meta.size')} AS size, {r6('ln(meta.size + 1)')} AS log_size,
  {r6('coalesce(overall.e, 0)')} AS file_entropy_avg,
  {r6('coalesce(bs.mn, overall.e, 0)')} AS file_entropy_min, {r6('coalesce(bs.mx, overall.e, 0)')} AS file_entropy_max,
  {r6('coalesce(bs.mx - bs.mn, 0)')} AS file_entropy_range, {r6('coalesce(bs.sd, 0)')} AS file_entropy_std,
  {r6('coalesce(bs.q25, 0)')} AS file_entropy_q25, {r6('coalesce(bs.q75, 0)')} AS file_entropy_q75,
  {r6('coalesce(bs.med, 0)')} AS file_entropy_median,
  {r6('coalesce(bs.hi, 0)')} AS high_entropy_ratio, {r6('coalesce(bs.lo, 0)')} AS low_entropy_ratio,
  {r6('CASE WHEN meta.k > 1 THEN chs.rate ELSE 0 END')} AS entropy_change_rate,
  {r6('CASE WHEN meta.k > 1 THEN chs.sd ELSE 0 END')} AS entropy_change_std,
  {r6('coalesce(overall.zr, 0)')} AS zero_byte_ratio, {r6('coalesce(overall.pr, 0)')} AS printable_byte_ratio
FROM meta LEFT JOIN overall USING (doc_id) LEFT JOIN bs USING (doc_id) LEFT JOIN chs USING (doc_id)
"""


@register("file_attributes_prefix", operators=("A8",), sql=_fa_sql(C.ENTROPY_SAMPLE_SIZE) + _FA_SELECT)
def q_file_attributes_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's 10,240-byte prefix as an explicit parameter."""
    f = documents_as_files(spark, sf_dir).select("doc_id", "length", "content")
    fa = B.file_attributes(f, sample_size=C.ENTROPY_SAMPLE_SIZE)
    return round6(fa.select("doc_id", *B.FILE_ATTR_NAMES), B.FILE_ATTR_NAMES)


@register("file_attributes", operators=("A8", "A9", "A10", "W2"), sql=_fa_sql() + _FA_SELECT)
def q_file_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = documents_as_files(spark, sf_dir).select("doc_id", "length", "content")
    fa = B.file_attributes(f)
    return round6(fa.select("doc_id", *B.FILE_ATTR_NAMES), B.FILE_ATTR_NAMES)


@register("stride_block_entropy", operators=("W3", "A2"), sql=f"""
WITH {FILES_CTE},
{bytes_cte('sb', 'files')},
cnt AS (SELECT doc_id, pos // 2048 AS blk, b, count(*) AS c FROM sb GROUP BY ALL),
tot AS (SELECT doc_id, blk, sum(c) AS t FROM cnt GROUP BY ALL)
SELECT doc_id, CAST(blk AS INTEGER) AS blk, {r6(entropy_sql('c', 't'))} AS entropy
FROM cnt JOIN tot USING (doc_id, blk) GROUP BY doc_id, blk
""")
def stride_block_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = documents_as_files(spark, sf_dir).select("doc_id", "content")
    starts, lens, _ = B.block_layout(F.length("content").cast("int"), stride=True, max_blocks=None)
    p = f.select("doc_id", slice_profiles("content", starts, lens).alias("p"))
    out = p.select("doc_id", F.posexplode("p").alias("blk", "s")).select(
        "doc_id", F.col("blk").cast("int").alias("blk"), F.col("s.entropy").alias("entropy"))
    return round6(out, ["entropy"])


# ---------------------------------------------------------------------------
# C3 featurise (F2-F6): the full 1549-wide row of every document
# ---------------------------------------------------------------------------

_SLOT_OUT = ["size", "log_size", "file_entropy_avg", "file_entropy_max", "printable_byte_ratio",
             "high_entropy_ratio", "file_entropy_median"]


_FEATURISE_SQL = f""",
raw AS (
  SELECT meta.doc_id, meta.size AS size, ln(meta.size + 1) AS log_size, coalesce(overall.e, 0) AS e_avg,
         coalesce(bs.mn, overall.e, 0) AS e_min, coalesce(bs.mx, overall.e, 0) AS e_max,
         coalesce(bs.mx - bs.mn, 0) AS e_rng, coalesce(bs.sd, 0) AS e_sd, coalesce(bs.q25, 0) AS e_q25,
         coalesce(bs.q75, 0) AS e_q75, coalesce(bs.med, 0) AS e_med, coalesce(bs.hi, 0) AS hi, coalesce(bs.lo, 0) AS lo,
         CASE WHEN meta.k > 1 THEN chs.rate ELSE 0 END AS rate, CASE WHEN meta.k > 1 THEN chs.sd ELSE 0 END AS csd,
         coalesce(overall.zr, 0) AS zr, coalesce(overall.pr, 0) AS pr
  FROM meta LEFT JOIN overall USING (doc_id) LEFT JOIN bs USING (doc_id) LEFT JOIN chs USING (doc_id)
),
v AS (
  SELECT doc_id, size * 0.8 / {C.SIZE_NORM_MAX} AS s_size, log_size * 0.8 / LOGNORM AS s_log,
         e_avg * 0.8 AS s_eavg, e_min * 0.8 AS s_emin, e_max * 0.8 AS s_emax, e_rng * 0.8 AS s_erng,
         e_sd * 0.8 AS s_esd, e_q25 * 0.8 AS s_eq25, e_q75 * 0.8 AS s_eq75, e_med * 0.8 AS s_emed,
         hi * 0.8 AS s_hi, lo * 0.8 AS s_lo, rate * 0.8 AS s_rate, csd * 0.8 AS s_csd, zr * 0.8 AS s_zr, pr * 0.8 AS s_pr
  FROM raw
),
n AS (
  SELECT *, sqrt(s_size*s_size + s_log*s_log + s_eavg*s_eavg + s_emin*s_emin + s_emax*s_emax + s_erng*s_erng
                 + s_esd*s_esd + s_eq25*s_eq25 + s_eq75*s_eq75 + s_emed*s_emed + s_hi*s_hi + s_lo*s_lo
                 + s_rate*s_rate + s_csd*s_csd + s_zr*s_zr + s_pr*s_pr) AS norm
  FROM v
)
SELECT doc_id, false AS is_pe, 1549 AS n_features, {r6('norm')} AS pe_norm,
       {r6('s_size / norm')} AS slot_size, {r6('s_log / norm')} AS slot_log_size,
       {r6('s_eavg / norm')} AS slot_file_entropy_avg, {r6('s_emax / norm')} AS slot_file_entropy_max,
       {r6('s_pr / norm')} AS slot_printable_byte_ratio, {r6('s_hi / norm')} AS slot_high_entropy_ratio,
       {r6('s_emed / norm')} AS slot_file_entropy_median
FROM n
"""


def _featurised(spark, sf_dir, **bounds):
    """Slots are read back from the unit vector: value of the slot over the norm."""
    from hexlens.operators.featurise import featurise
    from hexlens.plans import dims as D
    f = documents_as_files(spark, sf_dir).select("doc_id", "length", "content")
    feats = featurise(f, "doc_id", **bounds)
    slots = [F.col("pe_vector")[D.PE_POS[n]].cast("double").alias(f"slot_{n}") for n in _SLOT_OUT]
    out = feats.select("doc_id", "is_pe", F.size("features").alias("n_features"), "pe_norm", *slots)
    return out.select("doc_id", "is_pe", "n_features", F.round("pe_norm", 6).alias("pe_norm"),
                      *[F.round(f"slot_{n}", 5).alias(f"slot_{n}") for n in _SLOT_OUT])


def _featurise_oracle(bound, log_norm):
    import re
    sql = _fa_sql(bound) + _FEATURISE_SQL.replace("LOGNORM", log_norm)
    return re.sub(r"round\(CAST\((s_\w+ / norm) AS DOUBLE\), 6\)", r"round(CAST(CAST(\1 AS FLOAT) AS DOUBLE), 5)", sql)


@register("featurise_documents", operators=("C3", "F3", "F4", "F5", "F6", "P13"),
          sql=_featurise_oracle(None, f"ln({C.SIZE_NORM_MAX})"))
def featurise_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole, through the full featuriser (default profile)."""
    return _featurised(spark, sf_dir)


@register("featurise_compat", operators=("C3", "F4", "F5"), sql=_featurise_oracle(C.ENTROPY_SAMPLE_SIZE, str(C.SIZE_NORM_MAX)))
def featurise_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's bounds and vector quirks, as explicit parameters."""
    from hexlens.operators.featurise import COMPAT
    return _featurised(spark, sf_dir, **COMPAT)
