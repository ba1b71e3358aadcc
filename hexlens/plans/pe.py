"""PE-structure queries.

The driver tables hold no PE files, so section tables use the stand-in of
SURVEY §7.3: an order is a file and its line items are its sections
(``name`` = part name, ``raw_size`` = extended price, ``virtual_size`` =
quantity x 1000, flags from return flag / line status / discount).  The
operators are the ones used on real section tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexlens import config as C
from hexlens.catalog import register
from hexlens.functions.pe import dll_flags, pe_timestamp
from hexlens.operators import pe_features as PF
from hexlens.plans.corpus import round6
from hexlens.plans.sqlparts import r6
from hexlens.sources.tables import table

_EXEC, _READ, _WRITE = C.SCN_MEM_EXECUTE, C.SCN_MEM_READ, C.SCN_MEM_WRITE


def section_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                                                 "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    chars = (F.when(F.col("l_returnflag") == "A", F.lit(_EXEC)).otherwise(F.lit(0))
             + F.when(F.col("l_linestatus") == "O", F.lit(_WRITE)).otherwise(F.lit(0))
             + F.when(F.col("l_discount") > 0.05, F.lit(_READ)).otherwise(F.lit(0))).cast("bigint")
    return li.join(part, "l_partkey", "left").select(
        F.col("l_orderkey").alias("file_id"),
        F.struct((F.col("l_linenumber") - 1).cast("int").alias("pos"),
                 F.coalesce("p_name", F.lit("")).alias("name"),
                 (F.col("l_quantity") * 1000).cast("bigint").alias("virtual_size"),
                 (F.col("l_linenumber").cast("bigint") * 4096).alias("va"),
                 F.col("l_extendedprice").cast("bigint").alias("raw_size"),
                 F.lit(0).cast("bigint").alias("raw_ptr"),
                 chars.alias("characteristics")).alias("s"))


_SEC_COLS = ["section_total_size", "section_total_vsize", "avg_section_size", "max_section_size",
             "min_section_size", "section_size_std", "section_size_cv", "executable_sections_count",
             "writable_sections_count", "readable_sections_count", "rwx_sections_count",
             "code_section_ratio", "data_section_ratio", "code_vsize_ratio", "data_vsize_ratio",
             "executable_sections_ratio", "rwx_sections_ratio", "non_standard_executable_sections_count",
             "section_name_avg_length", "section_name_max_length", "section_name_min_length",
             "special_char_ratio", "long_sections_count", "short_sections_count", "long_sections_ratio",
             "packer_keyword_hits_count", "alignment_mismatch_count", "alignment_mismatch_ratio"]

_SEC_SQL = f"""
WITH s AS (
  SELECT l.l_orderkey AS file_id, coalesce(p.p_name, '') AS name, CAST(trunc(l.l_extendedprice) AS BIGINT)::DOUBLE AS raw,
         CAST(trunc(l.l_quantity * 1000) AS BIGINT)::DOUBLE AS vs,
         l.l_returnflag = 'A' AS ex, l.l_linestatus = 'O' AS wr, l.l_discount > 0.05 AS rd
  FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey
),
a AS (
  SELECT file_id, count(*)::DOUBLE AS n, sum(raw) AS tr, sum(vs) AS tv, avg(raw) AS ar, max(raw) AS mxr, min(raw) AS mnr,
         stddev_pop(raw) AS sdr,
         count_if(ex)::DOUBLE AS exc, count_if(wr)::DOUBLE AS wrc, count_if(rd)::DOUBLE AS rdc, count_if(ex AND wr)::DOUBLE AS rwx,
         sum(CASE WHEN ex THEN raw ELSE 0 END) AS cs, sum(CASE WHEN rd THEN raw ELSE 0 END) AS ds,
         sum(CASE WHEN ex THEN vs ELSE 0 END) AS cv, sum(CASE WHEN rd THEN vs ELSE 0 END) AS dv,
         count_if(ex AND lower(name) NOT IN ('.text', 'text', '.code'))::DOUBLE AS nse,
         avg(length(name)) AS nla, max(length(name))::DOUBLE AS nlx, min(length(name))::DOUBLE AS nln,
         sum(length(regexp_replace(name, '[A-Za-z0-9_.]', '', 'g')))::DOUBLE AS spec, sum(length(name))::DOUBLE AS chars,
         count_if(length(name) > 6)::DOUBLE AS lng, count_if(length(name) < 3)::DOUBLE AS sht,
         ({' + '.join(f"max(CASE WHEN contains(lower(name), '{k}') THEN 1 ELSE 0 END)" for k in C.PACKER_SECTION_KEYWORDS)})::DOUBLE AS pk,
         (count_if(CAST(raw AS BIGINT) % 512 <> 0) + count_if(CAST(vs AS BIGINT) % 4096 <> 0))::DOUBLE AS am
  FROM s GROUP BY file_id
)
SELECT file_id, {r6('tr')} AS section_total_size, {r6('tv')} AS section_total_vsize, {r6('ar')} AS avg_section_size,
  {r6('mxr')} AS max_section_size, {r6('mnr')} AS min_section_size, {r6('sdr')} AS section_size_std,
  {r6('sdr / (ar + 1e-8)')} AS section_size_cv, {r6('exc')} AS executable_sections_count,
  {r6('wrc')} AS writable_sections_count, {r6('rdc')} AS readable_sections_count, {r6('rwx')} AS rwx_sections_count,
  {r6('cs / (tr + 1)')} AS code_section_ratio, {r6('ds / (tr + 1)')} AS data_section_ratio,
  {r6('cv / (tv + 1)')} AS code_vsize_ratio, {r6('dv / (tv + 1)')} AS data_vsize_ratio,
  {r6('exc / (n + 1)')} AS executable_sections_ratio, {r6('rwx / (n + 1)')} AS rwx_sections_ratio,
  {r6('nse')} AS non_standard_executable_sections_count, {r6('nla')} AS section_name_avg_length,
  {r6('nlx')} AS section_name_max_length, {r6('nln')} AS section_name_min_length,
  {r6('spec / (chars + 1)')} AS special_char_ratio, {r6('lng')} AS long_sections_count,
  {r6('sht')} AS short_sections_count, {r6('lng / (n + 1)')} AS long_sections_ratio,
  {r6('pk')} AS packer_keyword_hits_count, {r6('am')} AS alignment_mismatch_count,
  {r6('am / (2 * n + 1)')} AS alignment_mismatch_ratio
FROM a
"""


@register("section_features", operators=("A16", "A18", "A19", "A21", "J6"), sql=_SEC_SQL)
def q_section_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = section_table(spark, sf_dir).select("file_id", "s.*")
    out = PF.section_features(sections, "file_id", file_align=F.lit(512), sect_align=F.lit(4096))
    return round6(out.select("file_id", *_SEC_COLS), _SEC_COLS)


@register("entry_section", operators=("J10",), sql="""
WITH s AS (
  SELECT o.o_orderkey AS file_id, l.l_linenumber AS pos, coalesce(p.p_name, '') AS name,
         l.l_linenumber::BIGINT * 4096 AS va, CAST(trunc(l.l_quantity * 1000) AS BIGINT) AS vs,
         (CAST(trunc(o.o_totalprice) AS BIGINT) % 32768) AS entry
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey
),
h0 AS (SELECT * FROM s WHERE va <= entry AND entry < va + vs),
hit AS (SELECT file_id, min(name) AS name FROM h0
        WHERE (file_id, pos) IN (SELECT file_id, min(pos) FROM h0 GROUP BY file_id) GROUP BY file_id)
SELECT DISTINCT s.file_id, hit.name AS entry_section,
       CASE WHEN hit.name IS NULL THEN 0 WHEN lower(hit.name) IN ('.text', 'text', '.code') THEN 0 ELSE 1 END AS entry_in_nonstandard_section_flag
FROM s LEFT JOIN hit USING (file_id)
""")
def q_entry_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry point = o_totalprice mod 32 KiB (stand-in); range join as array filter per file.

    A real file's section array comes from its parsed header (no grouping);
    the stand-in gathers an order's lines, which the data bounds to a few.
    """
    per_file = section_table(spark, sf_dir).groupBy("file_id").agg(F.collect_list("s").alias("sections"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"),
                                               F.pmod(F.col("o_totalprice").cast("bigint"), F.lit(32768)).alias("entry_rva"))
    j = per_file.join(o, "file_id")
    name, flag = PF.entry_section("sections", "entry_rva")
    return j.select("file_id", name.alias("entry_section"), flag.alias("entry_in_nonstandard_section_flag"))


@register("header_scalars", operators=("F7", "F8"), sql="""
SELECT o_orderkey AS file_id,
       CASE WHEN (CAST(trunc(o_totalprice) AS BIGINT) & 256) <> 0 THEN 1 ELSE 0 END AS has_nx_compat,
       CASE WHEN (CAST(trunc(o_totalprice) AS BIGINT) & 64) <> 0 THEN 1 ELSE 0 END AS has_aslr,
       CASE WHEN (CAST(trunc(o_totalprice) AS BIGINT) & 1024) = 0 THEN 1 ELSE 0 END AS has_seh,
       CASE WHEN (CAST(trunc(o_totalprice) AS BIGINT) & 16384) <> 0 THEN 1 ELSE 0 END AS has_guard_cf,
       CAST(epoch(o_orderdate) AS BIGINT) AS timestamp,
       CASE WHEN epoch(o_orderdate) > 0 THEN year(o_orderdate) ELSE 0 END AS timestamp_year
FROM orders
""")
def q_header_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dll characteristics = total price bits, PE timestamp = order date (stand-ins)."""
    o = table(spark, sf_dir, "orders")
    flags = dll_flags(F.col("o_totalprice").cast("bigint"))
    ts, year = pe_timestamp(F.unix_timestamp("o_orderdate"))
    return o.select(F.col("o_orderkey").alias("file_id"), *[c.alias(k) for k, c in flags.items()],
                    ts.alias("timestamp"), year.cast("int").alias("timestamp_year"))
