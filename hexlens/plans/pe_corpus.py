"""A corpus of PE files derived from ``part``, one file a row, and the queries that read it.

The driver tables hold no executables, so Spark assembles them: every part is
a file whose headers, sections and pointer tables follow from its key by the
rules below (expressions on one row, nothing gathered).  The corpus has 32- and
64-bit images, with and without TLS, imports by name and by ordinal, hostile
section pointers beyond 2**31, directories outside the sections, resource trees
that lead back to their root, images of nine sections whose ratios lie on the
thresholds of the vote, truncated images and files that are no images.
The oracles state what the rules imply, without parsing anything.

Rules for key k (i: section 1..8, d: imported DLL 0..2, j: its function):
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexlens import config as C
from hexlens.catalog import register
from hexlens.operators.featurise import featurise, missing_flags, outcome_status
from hexlens.plans.corpus import round6
from hexlens.plans.sqlparts import r6
from hexlens.session import materialize_once
from hexlens.sources import files as SF
from hexlens.sources.tables import table

NAMES = [".text", "UPX0", ".data", ".rsrc", "longname", "ab"]          # of section i: number (k + i) % 6
CHARACTERISTICS = [0x60000020, 0xC0000040, 0xE0000020, 0x40000040]     # of section i: number (k + i) % 4
DLLS = ["KERNEL32.dll", "ws2_32.dll", "custom.x.dll"]                  # DLL d < k % 4
APIS = ["CreateFileA", "ReadFile", "NtClose", "connect", "send", "ZwOpenKey", "Foo", "RegOpenKeyExA", "LoadLibraryA"]  # d * 3 + j
HEADER, TABLES = 1024, 1024                                            # bytes of the headers, of the section with the tables
RVA = 0x1000                                                           # of the section with the tables
IDATA_RAW = 200                                                        # size that its header gives: too short for an entropy
OVERLAY, LONG_OVERLAY = 1500, 8192                                     # bytes of the cycle behind the sections, if any
CYCLE = bytes(range(256)) * 8
TASK_FILES = 1000                                                      # made by one task, so that tasks don't grow with the corpus


def _le(value, width: int) -> Column:
    """Little-endian hex of an integer or integer column."""
    if isinstance(value, int):
        return F.lit(value.to_bytes(width, "little").hex())
    v = value.cast("bigint")
    swapped = sum((F.shiftleft(F.shiftright(v, 8 * b).bitwiseAND(F.lit(255)), 8 * (width - 1 - b)) for b in range(min(width, 4))), F.lit(0).cast("bigint"))
    return F.lpad(F.hex(swapped), 2 * width, "0")


def _text(s: str) -> Column:
    return F.lit(s.encode().hex() + "00")


def _region(size: int, pieces: list[tuple[int, int, Column]]) -> Column:
    """Hex of ``size`` bytes with (offset, width, hex) pieces in zeros."""
    out, at = [], 0
    for off, width, value in sorted(pieces, key=lambda p: p[0]):
        assert off >= at, (off, at)
        out += [F.lit("00" * (off - at))] if off > at else []
        out.append(value)
        at = off + width
    return F.concat(*out, F.lit("00" * (size - at)))


def pe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, path, length, content`` of the corpus, stored once in the shared folder as files would be."""
    k = F.col("k")
    # the narrow keys are spread before they become files, to tasks of bounded size; the files stay where they are made
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name")
    df = keys.repartition(max(spark.sparkContext.defaultParallelism, -(-keys.count() // TASK_FILES)), "k")
    when = lambda c, v, width: F.when(c, v).otherwise(F.lit("00" * width))
    plus, n = k % 3 == 0, F.when(k % 29 == 3, 8).otherwise(1 + k % 4)
    long = (k % 40 == 16) & (k % 29 != 3)
    raw = lambda i: 256 + 64 * ((k * i) % 5)
    number = lambda *xs: F.array(*[F.lit(x) for x in xs])
    joined = lambda items: F.concat_ws("", items)
    sections, entries = F.filter(number(*range(1, 9)), lambda i: i <= n), number(0, 1, 2)

    def section(i):
        name = F.get(F.array(*[F.lit(x.encode().ljust(8, b"\0").hex()) for x in NAMES]), ((k + i) % 6).cast("int"))
        flags = F.get(F.array(*[_le(x, 4) for x in CHARACTERISTICS]), ((k + i) % 4).cast("int"))
        before = F.aggregate(F.filter(sections, lambda x: x < i), F.lit(HEADER + TABLES).cast("bigint"), lambda s, x: s + raw(x))
        pointer = F.when((k % 11 == 0) & (n == i), F.lit(0x90000000)).otherwise(before)
        return F.concat(name, _le(1000 * (i + 1) + k % 7, 4), _le(RVA * (i + 1), 4), _le(raw(i), 4), _le(pointer, 4), F.lit("00" * 12), flags)

    tables = lambda off: RVA + off
    dirs = {0: (k % 5 == 0, tables(500), 40), 1: (k % 4 > 0, tables(0), 80), 2: (k % 6 == 0, tables(650), 64), 4: (k % 10 == 0, HEADER + 900, 64),
            5: (k % 2 == 0, tables(580), 28), 9: (k % 7 == 0, F.when(k % 35 == 0, 0x7000000).otherwise(tables(612)), 40)}
    own = F.concat(F.lit(b".idata\0\0".hex()), _le(TABLES, 4), _le(RVA, 4), _le(IDATA_RAW, 4), _le(HEADER, 4), F.lit("00" * 12), _le(0x40000040, 4))
    opt = 152
    common = _region(opt + 72, [
        (0, 2, F.lit(b"MZ".hex())), (0x3C, 4, _le(128, 4)), (128, 4, F.lit(b"PE\0\0".hex())), (132, 2, F.when(plus, _le(0x8664, 2)).otherwise(_le(0x14C, 2))),
        (134, 2, _le(n + 1, 2)), (136, 4, _le(F.when(k % 9 == 0, 0).otherwise(946684800 + k * 86400), 4)), (144, 4, _le(k % 50, 4)),
        (148, 2, F.when(plus, _le(240, 2)).otherwise(_le(224, 2))), (opt, 2, F.when(plus, _le(0x20B, 2)).otherwise(_le(0x10B, 2))),
        (opt + 16, 4, _le(2 * RVA + k % 100, 4)), (opt + 32, 8, F.concat(_le(4096, 4), _le(512, 4))), (opt + 60, 4, _le(HEADER, 4)),
        (opt + 64, 4, _le(k % 4, 4)), (opt + 68, 2, _le(2 + k % 2, 2)), (opt + 70, 2, _le((k * 37) % 65536, 2))])
    directories = _region(128, [(8 * x, 8, when(c, F.concat(_le(rva, 4), _le(size, 4)), 8)) for x, (c, rva, size) in dirs.items()])
    gap = F.when(plus, F.lit("00" * 36)).otherwise(F.lit("00" * 20))
    header = F.rpad(F.concat(common, gap, _le(16, 4), directories, own, joined(F.transform(sections, section))), 2 * HEADER, "0")

    def thunk(d, w):
        ordinal = lambda j: F.concat(_le(j + 1, 2), F.lit("00" * (w - 3) + "80"))
        name = lambda j: F.concat(_le(tables(280) + 24 * (3 * d + j), 4), F.lit("00" * (w - 4)))
        return lambda j: F.when(j <= (k + d) % 3, F.when((k + d + j) % 5 == 0, ordinal(j)).otherwise(name(j))).otherwise(F.lit("00" * w))

    thunks = lambda d, w: F.concat(joined(F.transform(entries, thunk(d, w))), F.lit("00" * (40 - 3 * w)))
    pieces = []
    for d in range(3):
        at = tables(100 + 40 * d)
        pieces.append((20 * d, 20, when(F.lit(d) < k % 4, F.concat(_le(at, 4), F.lit("00" * 8), _le(tables(220 + 20 * d), 4), _le(at, 4)), 20)))
        pieces.append((100 + 40 * d, 40, F.when(plus, thunks(d, 8)).otherwise(thunks(d, 4))))
        pieces.append((220 + 20 * d, len(DLLS[d]) + 1, _text(DLLS[d])))
        pieces += [(280 + 24 * (3 * d + j) + 2, len(APIS[3 * d + j]) + 1, _text(APIS[3 * d + j])) for j in range(3)]
    pieces += [(520, 4, _le(2 + k % 3, 4)), (524, 4, _le(1 + k % 2, 4)), (532, 4, _le(tables(540), 4)), (540, 8, F.concat(_le(tables(550), 4), _le(tables(562), 4))),
               (550, 10, _text("ExportOne")), (562, 4, _text("Ex2")), (580, 8, F.concat(_le(RVA, 4), _le(16, 4))), (596, 8, F.concat(_le(2 * RVA, 4), _le(12, 4))),
               (624, 4, when(~plus & (k % 14 == 0), _le(1, 4), 4)), (636, 4, when(plus & (k % 14 == 0), _le(1, 4), 4)),
               (664, 2, _le(2, 2)), (666, 16, F.concat(_le(1, 4), _le(64, 4), _le(2, 4), F.when(k % 30 == 0, _le(0x80000000, 4)).otherwise(_le(0x80000000 + 32, 4)))), (696, 2, _le(1, 2)),
               (698, 8, F.concat(_le(1, 4), _le(64, 4))), (900, 12, when(k % 20 == 0, _text("signingTime"), 12))]
    cycle = CYCLE.hex()
    body = lambda i: F.when((k + i) % 3 == 0, F.substring(F.lit(cycle), 1, (2 * raw(i)).cast("int"))).otherwise(
        F.repeat(F.lower(F.hex((64 + i).cast("bigint"))), raw(i).cast("int")))
    overlay = F.when(long, F.repeat(F.lit(cycle), LONG_OVERLAY // len(CYCLE))).when(k % 5 == 1, F.lit(cycle[: 2 * OVERLAY])).otherwise(F.lit(""))
    image = F.unhex(F.concat(header, _region(TABLES, pieces), joined(F.transform(sections, body)), overlay))
    content = F.when(k % 17 == 16, F.encode(F.coalesce("p_name", F.lit("")), "UTF-8")).when(k % 13 == 12, F.substring(image, 1, 100)).otherwise(image)
    df = df.select("k", content.alias("content"))
    df = df.select("k", F.format_string("corpus/%d.exe", "k").alias("path"), F.length("content").cast("bigint").alias("length"), "content")
    return materialize_once(spark, ("pe-corpus", sf_dir), lambda: df, "pe-corpus")


# ---------------------------------------------------------------------------
# what the rules imply, in SQL
# ---------------------------------------------------------------------------

_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_FILES = f"""
f AS (
  SELECT p_partkey AS k, p_name, NOT (p_partkey % 17 = 16) AND NOT (p_partkey % 13 = 12) AS pe, CASE WHEN p_partkey % 29 = 3 THEN 8 ELSE 1 + p_partkey % 4 END AS n,
    p_partkey % 40 = 16 AND p_partkey % 29 <> 3 AS long FROM part
),
s0 AS (
  SELECT k, i, CASE WHEN i = 0 THEN '.idata' ELSE ({_LIST(NAMES)})[(k + i) % 6 + 1] END AS name,
         CASE WHEN i = 0 THEN {IDATA_RAW} ELSE 256 + 64 * ((k * i) % 5) END AS raw,
         CASE WHEN i = 0 THEN {TABLES} ELSE 1000 * (i + 1) + k % 7 END AS vs, (i + 1) * {RVA} AS va,
         i > 0 AND (k + i) % 4 IN (0, 2) AS ex, i = 0 OR TRUE AS rd, i > 0 AND (k + i) % 4 IN (1, 2) AS wr,
         k % 11 = 0 AND i = n AS far, i > 0 AND (k + i) % 3 = 0 AS cycle, CASE WHEN long THEN {LONG_OVERLAY} WHEN k % 5 = 1 THEN {OVERLAY} ELSE 0 END AS overlay
  FROM f, range(9) r(i) WHERE pe AND i <= n
),
len0 AS (SELECT k, {HEADER + TABLES} + sum(CASE WHEN i > 0 THEN raw END) + any_value(overlay) AS size FROM s0 GROUP BY k),
tab AS (SELECT k, {HEADER} AS h FROM f)"""
#: What is malformed in the tables of an image.
_ERROR = ("nullif(concat_ws('; ', CASE WHEN k % 35 = 0 THEN 'directory outside the sections' END, "
          "CASE WHEN k % 30 = 0 THEN 'resource directories overlap' END), '')")
#: Entropy/8 of n bytes that run through 0..255: r bytes occur one time more often than the others.
_CYCLE_E = "(-(({r}) * ((({n}) // 256 + 1.0) / ({n})) * log2((({n}) // 256 + 1.0) / ({n})) + (256 - ({r})) * ((({n}) // 256) / ({n})::DOUBLE) * log2((({n}) // 256) / ({n})::DOUBLE)) / 8)"


def _features(spark: SparkSession, sf_dir: str, native: bool = False) -> DataFrame:
    """Features, written once for all queries: a filter on them must not be pushed down into the parser's expressions."""
    f = materialize_once(spark, ("pe-features", sf_dir, native),
                         lambda: featurise(pe_files(spark, sf_dir).select("k", "length", "content"), "k", native=native), "pe-features")
    return f.withColumnsRenamed({c: c.replace(".", "_") for c in f.columns})


@register("pe_magic", operators=("P2",), sql=f"WITH {_FILES} SELECT k, pe AS is_pe FROM f")
def q_pe_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pe_files(spark, sf_dir).select("k", SF.is_pe("content").alias("is_pe"))


_HEADER_COLS = ["symbols_count", "subsystem", "dll_characteristics", "has_nx_compat", "has_aslr", "has_seh", "has_guard_cf", "has_resources",
                "has_debug_info", "has_tls", "has_relocs", "has_exceptions", "resources_count", "tls_callbacks_count", "reloc_blocks_count",
                "reloc_entries_count", "checksum_zero_flag", "pe_header_size", "header_size_ratio", "entry_point_ratio", "timestamp", "timestamp_year",
                "has_signature", "signature_size", "signature_has_signing_time", "exports_count", "export_name_avg_length", "export_name_max_length",
                "export_name_min_length", "exports_density", "exports_name_ratio", "entry_in_nonstandard_section_flag"]


@register("pe_headers", operators=("C3", "A15", "A38", "F7", "F8", "F10", "J10"), sql=f"""
WITH {_FILES},
x AS (SELECT f.k, l.size, (f.k * 37) % 65536 AS ch, CASE WHEN f.k % 9 = 0 THEN 0 ELSE 946684800 + f.k * 86400 END AS ts,
             f.k % 5 = 0 AS has_exp, 1 + f.k % 2 AS en, 2 + f.k % 3 AS ef FROM f JOIN len0 l USING (k)),
y AS (SELECT k, CASE WHEN has_exp THEN en ELSE 0 END AS names, CASE WHEN has_exp THEN ef ELSE 0 END AS funcs,
             CASE WHEN has_exp THEN CASE WHEN en = 1 THEN 9.0 ELSE 6.0 END ELSE 0 END AS avg_len, CASE WHEN has_exp THEN 9.0 ELSE 0 END AS max_len,
             CASE WHEN has_exp THEN CASE WHEN en = 1 THEN 9.0 ELSE 3.0 END ELSE 0 END AS min_len FROM x)
SELECT k, (k % 50)::DOUBLE AS symbols_count, (2 + k % 2)::DOUBLE AS subsystem, ch::DOUBLE AS dll_characteristics,
  ((ch & 256) <> 0)::INT::DOUBLE AS has_nx_compat, ((ch & 64) <> 0)::INT::DOUBLE AS has_aslr, ((ch & 1024) = 0)::INT::DOUBLE AS has_seh,
  ((ch & 16384) <> 0)::INT::DOUBLE AS has_guard_cf, (k % 6 = 0)::INT::DOUBLE AS has_resources, 0.0::DOUBLE AS has_debug_info,
  (k % 7 = 0)::INT::DOUBLE AS has_tls, (k % 2 = 0)::INT::DOUBLE AS has_relocs, 0.0::DOUBLE AS has_exceptions,
  CASE WHEN k % 30 = 0 THEN 1.0::DOUBLE WHEN k % 6 = 0 THEN 2.0 ELSE 0 END AS resources_count, (k % 14 = 0 AND k % 35 <> 0)::INT::DOUBLE AS tls_callbacks_count,
  CASE WHEN k % 2 = 0 THEN 2.0::DOUBLE ELSE 0 END AS reloc_blocks_count, CASE WHEN k % 2 = 0 THEN 6.0::DOUBLE ELSE 0 END AS reloc_entries_count,
  (k % 4 = 0)::INT::DOUBLE AS checksum_zero_flag, {HEADER}.0::DOUBLE AS pe_header_size, {r6(f'{HEADER}.0 / (size + 1)')} AS header_size_ratio,
  {r6(f'({2 * RVA} + k % 100) / (size + 1.0)')} AS entry_point_ratio, ts::DOUBLE AS timestamp,
  CASE WHEN ts > 0 THEN year(to_timestamp(ts)) ELSE 0 END::DOUBLE AS timestamp_year, (k % 10 = 0)::INT::DOUBLE AS has_signature,
  CASE WHEN k % 10 = 0 THEN 64.0::DOUBLE ELSE 0 END AS signature_size, (k % 20 = 0)::INT::DOUBLE AS signature_has_signing_time,
  funcs::DOUBLE AS exports_count, avg_len::DOUBLE AS export_name_avg_length, max_len::DOUBLE AS export_name_max_length, min_len::DOUBLE AS export_name_min_length,
  {r6('names / (size + 1.0)')} AS exports_density, {r6('names / (funcs + 1.0)')} AS exports_name_ratio,
  CASE WHEN (k + 1) % 6 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS entry_in_nonstandard_section_flag, {_ERROR} AS error
FROM x JOIN y USING (k)
""")
def q_pe_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, exports, relocations, TLS, resources and signature of every image."""
    f = _features(spark, sf_dir).where("is_pe")
    return round6(f.select("k", *_HEADER_COLS, "error"), _HEADER_COLS)


_SECTION_COLS = ["sections_count", "section_names_count", "section_total_size", "section_total_vsize", "avg_section_size", "avg_section_vsize",
                 "max_section_size", "min_section_size", "section_size_std", "section_size_cv", "section_entropy_avg", "section_entropy_min",
                 "section_entropy_max", "section_entropy_std", "packed_sections_ratio", "code_section_ratio", "data_section_ratio", "code_vsize_ratio",
                 "data_vsize_ratio", "executable_sections_count", "writable_sections_count", "readable_sections_count", "rwx_sections_count",
                 "executable_sections_ratio", "executable_code_density", "non_standard_executable_sections_count", "section_name_avg_length",
                 "section_name_max_length", "section_name_min_length", "special_char_ratio", "long_sections_count", "short_sections_count",
                 "packer_keyword_hits_count", "packer_keyword_hits_ratio", "alignment_mismatch_count", "alignment_mismatch_ratio", "has__text_section",
                 "has__data_section", "has__rdata_section", "has__rsrc_section", "has_upx_section", "trailing_data_size", "trailing_data_ratio",
                 "overlay_entropy", "overlay_high_entropy_flag"]


def _section_sql(native: bool) -> str:
    words = C.keyword_lists(native)["packer_sections"]
    data, rwx = ("NOT ex", "ex AND wr AND rd") if native else ("rd", "ex AND wr")
    cv = "CASE WHEN ar > 0 THEN sdr / ar ELSE 0 END" if native else "sdr / (ar + 1e-8)"
    return f"""
WITH {_FILES},
e AS (SELECT *, CASE WHEN cycle AND NOT far THEN {_CYCLE_E.format(n='raw', r='raw % 256')} ELSE 0.0 END AS ent FROM s0),
a AS (
  SELECT k, count(*)::DOUBLE AS n, count(DISTINCT name)::DOUBLE AS nn, sum(raw)::DOUBLE AS tr, sum(vs)::DOUBLE AS tv, avg(raw) AS ar, avg(vs) AS av,
         max(raw)::DOUBLE AS mxr, min(raw)::DOUBLE AS mnr, stddev_pop(raw) AS sdr,
         avg(ent) AS ae, min(ent) AS ne, max(ent) AS xe, stddev_pop(ent) AS se, count_if(ent > 0.8) AS high, any_value(overlay) AS overlay,
         sum(CASE WHEN ex THEN raw ELSE 0 END) AS cs, sum(CASE WHEN {data} THEN raw ELSE 0 END) AS ds, sum(CASE WHEN ex THEN vs ELSE 0 END) AS cv,
         sum(CASE WHEN {data} THEN vs ELSE 0 END) AS dv, count_if(ex)::DOUBLE AS exc, count_if(wr)::DOUBLE AS wrc, count_if(rd)::DOUBLE AS rdc,
         count_if({rwx})::DOUBLE AS rwx, count_if(ex AND name <> '.text')::DOUBLE AS nse, avg(length(name)) AS nla, max(length(name))::DOUBLE AS nlx,
         min(length(name))::DOUBLE AS nln, sum(length(name)) AS chars, count_if(length(name) > 6)::DOUBLE AS lng, count_if(length(name) < 3)::DOUBLE AS sht,
         ({' + '.join(f"max(contains(lower(name), '{w}')::INT)" for w in words)})::DOUBLE AS pk,
         (count_if(raw % 512 <> 0) + count_if(vs % 4096 <> 0))::DOUBLE AS am, max((name = '.text')::INT) AS h_text, max((name = '.data')::INT) AS h_data,
         max((name = '.rsrc')::INT) AS h_rsrc, max((name = 'UPX0')::INT) AS h_upx, max(far::INT) AS far
  FROM e GROUP BY k
),
o AS (SELECT a.*, l.size, CASE WHEN a.far = 0 THEN overlay ELSE 0 END AS tail FROM a JOIN len0 l USING (k))
SELECT k, n AS sections_count, nn AS section_names_count, tr AS section_total_size, tv AS section_total_vsize, {r6('ar')} AS avg_section_size, {r6('av')} AS avg_section_vsize,
  mxr AS max_section_size, mnr AS min_section_size, {r6('sdr')} AS section_size_std, {r6(cv)} AS section_size_cv,
  {r6('high / (n + 0.0)' if native else 'high / (n + 1)')} AS packed_sections_ratio,
  {r6('cs / (tr + 1)')} AS code_section_ratio, {r6('ds / (tr + 1)')} AS data_section_ratio, {r6('cv / (tv + 1)')} AS code_vsize_ratio,
  {r6('dv / (tv + 1)')} AS data_vsize_ratio, exc AS executable_sections_count, wrc AS writable_sections_count, rdc AS readable_sections_count,
  rwx AS rwx_sections_count, {r6('exc / (n + 1)')} AS executable_sections_ratio, {r6('cs / (size + 1.0)' if native else 'cs / (tr + 1)')} AS executable_code_density,
  nse AS non_standard_executable_sections_count, {r6('nla')} AS section_name_avg_length, nlx AS section_name_max_length, nln AS section_name_min_length,
  0.0::DOUBLE AS special_char_ratio, lng AS long_sections_count, sht AS short_sections_count, pk AS packer_keyword_hits_count,
  {r6('pk / (n + 1)')} AS packer_keyword_hits_ratio, am AS alignment_mismatch_count, {r6('am / (2 * n + 1)')} AS alignment_mismatch_ratio,
  h_text::DOUBLE AS has__text_section, h_data::DOUBLE AS has__data_section, 0.0::DOUBLE AS has__rdata_section, h_rsrc::DOUBLE AS has__rsrc_section,
  h_upx::DOUBLE AS has_upx_section, tail::DOUBLE AS trailing_data_size, {r6('tail / (size + 1.0)')} AS trailing_data_ratio,
  {r6(f"CASE WHEN tail > 0 THEN {_CYCLE_E.format(n='tail', r='tail % 256')} ELSE 0 END")} AS overlay_entropy, (tail > 0)::INT::DOUBLE AS overlay_high_entropy_flag,
  {r6('ae')} AS section_entropy_avg, {r6('ne')} AS section_entropy_min, {r6('xe')} AS section_entropy_max, {r6('se')} AS section_entropy_std
FROM o
"""


def _sections(spark, sf_dir, native):
    f = _features(spark, sf_dir, native).where("is_pe")
    return round6(f.select("k", *_SECTION_COLS), _SECTION_COLS)


@register("pe_sections", operators=("A16", "A17", "A18", "A19", "A20", "A21", "J6"), sql=_section_sql(False))
def q_pe_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section, entropy and overlay features of every image, from its own section array."""
    return _sections(spark, sf_dir, False)


@register("pe_sections_native", operators=("A17", "A18", "A19", "A21"), sql=_section_sql(True))
def q_pe_sections_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native profile's definitions and lists."""
    return _sections(spark, sf_dir, True)


def _import_sql(native: bool) -> str:
    lists = C.keyword_lists(native)
    hit = lambda words: "(" + " OR ".join(f"contains(lower(dll || ' ' || api), '{w}')" for w in words) + ")"
    system = ", ".join(f"'{w}'" for w in lists["system_dlls"])
    return f"""
WITH {_FILES},
i0 AS (SELECT k, d, j, lower(({_LIST(DLLS)})[d + 1]) AS dll, CASE WHEN (k + d + j) % 5 <> 0 THEN ({_LIST(APIS)})[d * 3 + j + 1] END AS api
       FROM f, range(3) a(d), range(3) b(j) WHERE pe AND d < k % 4 AND j <= (k + d) % 3),
g AS (SELECT k, count(DISTINCT d)::DOUBLE AS nd, count(DISTINCT dll)::DOUBLE AS ud, count(DISTINCT api)::DOUBLE AS ua,
             count(DISTINCT CASE WHEN api IS NOT NULL THEN dll || ' ' || api END)::DOUBLE AS ui,
             count(api)::DOUBLE AS named, count_if(api IS NULL)::DOUBLE AS ord,
             count(DISTINCT CASE WHEN split_part(dll, '.', 1) IN ({system}) THEN split_part(dll, '.', 1) END)::DOUBLE AS sys,
             count_if(lower(api) LIKE 'nt%' OR lower(api) LIKE 'zw%')::DOUBLE AS syscall,
             {', '.join(f"count_if(api IS NOT NULL AND {hit(w)})::DOUBLE AS c_{c}" for c, w in lists['api'].items())}
      FROM i0 GROUP BY k),
dl AS (SELECT k, avg(length(dll)) AS a, max(length(dll))::DOUBLE AS x, min(length(dll))::DOUBLE AS n FROM (SELECT DISTINCT k, d, dll FROM i0) GROUP BY k)
SELECT k, nd AS imports_count, ui AS unique_imports, ud AS unique_dlls, ua AS unique_apis, {r6('a')} AS dll_name_avg_length, x AS dll_name_max_length,
  n AS dll_name_min_length, sys AS imported_system_dlls_count, {r6('log2(nd) / 8')} AS dll_imports_entropy,
  {r6('CASE WHEN named > 0 THEN log2(named) / 8 ELSE 0 END')} AS api_imports_entropy, {r6(f"sys / ({'nd' if native else 'ud'} + 1)")} AS imported_system_dlls_ratio,
  {r6('CASE WHEN named > 0 THEN syscall / (named + 1) ELSE 0 END')} AS syscall_api_ratio, ord AS import_ordinal_only_count,
  {r6('ord / (named + ord + 1)')} AS import_ordinal_only_ratio, {r6('(named + ord) / (ud + 1)')} AS avg_imports_per_dll,
  {', '.join(f"{r6(f'CASE WHEN named > 0 THEN c_{c} / (named + ord + 1) ELSE 0 END')} AS api_{c}_ratio" for c in lists['api'])}
FROM g JOIN dl USING (k)
"""


def _imports(spark, sf_dir, native):
    from hexlens.operators.pe_features import IMPORT_FEATURES
    f = _features(spark, sf_dir, native=native).where("imports_count is not null")
    return round6(f.select("k", *IMPORT_FEATURES), IMPORT_FEATURES)


@register("pe_imports", operators=("A11", "A12", "A13", "A14", "J6", "J7"), sql=_import_sql(False))
def q_pe_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import features of every image that imports, by name and by ordinal."""
    return _imports(spark, sf_dir, False)


@register("pe_imports_native", operators=("A12", "A14", "J7"), sql=_import_sql(True))
def q_pe_imports_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imports(spark, sf_dir, True)


@register("pe_hash_slots", operators=("F2", "F5"), sql=f"""
WITH {_FILES},
i0 AS (SELECT k, d, j, lower(({_LIST(DLLS)})[d + 1]) AS dll, CASE WHEN (k + d + j) % 5 <> 0 THEN ({_LIST(APIS)})[d * 3 + j + 1] END AS api
       FROM f, range(3) a(d), range(3) b(j) WHERE pe AND d < k % 4 AND j <= (k + d) % 3),
h AS (SELECT k, ('0x' || substr(sha256(dll), 63, 2))::INT % 128 AS slot FROM i0
      UNION SELECT k, 128 + ('0x' || substr(sha256(api), 63, 2))::INT % 128 FROM i0 WHERE api IS NOT NULL
      UNION SELECT k, 224 + ('0x' || substr(sha256(name), 63, 2))::INT % 32 FROM s0)
SELECT k, slot::INTEGER AS slot FROM h
""")
def q_pe_hash_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash slots set in the vector of every image."""
    f = _features(spark, sf_dir).where("is_pe").select("k", F.slice("pe_vector", 1, C.HASH_SLOT_DIM).alias("v"))
    return f.select("k", F.posexplode("v").alias("slot", "x")).where("x > 0").select("k", "slot")


@register("featurise_outcomes", operators=("A39", "A40", "W8"), sql=f"""
WITH {_FILES}
SELECT CASE WHEN NOT pe AND p_partkey_empty THEN 'failed' WHEN pe THEN 'success' ELSE 'skipped' END AS status, 0 AS stats_missing, 0 AS attributes_missing,
       (NOT pe)::INT AS header_missing, (NOT pe)::INT AS sections_missing, (NOT pe OR k % 4 = 0)::INT AS imports_missing, (NOT pe)::INT AS exports_missing,
       count(*)::BIGINT AS files, count_if(pe AND {_ERROR} IS NOT NULL)::BIGINT AS errors
FROM (SELECT *, coalesce(length(p_name), 0) = 0 AS p_partkey_empty FROM f) GROUP BY ALL
""")
def q_featurise_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes, missing feature groups and error totals over images, truncated images and other files."""
    f = _features(spark, sf_dir)
    flags = missing_flags(f)
    return (f.select(outcome_status(f).alias("status"), F.col("error").isNotNull().cast("int").alias("bad"), *[c.alias(x) for x, c in flags.items()])
             .groupBy("status", *flags).agg(F.count(F.lit(1)).alias("files"), F.sum("bad").cast("bigint").alias("errors")))


#: A long overlay makes four of the five blocks of its file full cycles, or nearly; no other file comes near the threshold.
@register("gating_summary", operators=("A36", "F12", "F13"), sql=f"""
WITH {_FILES},
g AS (SELECT k, count(*)::DOUBLE AS n, count_if(cycle AND NOT far AND {_CYCLE_E.format(n='raw', r='raw % 256')} > 0.8) AS high,
             max((name = 'UPX0')::INT)::DOUBLE AS pk, max(far::INT) AS far, any_value(overlay) AS overlay FROM s0 GROUP BY k),
v AS (SELECT f.k, coalesce(pe AND long, false) AS entropy, coalesce(high / (g.n + 1) >= 0.3, false) AS packed_sections, coalesce(far = 0 AND overlay > 0, false) AS overlay,
             coalesce(pk / (g.n + 1) >= 0.1, false) AS keywords, coalesce(pk > 0, false) AS packer_section,
             coalesce((high / (g.n + 1) > 0.4 OR pk > 0)::INT, 0) AS routing_label FROM f LEFT JOIN g USING (k)),
a AS (SELECT *, (entropy::INT + packed_sections::INT + overlay::INT + keywords::INT + packer_section::INT >= 2)::INT AS packed FROM v)
SELECT k, CASE WHEN packed = 1 THEN 'packed' ELSE 'normal' END AS decision, entropy, packed_sections, overlay, keywords, packer_section, routing_label,
       (SELECT count(*) FROM a)::BIGINT AS total, (SELECT sum(packed) FROM a)::BIGINT AS packed, (SELECT sum(1 - packed) FROM a)::BIGINT AS normal
FROM a
""")
def q_gating_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals, five-signal vote (two or more: packed) and training rule of every file, with the totals."""
    from hexlens.functions.routing import gate_signals, gate_vote, routing_label
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    f = _features(spark, sf_dir)
    given = [*map(zero, ("high_entropy_ratio", "packed_sections_ratio", "overlay_high_entropy_flag", "packer_keyword_hits_ratio")),
             [zero(f"has_{w}_section") for w in ("upx", "mpress", "aspack", "themida")]]
    signals = gate_signals(*given)
    v = f.select("k", gate_vote(*given).alias("vote"), *[c.alias(name) for name, c in signals.items()],
                 routing_label(zero("packed_sections_ratio"), zero("packer_keyword_hits_count")).alias("routing_label"))
    total = v.agg(F.count(F.lit(1)).alias("total"), F.sum("vote").cast("bigint").alias("packed"), F.sum(1 - F.col("vote")).cast("bigint").alias("normal"))
    return v.crossJoin(F.broadcast(total)).select(  # one row of totals
        "k", F.when(F.col("vote") == 1, "packed").otherwise("normal").alias("decision"), *signals, "routing_label", "total", "packed", "normal")
