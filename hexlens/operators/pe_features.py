"""PE section / overlay / entry-point features.

A file's own section and import arrays are reduced in place (array
expressions, no rows, no shuffle); section tables that come as rows are a
grouped aggregation with partial sums.  Entropy of section bytes and the
overlay come from the per-file byte UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexlens import config as C

# Python profile: sections named like these are standard executable sections
STANDARD_EXEC_SECTIONS = [".text", "text", ".code"]


def section_features(sections: DataFrame, file_key: str, file_size: Column | None = None,
                     file_align: Column | None = None, sect_align: Column | None = None,
                     native: bool = False) -> DataFrame:
    """A16, A17 (when an ``entropy`` column exists), A18, A19, A21 per file.

    Input: one row per section.  One hash aggregation
    with codegen'd conditional sums; the shuffle moves compact section rows
    keyed by file (partial aggregation first).  Files with no sections are
    absent here and get zeros when joined back (ratios 0, as in the reference).
    Python profile by default; ``native=True`` switches the §1.3 differences.
    """
    common_sections, packer_keywords = (C.keyword_lists(native)[k] for k in ("common_sections", "packer_sections"))
    raw = F.col("raw_size").cast("double")
    vs = F.col("virtual_size").cast("double")
    ch = F.col("characteristics").cast("bigint")
    ex = ch.bitwiseAND(F.lit(C.SCN_MEM_EXECUTE)) != 0
    rd = ch.bitwiseAND(F.lit(C.SCN_MEM_READ)) != 0
    wr = ch.bitwiseAND(F.lit(C.SCN_MEM_WRITE)) != 0
    data = ~ex if native else rd
    rwx = (ex & wr & rd) if native else (ex & wr)
    name = F.coalesce(F.col("name"), F.lit(""))
    low = F.lower(name)
    nlen = F.length(name).cast("double")
    cnt = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    aggs = [
        F.count(F.lit(1)).cast("double").alias("sections_count"),
        F.countDistinct(name).cast("double").alias("section_names_count"),
        F.sum(raw).alias("section_total_size"), F.sum(vs).alias("section_total_vsize"),
        F.avg(raw).alias("avg_section_size"), F.avg(vs).alias("avg_section_vsize"),
        F.max(raw).alias("max_section_size"), F.min(raw).alias("min_section_size"),
        F.stddev_pop(raw).alias("section_size_std"),
        cnt(ex).alias("executable_sections_count"), cnt(wr).alias("writable_sections_count"),
        cnt(rd).alias("readable_sections_count"), cnt(rwx).alias("rwx_sections_count"),
        F.sum(F.when(ex, raw).otherwise(0.0)).alias("_code"), F.sum(F.when(data, raw).otherwise(0.0)).alias("_data"),
        F.sum(F.when(ex, vs).otherwise(0.0)).alias("_codev"), F.sum(F.when(data, vs).otherwise(0.0)).alias("_datav"),
        cnt(ex & ~low.isin(STANDARD_EXEC_SECTIONS)).alias("non_standard_executable_sections_count"),
        F.avg(nlen).alias("section_name_avg_length"), F.max(nlen).alias("section_name_max_length"),
        F.min(nlen).alias("section_name_min_length"),
        F.sum(F.length(F.regexp_replace(name, r"[\p{L}\p{N}_.]", "")).cast("double")).alias("_special"),
        F.sum(nlen).alias("_chars"),
        cnt(nlen > 6).alias("long_sections_count"), cnt(nlen < 3).alias("short_sections_count"),
        sum((F.max(F.when(F.instr(low, k) > 0, 1.0).otherwise(0.0)) for k in packer_keywords), F.lit(0.0)).alias("packer_keyword_hits_count"),
    ]
    aggs += [F.max(F.when(low == sec.lower(), 1).otherwise(0)).alias(f"has_{sec}_section") for sec in common_sections]
    aggs += [F.max(F.when(F.instr(low, k) > 0, 1).otherwise(0)).alias(f"has_{k}_section")
             for k in ("upx", "mpress", "aspack", "themida")]
    if file_align is not None and sect_align is not None:
        fa, sa = F.col("_fa"), F.col("_sa")
        aggs.append((cnt((fa > 0) & (F.pmod(F.col("raw_size"), F.greatest(fa, F.lit(1))) != 0))
                     + cnt((sa > 0) & (F.pmod(F.col("virtual_size"), F.greatest(sa, F.lit(1))) != 0)))
                    .alias("alignment_mismatch_count"))
        sections = sections.withColumn("_fa", file_align).withColumn("_sa", sect_align)
    has_entropy = "entropy" in sections.columns
    if has_entropy:
        e = F.col("entropy")
        aggs += [F.avg(e).alias("section_entropy_avg"), F.min(e).alias("section_entropy_min"),
                 F.max(e).alias("section_entropy_max"), F.stddev_pop(e).alias("section_entropy_std"),
                 cnt(e > C.ENTROPY_HIGH_THRESHOLD).alias("_high")]
    if file_size is not None:
        sections = sections.withColumn("_fsize", file_size.cast("double"))
        aggs.append(F.first("_fsize").alias("_fsize"))
    out = sections.groupBy(file_key).agg(*aggs)
    c = F.col
    n1 = c("sections_count") + 1
    derived = {
        "code_section_ratio": c("_code") / (c("section_total_size") + 1),
        "data_section_ratio": c("_data") / (c("section_total_size") + 1),
        "code_vsize_ratio": c("_codev") / (c("section_total_vsize") + 1),
        "data_vsize_ratio": c("_datav") / (c("section_total_vsize") + 1),
        "executable_sections_ratio": c("executable_sections_count") / n1,
        "writable_sections_ratio": c("writable_sections_count") / n1,
        "readable_sections_ratio": c("readable_sections_count") / n1,
        "rwx_sections_ratio": c("rwx_sections_count") / n1,
        "executable_writable_sections": c("rwx_sections_count"),
        "long_sections_ratio": c("long_sections_count") / n1,
        "short_sections_ratio": c("short_sections_count") / n1,
        "packer_keyword_hits_ratio": c("packer_keyword_hits_count") / n1,
        "special_char_ratio": c("_special") / (c("_chars") + 1),
        "section_size_cv": F.when(c("avg_section_size") > 0, c("section_size_std") / c("avg_section_size")).otherwise(0.0) if native
        else c("section_size_std") / (c("avg_section_size") + 1e-8),
        "executable_code_density": c("_code") / ((c("_fsize") if native and file_size is not None
                                                 else c("section_total_size")) + 1),
    }
    if file_align is not None and sect_align is not None:
        derived["alignment_mismatch_ratio"] = c("alignment_mismatch_count") / (2 * c("sections_count") + 1)
    if has_entropy:
        derived["packed_sections_ratio"] = c("_high") / (c("sections_count") if native else n1)
    out = out.select("*", *[v.alias(k) for k, v in derived.items()])
    return out.drop(*[x for x in ("_code", "_data", "_codev", "_datav", "_special", "_chars", "_high", "_fsize")
                      if x in out.columns])


def entry_section(sections: str, entry_rva: str, native: bool = False) -> tuple[Column, Column]:
    """First section (table order) with va <= entry < va + extent; flag when nonstandard.

    Python profile extent = virtual size; native = max(virtual, raw).
    """
    e = F.col(entry_rva)

    def extent(x):
        return F.greatest(x["virtual_size"], x["raw_size"]) if native else x["virtual_size"]

    hit = F.filter(F.col(sections), lambda x: (x["va"] <= e) & (e < x["va"] + extent(x)))
    # first in table order; ties (equal pos) broken by name so the choice is deterministic
    first = F.array_min(F.transform(hit, lambda x: F.struct(x["pos"].alias("pos"), x["name"].alias("name"))))
    flag = F.when(F.size(hit) > 0, (~F.lower(first["name"]).isin(STANDARD_EXEC_SECTIONS)).cast("int")).otherwise(0)
    return first["name"], flag


# ---------------------------------------------------------------------------
# A16-A19, A21 from one file's own section array (narrow)
# ---------------------------------------------------------------------------

def _sum(arr: Column, f) -> Column:
    return F.aggregate(F.transform(arr, f), F.lit(0.0), lambda a, x: a + x)


def _count(arr: Column, f) -> Column:
    return F.size(F.filter(arr, f)).cast("double")


def _std(arr: Column, n: Column, mean: Column, f) -> Column:
    return F.sqrt(_sum(arr, lambda x: (f(x) - mean) * (f(x) - mean)) / n)


def add_section_features(df: DataFrame, sections: str, file_size: str, file_align: Column, sect_align: Column,
                         native: bool = False) -> DataFrame:
    """A16-A19, A21 per file from the array ``sections`` (structs with ``entropy``): no rows, no shuffle.

    The same features as :func:`section_features`, which aggregates section
    rows; null for a file without sections.
    """
    lists = C.keyword_lists(native)
    s, n = F.col(sections), F.size(sections).cast("double")
    raw = lambda x: x["raw_size"].cast("double")
    vs = lambda x: x["virtual_size"].cast("double")
    flag = lambda bit: lambda x: x["characteristics"].bitwiseAND(F.lit(bit)) != 0
    ex, rd, wr = flag(C.SCN_MEM_EXECUTE), flag(C.SCN_MEM_READ), flag(C.SCN_MEM_WRITE)
    data = (lambda x: ~ex(x)) if native else rd
    rwx = (lambda x: ex(x) & wr(x) & rd(x)) if native else (lambda x: ex(x) & wr(x))
    low = lambda x: F.lower(x["name"])
    nlen = lambda x: F.length(x["name"]).cast("double")
    ent = lambda x: x["entropy"]
    has = lambda pred: F.exists(s, pred).cast("int")
    holds = lambda word: lambda x: F.contains(low(x), F.lit(word))
    is_called = lambda name: lambda x: low(x) == name.lower()
    first = {
        "sections_count": n, "section_names_count": F.size(F.array_distinct(F.transform(s, lambda x: x["name"]))).cast("double"),
        "section_total_size": _sum(s, raw), "section_total_vsize": _sum(s, vs),
        "max_section_size": F.array_max(F.transform(s, raw)), "min_section_size": F.array_min(F.transform(s, raw)),
        "executable_sections_count": _count(s, ex), "writable_sections_count": _count(s, wr),
        "readable_sections_count": _count(s, rd), "rwx_sections_count": _count(s, rwx),
        "_code": _sum(F.filter(s, ex), raw), "_data": _sum(F.filter(s, data), raw),
        "_codev": _sum(F.filter(s, ex), vs), "_datav": _sum(F.filter(s, data), vs),
        "non_standard_executable_sections_count": _count(s, lambda x: ex(x) & ~low(x).isin(STANDARD_EXEC_SECTIONS)),
        "section_name_avg_length": _sum(s, nlen) / n, "section_name_max_length": F.array_max(F.transform(s, nlen)),
        "section_name_min_length": F.array_min(F.transform(s, nlen)),
        "_special": _sum(s, lambda x: F.length(F.regexp_replace(x["name"], r"[\p{L}\p{N}_.]", "")).cast("double")),
        "_chars": _sum(s, nlen), "long_sections_count": _count(s, lambda x: nlen(x) > 6),
        "short_sections_count": _count(s, lambda x: nlen(x) < 3),
        "packer_keyword_hits_count": sum((F.exists(s, holds(k)).cast("double") for k in lists["packer_sections"]), F.lit(0.0)),
        "alignment_mismatch_count": F.when(file_align > 0, _count(s, lambda x: F.pmod(x["raw_size"], file_align) != 0)).otherwise(0.0)
        + F.when(sect_align > 0, _count(s, lambda x: F.pmod(x["virtual_size"], sect_align) != 0)).otherwise(0.0),
        "section_entropy_avg": _sum(s, ent) / n, "section_entropy_min": F.array_min(F.transform(s, ent)),
        "section_entropy_max": F.array_max(F.transform(s, ent)), "_high": _count(s, lambda x: ent(x) > C.ENTROPY_HIGH_THRESHOLD),
    }
    first |= {f"has_{sec}_section": has(is_called(sec)) for sec in lists["common_sections"]}
    first |= {f"has_{k}_section": has(holds(k)) for k in ("upx", "mpress", "aspack", "themida")}
    some = F.size(sections) > 0
    out = df.withColumns({k: F.when(some, v) for k, v in first.items()})
    c, n1 = F.col, F.col("sections_count") + 1
    total, vtotal = c("section_total_size"), c("section_total_vsize")
    second = {"avg_section_size": total / c("sections_count"), "avg_section_vsize": vtotal / c("sections_count")}
    out = out.withColumns(second)
    third = {
        "section_size_std": F.when(some, _std(s, n, c("avg_section_size"), raw)),
        "section_entropy_std": F.when(some, _std(s, n, c("section_entropy_avg"), ent)),
        "code_section_ratio": c("_code") / (total + 1), "data_section_ratio": c("_data") / (total + 1),
        "code_vsize_ratio": c("_codev") / (vtotal + 1), "data_vsize_ratio": c("_datav") / (vtotal + 1),
        "executable_sections_ratio": c("executable_sections_count") / n1, "writable_sections_ratio": c("writable_sections_count") / n1,
        "readable_sections_ratio": c("readable_sections_count") / n1, "rwx_sections_ratio": c("rwx_sections_count") / n1,
        "executable_writable_sections": c("rwx_sections_count"), "long_sections_ratio": c("long_sections_count") / n1,
        "short_sections_ratio": c("short_sections_count") / n1, "packer_keyword_hits_ratio": c("packer_keyword_hits_count") / n1,
        "special_char_ratio": c("_special") / (c("_chars") + 1),
        "executable_code_density": c("_code") / ((c(file_size).cast("double") if native else total) + 1),
        "alignment_mismatch_ratio": c("alignment_mismatch_count") / (2 * c("sections_count") + 1),
        "packed_sections_ratio": c("_high") / (c("sections_count") if native else n1),
    }
    out = out.withColumns(third)
    mean = c("avg_section_size")
    out = out.withColumn("section_size_cv", F.when(mean > 0, c("section_size_std") / mean).otherwise(F.when(some, 0.0)) if native
                         else c("section_size_std") / (mean + 1e-8))
    return out.drop("_code", "_data", "_codev", "_datav", "_special", "_chars", "_high")


# ---------------------------------------------------------------------------
# A11-A14, J6, J7 imports from one file's own import array (narrow)
# ---------------------------------------------------------------------------

IMPORT_FEATURES = ["imports_count", "unique_imports", "unique_dlls", "unique_apis", "dll_name_avg_length",
                   "dll_name_max_length", "dll_name_min_length", "imported_system_dlls_count",
                   "dll_imports_entropy", "api_imports_entropy", "imported_system_dlls_ratio", "syscall_api_ratio",
                   "import_ordinal_only_count", "import_ordinal_only_ratio", "avg_imports_per_dll",
                   "api_network_ratio", "api_process_ratio", "api_filesystem_ratio", "api_registry_ratio"]


def _with_item_entropies(df: DataFrame, items: dict[str, Column]) -> DataFrame:
    """Entropy/8 of the distribution of each array's values: sorted, then run lengths (n log n, per row)."""
    def edge(out):  # positions at which a run begins, and the end
        a, n = F.col(f"_{out}_s"), F.size(f"_{out}_s")
        return lambda i: (i == 0) | (i == n) | (F.get(a, i) != F.get(a, i - 1))

    def term(out):
        n = F.size(f"_{out}_s").cast("double")
        return lambda acc, c: acc - (c / n) * F.log2(c / n)

    df = df.withColumns({f"_{o}_s": F.array_sort(v) for o, v in items.items()})
    df = df.withColumns({f"_{o}_e": F.filter(F.sequence(F.lit(0), F.size(f"_{o}_s")), edge(o)) for o in items})
    df = df.withColumns({f"_{o}_c": F.zip_with(F.slice(f"_{o}_e", 2, F.greatest(F.size(f"_{o}_e") - 1, F.lit(0))),
                                                F.slice(f"_{o}_e", 1, F.greatest(F.size(f"_{o}_e") - 1, F.lit(0))), lambda x, y: (x - y).cast("double"))
                         for o in items})
    ent = {o: F.when(F.size(f"_{o}_s") > 0, F.aggregate(f"_{o}_c", F.lit(0.0), term(o)) / 8.0 + 0.0).otherwise(0.0) for o in items}
    return df.withColumns(ent).drop(*[f"_{o}{x}" for o in items for x in ("_s", "_e", "_c")])


def add_import_features(df: DataFrame, imports: str, native: bool = False) -> DataFrame:
    """A11-A14, J6, J7 per file from the array ``imports`` (entry_pos, dll, api, ordinal): no rows, no shuffle.

    Null for a file without imports.  Descriptor-level values (dll names) use
    one value a descriptor; function-level ones every import.  Keyword
    categories are expressions over the profile's fixed lists; a system DLL is
    a listed name before the first dot.
    """
    lists = C.keyword_lists(native)
    i = F.col(imports)
    named = F.filter(i, lambda x: x["api"].isNotNull())
    desc = F.transform(F.array_distinct(F.transform(i, lambda x: F.struct(x["entry_pos"].alias("p"), x["dll"].alias("d")))), lambda x: x["d"])
    texts = F.transform(named, lambda x: F.lower(F.concat_ws(" ", x["dll"], x["api"])))  # made once, not for every keyword
    df = df.withColumns({"_dlls": desc, "_named": named, "_texts": texts,
                         "_ordinal": _count(i, lambda x: x["api"].isNull() & x["ordinal"].isNotNull())})
    dlls, names = F.col("_dlls"), F.col("_named")
    df = df.withColumns({"_dlen": F.transform(F.filter(dlls, lambda d: F.length(d) > 0), lambda d: F.length(d).cast("double")),
                         "_n_named": F.size("_named").cast("double"), "unique_dlls": F.size(F.array_distinct("_dlls")).cast("double")})
    df = _with_item_entropies(df, {"dll_imports_entropy": F.filter(dlls, lambda d: d != ""),
                                   "api_imports_entropy": F.transform(F.filter(names, lambda x: x["api"] != ""), lambda x: x["api"])})
    stems = F.transform(dlls, lambda d: F.substring_index(d, ".", 1))
    lower = lambda x: F.lower(x["api"])
    hits = lambda words: lambda t: reduce(Column.__or__, (F.contains(t, F.lit(w.lower())) for w in words), F.lit(False))
    none = F.size("_dlen") == 0
    n_named, total = F.col("_n_named"), F.col("_n_named") + F.col("_ordinal")
    df = df.withColumn("imported_system_dlls_count", F.size(F.array_distinct(F.filter(stems, lambda d: d.isin(lists["system_dlls"])))).cast("double"))
    feats = {
        "imports_count": F.size("_dlls").cast("double"),
        "unique_imports": F.size(F.array_distinct(F.transform(names, lambda x: F.struct(x["dll"].alias("d"), x["api"].alias("a"))))).cast("double"),
        "unique_apis": F.size(F.array_distinct(F.transform(names, lambda x: x["api"]))).cast("double"),
        "dll_name_avg_length": F.when(none, 0.0).otherwise(F.aggregate("_dlen", F.lit(0.0), lambda a, x: a + x) / F.size("_dlen")),
        "dll_name_max_length": F.when(none, 0.0).otherwise(F.array_max("_dlen")),
        "dll_name_min_length": F.when(none, 0.0).otherwise(F.array_min("_dlen")),
        "imported_system_dlls_ratio": F.col("imported_system_dlls_count") / ((F.size("_dlls") if native else F.col("unique_dlls")) + 1),
        "syscall_api_ratio": F.when(n_named > 0, _count(names, lambda x: F.startswith(lower(x), F.lit("nt")) | F.startswith(lower(x), F.lit("zw"))) / (n_named + 1)).otherwise(0.0),
        "import_ordinal_only_count": F.col("_ordinal"),
        "import_ordinal_only_ratio": F.col("_ordinal") / (total + 1),
        "avg_imports_per_dll": total / (F.col("unique_dlls") + 1),
    }
    feats |= {f"api_{k}_ratio": F.when(n_named > 0, _count(F.col("_texts"), hits(w)) / (total + 1)).otherwise(0.0)
              for k, w in lists["api"].items()}
    df = df.withColumns(feats)
    some = F.size(imports) > 0
    return df.withColumns({k: F.when(some, F.col(k)) for k in IMPORT_FEATURES}).drop("_dlls", "_named", "_texts", "_ordinal", "_dlen", "_n_named")


def export_features(names: Column, count: Column, file_size: Column) -> dict[str, Column]:
    """A15 from the export-name array of one file."""
    lens = F.transform(names, lambda x: F.length(x).cast("double"))
    k = F.size(names).cast("double")
    has = k > 0
    return {
        "exports_count": F.coalesce(count, F.lit(0)).cast("double"),
        "export_name_avg_length": F.when(has, F.aggregate(lens, F.lit(0.0), lambda a, x: a + x) / k).otherwise(0.0),
        "export_name_max_length": F.when(has, F.array_max(lens)).otherwise(0.0),
        "export_name_min_length": F.when(has, F.array_min(lens)).otherwise(0.0),
        "exports_density": F.when(has, k / (file_size.cast("double") + 1)).otherwise(0.0),
        "exports_name_ratio": F.when(has, k / (F.coalesce(count, F.lit(0)).cast("double") + 1)).otherwise(0.0),
    }


def header_features(h: Column, file_size: Column, content: Column | None = None) -> dict[str, Column]:
    """A38, F7, F8, F10 and the header scalars of one parsed file (struct ``h``)."""
    from hexlens.functions.pe import dll_flags, pe_timestamp, signature_probe
    size = file_size.cast("double")
    flag = lambda c: (F.coalesce(c, F.lit(0)) > 0).cast("double")
    ts, year = pe_timestamp(h["time_date_stamp"])
    cols = {
        "symbols_count": F.coalesce(h["symbols_count"], F.lit(0)).cast("double"),
        "subsystem": F.coalesce(h["subsystem"], F.lit(0)).cast("double"),
        "dll_characteristics": F.coalesce(h["dll_characteristics"], F.lit(0)).cast("double"),
        "has_resources": flag(h["resource_size"]),
        "has_debug_info": flag(h["debug_size"]),
        "has_tls": flag(h["tls_size"]),
        "has_relocs": flag(h["reloc_size"]),
        "has_exceptions": flag(h["exception_size"]),
        "resources_count": F.coalesce(h["resources_count"], F.lit(0)).cast("double"),
        "tls_callbacks_count": F.coalesce(h["tls_callbacks"], F.lit(0)).cast("double"),
        "reloc_blocks_count": F.coalesce(h["reloc_blocks"], F.lit(0)).cast("double"),
        "reloc_entries_count": F.coalesce(h["reloc_entries"], F.lit(0)).cast("double"),
        "checksum_zero_flag": F.when(h["machine"].isNotNull() & (F.coalesce(h["checksum"], F.lit(0)) == 0), 1.0)
                               .otherwise(0.0),
        "pe_header_size": F.coalesce(h["size_of_headers"], F.lit(0)).cast("double"),
        "header_size_ratio": F.coalesce(h["size_of_headers"], F.lit(0)).cast("double") / (size + 1),
        "entry_point_ratio": F.coalesce(h["entry_rva"], F.lit(0)).cast("double") / (size + 1),
        "timestamp": ts.cast("double"),
        "timestamp_year": year.cast("double"),
    }
    cols.update({k: v.cast("double") for k, v in dll_flags(F.coalesce(h["dll_characteristics"], F.lit(0))).items()})
    if content is not None:
        cols.update({k: v.cast("double") for k, v in
                     signature_probe(content, h["security_va"], h["security_size"]).items()})
    return cols
