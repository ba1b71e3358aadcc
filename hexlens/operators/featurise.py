"""C3 featurise: files -> 49 byte statistics + 1500-wide PE vector = 1549 row.

One narrow plan per file, without any shuffle:

* the headers and the section table are Catalyst expressions, pointer tables
  (imports, exports, ...) a UDF that only sees PE files;
* the histogram UDF counts all byte slices of a file in one call: window
  statistics, section bodies, overlay, prefix blocks;
* section and import statistics are array expressions over the file's own
  tables; hash slots (F2) too;
* named slots are normalised by name (F4), scaled, padded, L2-normalised (F3,
  F5) and concatenated with the statistics (F6).

``profile="default"`` normalises sizes by exact name and keeps integer maxima;
``"compat"`` reproduces the reference's vector exactly (quirks Q1 and Q2).
``native=True`` takes the native extractor's lists and definitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexlens import config as C
from hexlens.functions.bytes import slice_profiles
from hexlens.functions.pe import with_pe_headers
from hexlens.functions.vectors import bound, hash_slot
from hexlens.operators import byte_stats as B
from hexlens.operators import pe_features as PF
from hexlens.plans import dims as D


def named_value_sql(name: str, present: bool, profile: str) -> str:
    """F4 as SQL text: one named slot normalised, then scaled by 0.8 (one parse for all 128 slots)."""
    if not present:
        return "0.0D"
    v = f"CAST(`{name}` AS DOUBLE)"
    if profile == "compat":
        if name in D.NUMPY_INT_SLOTS:
            v = "0.0D"
        elif "size" in name:
            v = f"({v} / {C.SIZE_NORM_MAX}D)"
        elif name == "timestamp":
            v = f"({v} / {C.TIMESTAMP_MAX}D)"
        elif name == "timestamp_year":
            v = f"(({v} - {C.TIMESTAMP_YEAR_BASE}D) / {C.TIMESTAMP_YEAR_SPAN}D)"
    else:
        if name in D.SIZE_SLOTS:
            v = f"({v} / {C.SIZE_NORM_MAX}D)"
        elif name == "log_size":
            v = f"({v} / {math.log(C.SIZE_NORM_MAX)!r}D)"
        elif name == "timestamp":
            v = f"({v} / {C.TIMESTAMP_MAX}D)"
        elif name == "timestamp_year":
            v = f"(({v} - {C.TIMESTAMP_YEAR_BASE}D) / {C.TIMESTAMP_YEAR_SPAN}D)"
    return f"(coalesce({v}, 0.0D) * {C.NAMED_SLOT_SCALE}D)"


def _with_l2_normalised(df: Projections, src: str, out: str, norm_out: str) -> Projections:
    """F3 as two projections: the norm is a column, so the division does not
    re-evaluate the sum for every element."""
    df = df.withColumn(norm_out, F.sqrt(F.aggregate(src, F.lit(0.0), lambda a, x: a + x * x)))
    n = F.col(norm_out)
    return df.withColumn(out, F.when(n > 0, F.transform(src, lambda x: x / n))
                         .otherwise(F.transform(src, lambda x: F.lit(0.0))))


def hash_slots(dlls: Column, apis: Column, section_names: Column) -> Column:
    """distinct hash slots of one file (dll 0..127, api 128..255, section 224..255)."""
    return F.array_distinct(F.concat(
        F.transform(F.filter(dlls, lambda x: x.isNotNull() & (x != "")), lambda x: hash_slot(F.lower(x), 128)),
        F.transform(F.filter(apis, lambda x: x.isNotNull()), lambda x: hash_slot(x, 128) + D.HASH_API),
        F.transform(section_names, lambda x: hash_slot(x, 32) + D.HASH_SECTION_BASE)))


def hash_vector_raw(slots: Column, value=lambda s: F.lit(1.0)) -> Column:
    """256 presence values (``value``, 1.0, where a slot is set; overlapping slots OR together).

    The slots and the value are bound: the hashes would be made 256 times.
    """
    def entries(s, v):
        return F.transform(F.sequence(F.lit(0), F.lit(C.HASH_SLOT_DIM - 1)), lambda i: F.when(F.array_contains(s, i), v).otherwise(F.lit(0.0)))

    return bound(slots, lambda s: bound(value(s), lambda v: entries(s, v)))


def hash_vector_scaled(slots: Column) -> Column:
    """The presence values divided by their norm (F3) and scaled: all that are set are equal, so one is worked out."""
    return hash_vector_raw(slots, lambda s: F.lit(1.0) / F.sqrt(F.greatest(F.size(F.array_compact(s)), F.lit(1)).cast("double")) * C.HASH_SLOT_SCALE)


class Projections:
    """A frame that remembers the projections made on it, to make them again on another frame.

    The columns are unresolved expressions over names.  Their construction, some
    thirty thousand calls into the JVM, takes far longer than their analysis, and
    every micro-batch of a stream would repeat it.
    """

    _made: dict[tuple, list[tuple[str, tuple]]] = {}

    def __init__(self, df: DataFrame):
        self.df, self.steps = df, []

    def _do(self, method: str, *args) -> Projections:
        self.df = getattr(self.df, method)(*args)
        self.steps.append((method, args))
        return self

    def withColumn(self, name: str, column: Column) -> Projections:  # noqa: N802
        return self._do("withColumns", {name: column})

    def withColumns(self, columns: dict[str, Column]) -> Projections:  # noqa: N802
        return self._do("withColumns", columns)

    def select(self, *columns) -> Projections:
        return self._do("select", *columns)

    def drop(self, *columns: str) -> Projections:
        return self._do("drop", *columns)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self):
        return self.df.schema

    @classmethod
    def apply(cls, df: DataFrame, key: tuple, make) -> DataFrame:
        """``make`` on the frame: in full for the first frame of this application and key, from memory for others."""
        key = (df.sparkSession.sparkContext.applicationId, *key)
        if key not in cls._made:
            made = make(cls(df))
            cls._made[key] = made.steps
            return made.df
        for method, args in cls._made[key]:
            df = getattr(df, method)(*args)
        return df


def featurise(files: DataFrame, key: str = "path", max_file_size: int | None = None, sample_size: int | None = None,
              profile: str = "default", native: bool = False) -> DataFrame:
    """``files(key, length, content)`` -> key, sha256, is_pe, orig_length, stats, pe_vector, features, named slots.

    Every byte of a file counts unless bounds are given: ``max_file_size`` for
    the window of the 49 statistics, ``sample_size`` for the prefix of the
    entropy blocks.  ``COMPAT`` holds the reference's bounds and profile.  The
    plan is narrow: no row is exploded, grouped, joined or shuffled.  ``error``
    says what was malformed in a PE file.
    """
    f = files.select(key, F.col("length").cast("bigint").alias("length"), "content")
    return Projections.apply(f, (key, max_file_size, sample_size, profile, native), lambda p: _project(p, key, max_file_size, sample_size, profile, native))


def _project(f: Projections, key: str, max_file_size: int | None, sample_size: int | None, profile: str, native: bool) -> Projections:
    # the length is a column: each mention of the content copies it where an expression isn't compiled
    f = with_pe_headers(f.withColumns({"sha256": F.sha2("content", 256), "_n": F.length("content").cast("bigint")}))
    f = f.withColumn("is_pe", F.col("h").isNotNull())
    h, content = F.col("h"), F.col("content")
    n = F.col("_n")
    f = f.withColumn("_secs", F.coalesce(h["sections"], F.array().cast(f.schema["h"].dataType["sections"].dataType)))
    f = f.withColumn("_imports", F.coalesce(h["imports"], F.array().cast(f.schema["h"].dataType["imports"].dataType)))
    # ONE histogram call per file for every byte statistic: the 14 window
    # slices (shifted past the 8 skipped bytes), every section body, the
    # overlay, and the prefix with its entropy blocks
    n_win = F.greatest(n - C.HEADER_SKIP, F.lit(0))
    n_win = (n_win if max_file_size is None else F.least(n_win, F.lit(max_file_size - C.HEADER_SKIP))).cast("int")
    w_starts, w_lens = B.window_slices(n_win, C.HEADER_SKIP)
    a_starts, a_lens, k = B.attr_slices(n.cast("int"), sample_size, stride_blocks=native)
    clip = lambda x: F.least(x, n).cast("int")  # noqa: E731 - headers may point beyond 2**31
    ends = F.transform("_secs", lambda x: x["raw_ptr"] + x["raw_size"])
    f = f.withColumn("_ov_start", F.coalesce(F.array_max(ends), F.lit(0)).cast("bigint"))
    ov_len = F.when(F.col("is_pe"), F.greatest(F.col("length") - F.col("_ov_start"), F.lit(0))).otherwise(F.lit(0))
    f = f.withColumn("_ov_len", ov_len.cast("bigint"))
    starts = F.concat(w_starts, F.transform("_secs", lambda x: clip(x["raw_ptr"])),
                      F.array(clip(F.col("_ov_start"))), a_starts)
    lens = F.concat(w_lens, F.transform("_secs", lambda x: clip(x["raw_size"])), F.array(clip(F.col("_ov_len"))), a_lens)
    f = f.withColumns({"_starts": starts, "_lens": lens, "orig_length": n_win})
    f = f.withColumn("_sp", slice_profiles(content, F.col("_starts"), F.col("_lens")))
    f = f.withColumn("_secs_e", F.zip_with("_secs", F.slice("_sp", B.WINDOW_SLICES + 1, F.size("_secs")), lambda x, p: x.withField(
        "entropy", F.when(p["n"] >= C.SECTION_ENTROPY_MIN_SIZE, p["entropy"]).otherwise(F.lit(0.0)))))
    ov = F.get("_sp", F.lit(B.WINDOW_SLICES) + F.size("_secs"))
    tsize = F.col("_ov_len").cast("double")
    least = C.NATIVE_OVERLAY_ENTROPY_MIN_SIZE if native else C.OVERLAY_ENTROPY_MIN_SIZE
    f = f.withColumn("overlay_entropy", F.when(tsize >= least, ov["entropy"]).otherwise(0.0))
    f = f.withColumns({
        "trailing_data_size": tsize,
        "trailing_data_ratio": tsize / (F.col("length").cast("double") + 1),
        "has_large_trailing_data": ((tsize > C.LARGE_TRAILING_DATA_SIZE) if native else (tsize >= C.LARGE_TRAILING_DATA_SIZE)).cast("double"),
        "overlay_high_entropy_flag": (F.col("overlay_entropy") > C.ENTROPY_HIGH_THRESHOLD).cast("double")})
    f = B.stats_from_profiles(f, "_sp", 0)
    f = B.attrs_from_profiles(f, "_sp", F.lit(B.WINDOW_SLICES + 1) + F.size("_secs"), k, "length")
    # a non-PE file has no header features at all: missing (null), which the
    # vector maps to 0 - unlike a present 0 (e.g. timestamp_year 0 of a PE
    # without a time stamp, which is normalised like any other value)
    hdr = PF.header_features(h, F.col("length"), content)
    exp = PF.export_features(F.coalesce(h["export_names"], F.array().cast("array<string>")), h["exports_count"], F.col("length"))
    f = f.withColumns({x: F.when(F.col("is_pe"), c) for x, c in {**hdr, **exp}.items()})
    f = f.withColumn("_entry", F.coalesce(h["entry_rva"], F.lit(0)))
    _, ep_flag = PF.entry_section("_secs", "_entry", native)
    f = f.withColumn("entry_in_nonstandard_section_flag", F.when(F.col("is_pe"), ep_flag.cast("double")))
    f = f.withColumn("_slots", hash_slots(F.transform("_imports", lambda x: x["dll"]), F.transform("_imports", lambda x: x["api"]),
                                          F.transform("_secs", lambda x: x["name"])))
    f = f.withColumn("_hash", hash_vector_scaled(F.col("_slots")))
    f = f.withColumn("error", h["error"])
    f = PF.add_section_features(f, "_secs_e", "length", F.coalesce(h["file_alignment"], F.lit(0)), F.coalesce(h["section_alignment"], F.lit(0)), native)
    f = PF.add_import_features(f, "_imports", native)
    # named slots (missing -> 0) and the vectors
    named = F.expr("array(" + ", ".join(named_value_sql(x, x in f.columns, profile) for x in D.NAMED_SLOTS) + ")")
    f = _with_l2_normalised(f.withColumn("_pe_raw", F.concat("_hash", named)), "_pe_raw", "_pe_unit", "pe_norm")
    # the padding needs no element-wise work; it is what normalising a zero gives
    zero = F.when(F.col("pe_norm") > 0, F.lit(0.0) / F.col("pe_norm")).otherwise(F.lit(0.0)).cast("float")
    padding = F.array_repeat(zero, C.PE_FEATURE_VECTOR_DIM - C.HASH_SLOT_DIM - len(D.NAMED_SLOTS))
    f = f.withColumn("pe_vector", F.concat(F.col("_pe_unit").cast("array<float>"), padding))
    f = f.withColumn("features", F.concat(F.col("stats").cast("array<float>"), F.col("pe_vector")))
    keep = [key, "sha256", "is_pe", "length", "orig_length", "stats", "pe_norm", "pe_vector", "features", "error"]
    return f.select(*keep, *[F.col(f"`{c}`") for c in D.NAMED_SLOTS if c in f.columns and c not in keep])


#: The reference's bounds and vector quirks (Q1, Q2).
COMPAT = {"max_file_size": C.DEFAULT_MAX_FILE_SIZE, "sample_size": C.ENTROPY_SAMPLE_SIZE, "profile": "compat"}


def outcome_status(features: DataFrame) -> F.Column:
    """A39 status per file: success (PE features), skipped (not a PE file), failed (no bytes)."""
    return (F.when(F.col("length").isNull() | (F.col("length") == 0), F.lit("failed"))
             .when(F.col("is_pe"), F.lit("success")).otherwise(F.lit("skipped")))


def missing_flags(features: DataFrame) -> dict[str, F.Column]:
    """0/1 per feature group - 1 when the group is absent for the file."""
    miss = lambda c: F.col(c).isNull().cast("int")
    return {"stats_missing": miss("stats"), "attributes_missing": miss("file_entropy_avg"),
            "header_missing": miss("subsystem"), "sections_missing": miss("sections_count"),
            "imports_missing": miss("imports_count"), "exports_missing": miss("exports_count")}


def outcome_counts(features: DataFrame) -> DataFrame:
    """A39 + A40: files per outcome and missing-group pattern."""
    flags = missing_flags(features)
    return (features.select(outcome_status(features).alias("status"), *[c.alias(k) for k, c in flags.items()])
                    .groupBy("status", *flags).agg(F.count(F.lit(1)).alias("files")))
