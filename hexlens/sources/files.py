"""File-corpus source (S1-S3, S5, S6) and path/header predicates.

The corpus is Spark's ``binaryFile`` source: ``path, modificationTime,
length, content``.  Length and time filters are pushed into the listing and
``content`` is only read when a later operator uses it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def read_files(spark: SparkSession, root: str, recursive: bool = False, glob: str | None = None,
               max_size: int | None = None) -> DataFrame:
    """S1 (+P3): list files under ``root``; optional glob and size limit.  Spark lists no files of zero bytes."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root)
    if max_size is not None:
        df = df.where(F.col("length") <= max_size)
    return df


def read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files of a bounded list of paths, as the source named them."""
    plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]
    return spark.read.format("binaryFile").load(plain)


def stream_files(spark: SparkSession, root: str, max_files_per_trigger: int | None = None,
                 glob: str | None = None, max_file_age: str = "36500d") -> DataFrame:
    """T1/T2 source: newly arrived files (in subfolders too), at most N per micro-batch.

    Spark passes over files that are ``maxFileAge`` older than the newest one it
    has seen (a week by default), which would lose copies and restores with old
    times.  The long default keeps them; the price is that the source
    remembers every path it has seen.  Where old files are moved away, a
    shorter age bounds that memory.
    """
    r = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", "true")
         .option("maxFileAge", max_file_age))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(root)


# ---------------------------------------------------------------------------
# F9 path parts, S2 extension filter
# ---------------------------------------------------------------------------

def strip_scheme(path) -> Column:
    return F.regexp_replace(_c(path), r"^file:", "")


def base_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def parent_name(path) -> Column:
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.lit(""))


def extension(path) -> Column:
    """Lower-cased extension with the dot ('' when none), like ``Path.suffix``."""
    name = base_name(path)
    return F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1))


def ext_filter(df: DataFrame, extensions: list[str] | None, path: str = "path") -> DataFrame:
    """Keep files whose lowered extension (with dot) is listed; None keeps all."""
    if not extensions:
        return df
    return df.where(extension(path).isin([e.lower() for e in extensions]))


# ---------------------------------------------------------------------------
# P1 path guard, P2 PE magic
# ---------------------------------------------------------------------------

def path_guard(path, allowed_root: str | None = None, case_insensitive: bool = False) -> Column:
    """Non-empty, no NUL, and equal to or under ``allowed_root``."""
    p = _c(path)
    ok = (F.length(p) > 0) & (F.instr(p, "\u0000") == 0)
    if allowed_root:
        root = allowed_root.rstrip("/")
        pp, rr = (F.lower(p), F.lit(root.lower())) if case_insensitive else (p, F.lit(root))
        ok = ok & ((pp == rr) | F.startswith(pp, F.concat(rr, F.lit("/"))))
    return ok


def le_uint(content, offset0, width: int) -> Column:
    """Little-endian unsigned integer of ``width`` bytes at a 0-based offset; null when not all of it is there."""
    off = (offset0 if isinstance(offset0, Column) else F.lit(offset0)).cast("bigint")
    at = F.least(off, F.length(_c(content)).cast("bigint"))  # hostile offsets exceed an int: beyond the end is null
    own = F.substring(_c(content), (at + 1).cast("int"), width)
    return le_of_reversed(F.when(F.length(own) == width, F.reverse(F.hex(own))), width)


def le_of_reversed(digits, width: int) -> Column:
    """The little-endian unsigned integer of ``width`` bytes (7 at most) whose hex digits are given from last to first.

    Reversed digits are the bytes in the order wanted, the two digits of each
    exchanged: cheaper than cutting every byte out of the text.
    """
    v, low = F.conv(digits, 16, 10).cast("bigint"), int("0f" * width, 16)
    return F.shiftleft(v.bitwiseAND(F.lit(low)), 4).bitwiseOR(F.shiftright(v, 4).bitwiseAND(F.lit(low)))


def is_pe(content) -> Column:
    """P2: 'MZ', e_lfanew at 0x3C, 'PE\\0\\0' there."""
    c = _c(content)
    mz = F.substring(c, 1, 2) == F.unhex(F.lit("4D5A"))
    off = le_uint(c, 0x3C, 4)
    at = F.least(off, F.length(c).cast("bigint"))
    sig = F.substring(c, (at + 1).cast("int"), 4) == F.unhex(F.lit("50450000"))
    return F.coalesce(mz & off.isNotNull() & sig, F.lit(False))


# ---------------------------------------------------------------------------
# P6/P7 labels from names
# ---------------------------------------------------------------------------

def infer_label(path, mode: str = "filename") -> Column:
    """0 when the file (or parent directory) name says benign/good/clean, else 1."""
    if mode not in ("filename", "directory"):
        return F.lit(1)
    name = F.lower(base_name(path) if mode == "filename" else parent_name(path))
    return F.when(name.rlike("benign|good|clean"), 0).otherwise(1)


def resolve_label(name, stored) -> Column:
    """whitelist/benign/good/clean -> 0; malicious/virus/trojan -> 1; stored; else 1."""
    n = F.lower(_c(name))
    s = _c(stored).cast("string")
    stored_val = F.when(F.lower(s).isin("benign", "0"), 0).when(F.lower(s).isin("malicious", "1"), 1)
    return (F.when(n.rlike("whitelist|benign|good|clean"), 0)
             .when(n.rlike("malicious|virus|trojan"), 1)
             .otherwise(F.coalesce(stored_val, F.lit(1))))


def read_metadata_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON objects ``{filename: label}``, one a file (or one a line) -> rows ``(filename, label)``."""
    raw = spark.read.option("wholetext", str(not lines).lower()).text(path)
    m = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return raw.select(F.explode(m).alias("filename", "label"))


def read_samples(spark: SparkSession, samples_path: str, metadata: DataFrame, max_length: int,
                 pe_dim: int = 1500) -> DataFrame:
    """Stored samples for every metadata row; missing ones become zeros with orig_length 0.

    ``byte_sequence`` is zero padded / truncated to ``max_length``, the PE
    vector to ``pe_dim``.  A left join from the metadata keeps every listed file.
    """
    s = spark.read.parquet(samples_path)
    j = metadata.select("filename", "label").join(s, "filename", "left")
    seq = F.coalesce(F.col("byte_sequence"), F.lit(b"").cast("binary"))
    pad = F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(max_length) - F.length(seq), F.lit(0))))
    pe = F.coalesce(F.col("pe_features").cast("array<float>"), F.array().cast("array<float>"))
    pe_fixed = F.slice(F.concat(pe, F.array_repeat(F.lit(0.0).cast("float"), pe_dim)), 1, pe_dim)
    return j.select("filename", "label",
                    F.substring(F.concat(seq, pad), 1, max_length).alias("byte_sequence"),
                    pe_fixed.alias("pe_features"),
                    F.least(F.coalesce(F.col("orig_length"), F.lit(0)), F.lit(max_length)).cast("int").alias("orig_length"))
