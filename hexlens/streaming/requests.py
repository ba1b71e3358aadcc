"""Requests for many files, admitted or rejected whole, and their answers.

A request is its rows of (id, file_path); none is ever held as one list.  A
request of more files than the limit gets an error and scans nothing; the others
are scanned together, each path once, and get their counts and totals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexlens import config as C
from hexlens.session import materialize
from hexlens.sources.files import path_guard

VERSION = 1


def admit(paths: DataFrame, limit: int = C.SERVICE_MAX_BATCH_SIZE, id_col: str = "id") -> DataFrame:
    """A row a request: id, files (asked for, repeats counted) and ok.  Requests are counted before they are shuffled."""
    return paths.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("files")).withColumn("ok", F.col("files") <= limit)


def answer(paths: DataFrame, scan: Callable[[DataFrame], DataFrame], limit: int = C.SERVICE_MAX_BATCH_SIZE, allowed_root: str | None = None,
           id_col: str = "id", path_col: str = "file_path") -> DataFrame:
    """T4 envelopes: version, id, ok, files, scanned, malware, error{code, message}.

    ``scan`` gets the distinct paths (``path``) of the admitted requests that
    pass the guard, and returns file_path and is_malware of those it could scan.
    Null ids are one request; null paths count but are not scanned.
    """
    asked = paths.select(F.col(id_col).alias("id"), F.col(path_col).alias("file_path"))
    requests = materialize(admit(asked, limit), "requests")  # a row a request
    let_in = requests.where("ok").select(F.col("id").alias("_id"))
    wanted = materialize(asked.join(let_in, F.col("id").eqNullSafe(F.col("_id")), "left_semi").where(F.col("file_path").isNotNull()), "admitted")
    todo = wanted.select(F.col("file_path").alias("path")).distinct().where(path_guard("path", allowed_root))
    found = scan(todo).select("file_path", "is_malware")
    done = wanted.join(found, "file_path").groupBy("id").agg(F.count(F.lit(1)).alias("scanned"), F.count_if("is_malware").alias("malware"))
    done = done.select(F.col("id").alias("_id"), "scanned", "malware")
    error = F.struct(F.lit("batch_too_large").alias("code"), F.format_string(f"%d files, at most {limit}", "files").alias("message"))
    zero = lambda c: F.when(F.col("ok"), F.coalesce(c, F.lit(0).cast("long")))
    return requests.join(done, F.col("id").eqNullSafe(F.col("_id")), "left").select(
        F.lit(VERSION).alias("version"), "id", "ok", "files", zero(F.col("scanned")).alias("scanned"), zero(F.col("malware")).alias("malware"),
        F.when(~F.col("ok"), error).alias("error"))
