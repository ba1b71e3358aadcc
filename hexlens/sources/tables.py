"""Driver tables (parquet) and their file-corpus views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; Catalyst prunes columns / pushes filters into the scan.

    Rows stay where the scan's splits put them: file bytes and texts are never
    dealt out again (``spark.sql.files.maxPartitionBytes`` sets the splits).
    """
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table seen as a file corpus with the binaryFile schema.

    ``path = source/doc_id.lang``, ``content`` = UTF-8 bytes of the text,
    ``length`` = byte length; ``modificationTime`` is derived from doc_id so
    arrival order is deterministic.  ``doc_id`` is kept as the file key.
    """
    d = table(spark, sf_dir, "documents")
    content = F.encode("text", "UTF-8")
    return d.select(
        "doc_id", "source", "lang",
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang")).alias("path"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("modificationTime"),
        F.octet_length("text").cast("bigint").alias("length"),
        content.alias("content"),
    )


def pages_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as files: path from the URL path, content = UTF-8 html."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.col("page_id").alias("doc_id"),
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("modificationTime"),
        F.octet_length("html").cast("bigint").alias("length"),
        F.encode("html", "UTF-8").alias("content"),
    )
