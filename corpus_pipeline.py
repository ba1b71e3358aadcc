"""From raw documents to packed token sequences: five stages, each one of the ``hexlens.llm`` operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexlens.llm import decontam, jaccard, packing, quality, substring
from hexlens.llm.common import prepare, release, table, write_step


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.7 or more).

    A null or empty text is scored like any other; repeated rows are scored one
    by one; without labels all documents stay.  Columns may have any names.
    """
    prepare(spark)
    return quality.keep(docs, *quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (Jaccard of 0.8 or more on five-word n-grams)."""
    prepare(spark)
    return jaccard.first_of_class(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that occur again.

    A text that loses words is its other words joined by a space, with n_chars
    set anew; a document that loses all its words goes; others, null and empty
    texts among them, are unchanged.  Repeated rows of 35 words or more lose all
    they share.  Columns may have any names; an empty table stays empty.
    """
    prepare(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = substring.dedup(docs, carry=others)
    out = out.filter("ss_n_removed = 0 or ss_n_removed < ss_n_words")
    text = F.when(F.col("ss_n_removed") > 0, F.col("ss_kept")).otherwise(F.col("text"))
    new = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col("carried").getField(c) for c in others}
    if "n_chars" in new:
        new["n_chars"] = F.when(F.col("ss_n_removed") > 0, F.char_length("ss_kept").cast("long")).otherwise(new["n_chars"])
    return out.select(*(new[c] for c in docs.columns)).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and empty texts hold none; repeated rows are judged one by one; an
    empty benchmark keeps everything.  Columns may have any names.
    """
    prepare(spark)
    return decontam.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids: a row for each piece of a document.

    A null or empty text is one id; repeated rows are documents of their own.
    """
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("pack", pack),
]

#: SQL can't express the classifier or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet and read again; a step goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = write_step(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            release(spark, before)
        before = path
    return docs
