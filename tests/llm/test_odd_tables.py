"""Clashing column names in every stage, and samples that stay bounded when one id is on very many rows."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hexlens.llm import language, packing, quality, toxicity
from hexlens.llm.common import free_name, prepare

SF = "/root/testdata/sf0.001"
CLASHING = ["ss_kept", "ss_removed", "ss_n_removed", "ss_n_words", "ss_group", "carried", "jc_row", "JC_ROW_", "node", "class_id", "n_links", "score", "predicted", "y", "x",
            "item_id", "words", "shard", "start", "gid", "bin", "home", "bucket", "payload", "label", "a.b"]


def test_free_names():
    assert free_name("a", ["b"]) == "a" and free_name("a", ["A", "a_"]) == "a__"


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_of_any_name(spark, docs_of, prose, k):
    prepare(spark)
    docs = docs_of([(1, prose(1, 60)), (2, prose(1, 60)), (3, prose(2, 30) + " " + prose(3, 40)), (4, prose(4, 30) + " " + prose(3, 40)), (5, None), (6, ""), (None, prose(9, 50))])
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows or name == "quality_filter"
    for r in rows:
        for c in CLASHING:
            assert r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}")


@pytest.fixture
def repeated(spark, docs_of):
    """One id on 3000 rows, with as many texts, and a few others."""
    rows = [(7, f"the same id {k} of word{k % 50} and und der die das {'gift' if k % 2 else 'gut'}") for k in range(3000)] + [(k, f"good text {k}") for k in range(100, 140)]
    return docs_of(rows)


def collected(monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    seen, real = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: (seen.append(real(self)), seen[-1])[1])
    return seen


def test_samples_are_bounded_by_rows(spark, repeated, monkeypatch):
    prepare(spark)
    seen = collected(monkeypatch)
    labels = spark.createDataFrame([(7, 1, 1), *[(k, k % 2, 0) for k in range(100, 140)]], "doc_id long, quality int, toxic int")
    words = quality.word_vectors(repeated)
    del seen[:]
    assert quality.train(repeated, labels, words, sample=50) is not None
    assert seen and all(t.num_rows <= 50 for t in seen)
    del seen[:]
    toxicity.train(repeated, labels, positives=30, unlabelled=60)
    assert seen and all(t.num_rows <= 90 for t in seen)
    del seen[:]
    assert language.train(repeated.withColumn("lang", F.when(F.col("doc_id") == 7, "aa").otherwise("bb")), sample=20).langs == ["aa", "bb"]
    assert all(t.num_rows <= 40 for t in seen if "lang" in t.column_names)


def test_languages_are_the_most_frequent(spark, docs_of):
    prepare(spark)
    rows = [(k, f"text {k} {'abc' if k % 3 else 'xyz'}", ("en" if k % 3 else "de") if k < 60 else f"odd{k}", "s", 9) for k in range(80)]
    assert language.train(docs_of(rows), languages=2).langs == ["de", "en"]


def test_equal_rows_are_spread_over_shards(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(packing, "SHARD_DOCS", 500)
    rows = packing.pack(spark.range(0, 5000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))).collect()
    per = {}
    for r in rows:
        per[r.sequence_id >> 32] = per.get(r.sequence_id >> 32, 0) + 1
    assert len(rows) == 5000 and len(per) == 10 and max(per.values()) < 700
