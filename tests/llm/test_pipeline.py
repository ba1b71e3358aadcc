import duckdb
import pytest

import corpus_pipeline
from hexlens.llm import queries
from hexlens.llm.common import prepare

from .test_jaccard import brute as brute_classes
from .test_packing_tokens import check_packed
from .test_search_urls_leaks import brute_whole_leaks
from .test_substring import brute as brute_repeats

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    r = c.execute(queries.SQL[name])
    names = [d[0] for d in r.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(x) for x in df.select(*names).collect()) == sorted(r.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_has_rows_and_twice_the_same(spark, name):
    a, b = (sorted(map(str, queries.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a == b and (a or name.startswith("op10"))


def test_registered(spark):
    import __spark_entry__ as entry
    names = list(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def test_stages_by_brute_force(spark, prose):
    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality_filter"](spark, docs, SF)
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = kept.collect()
    before = docs.collect()
    assert kept.columns == columns and {*map(tuple, rows)} <= {*map(tuple, before)}
    good = [r.doc_id for r in before if y.get(r.doc_id) == 1]
    assert len({r.doc_id for r in rows} & set(good)) >= 0.95 * len(good)

    near = stage["near_duplicates"](spark, kept, SF).collect()
    pairs = [(r.doc_id, r.text) for r in rows]
    want = {i for (i, _), (c, _) in zip(pairs, brute_classes(pairs)) if c == i}
    assert {r.doc_id for r in near} == want and len(near) == len(want)

    clean = stage["repeated_passages"](spark, spark.createDataFrame(near, docs.schema), SF)
    assert clean.columns == columns
    clean = clean.collect()
    want = {}
    for r, (n, words) in zip(near, brute_repeats([r.text for r in near])):
        if n == len(words):
            want[r.doc_id] = (r.text, r.n_chars)
        elif words:
            t = b" ".join(words).decode()
            want[r.doc_id] = (t, len(t))
    assert {r.doc_id: (r.text, r.n_chars) for r in clean} == want

    free = stage["decontamination"](spark, spark.createDataFrame(clean, docs.schema), SF)
    assert free.columns == columns
    free = free.collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_whole_leaks([(r.doc_id, r.text) for r in clean], items)}
    assert {r.doc_id for r in free} == {r.doc_id for r in clean} - bad

    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = stage["pack"](spark, spark.createDataFrame(free, docs.schema), SF).collect()
    check_packed(packed, {r.doc_id: r.text for r in free}, t)

    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, packed))


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
