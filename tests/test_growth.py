"""Work and tasks that must grow no faster than the input."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from hexlens import config as C
from hexlens.functions.pe import with_pe_headers
from hexlens.operators import trees
from hexlens.operators.boosting import BoostedModel, boost
from hexlens.operators.featurise import hash_slots, hash_vector_raw, hash_vector_scaled
from hexlens.operators.pe_features import add_import_features
from hexlens.plans import pe_corpus, scan, training
from hexlens.sources.files import le_uint
from hexlens.streaming.scan_stream import run_scan_stream


def test_the_corpus_is_made_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pe_corpus, "TASK_FILES", 4)
    spark.range(200).select((F.col("id") + 1).alias("p_partkey"), F.lit("name").alias("p_name")).write.parquet(f"{tmp_path}/{uuid.uuid4().hex}/part.parquet")
    at = next(tmp_path.iterdir())
    files = pe_corpus.pe_files(spark, str(at))
    assert files.count() == 200
    assert len(files.inputFiles()) > 2 * spark.sparkContext.defaultParallelism


def test_hashes_are_made_once_a_row(spark):
    df = spark.createDataFrame([(["a.dll", "b.dll"], ["f", None], [".text"]), ([], [], [])], "d array<string>, a array<string>, s array<string>")
    slots = df.withColumn("slots", hash_slots(F.col("d"), F.col("a"), F.col("s")))
    v = slots.select(hash_vector_raw(F.col("slots")).alias("v"), "slots")
    assert "array_contains(lambda" in df.withColumn("_x", hash_slots(F.col("d"), F.col("a"), F.col("s"))).select(
        hash_vector_raw(F.col("_x")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    for r in v.collect():
        assert [k for k, x in enumerate(r.v) if x] == sorted(r.slots)


def test_cards_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "CARDS", 4)
    spark.range(80).select(F.col("id").alias("s_suppkey"), F.lit("x").alias("s_name"), F.lit(1).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    root = scan.write_cards(spark, str(tmp_path), scan._CARD, "cards")
    tasks = [p.split("/part-")[1][:5] for p in spark.read.option("recursiveFileLookup", "true").text(root).inputFiles()]
    assert len(tasks) == 80 and len(set(tasks)) > 8


def test_the_state_of_a_stream_has_no_more_parts_than_can_run_at_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "77")
    try:
        run_scan_stream(spark, str(tmp_path / "in"), str(tmp_path / "v"), str(tmp_path / "c"), {0: F.lit(0.5), 1: F.lit(0.5)}, require_pe=False)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "77"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    meta = next(p for p in (tmp_path / "c" / "offsets").iterdir() if p.name.isdigit()).read_text()
    assert f'"spark.sql.shuffle.partitions":"{min(77, spark.sparkContext.defaultParallelism)}"' in meta


def test_few_rows_of_a_node_are_sent_as_they_are():
    rng, starts = np.random.default_rng(1), np.arange(0, 5 * 200 + 1, 200)
    parts = [(rng.integers(0, 200, (n, 5)).astype(np.uint8), rng.random(n), rng.random(n)) for n in (3, 4, 2000)]
    pieces = []
    for p in parts:
        held = trees.Held(starts)
        held.add(*p)
        pieces.append(held.packed())
    assert [n for n, _ in pieces] == [3, 4, 0] and len(pieces[0][1]) < 100 < len(pieces[2][1])
    assert np.allclose(trees.Held.met(pieces, starts), trees.sums_of(*(np.concatenate(x) for x in zip(*parts)), starts))


def test_an_expert_scores_written_features(spark, monkeypatch):
    parser = F.udf(lambda c: [float(len(c))], "array<float>")
    monkeypatch.setattr(training, "featurise", lambda f, key, native: f.select(key, parser("content").alias("features")))
    files = spark.createDataFrame([("a", b"x"), ("b", b"xyz")], "path string, content binary")
    model = BoostedModel(0.0, ((1.0, {"feature": [0, -1, -1], "threshold": [2.0, 0.0, 0.0], "left": [1, -1, -1], "right": [2, -1, -1], "value": [0.0, -50.0, 50.0]}),), "vec")
    own = training.expert_scores(files, model)
    assert "content" not in own._jdf.queryExecution().optimizedPlan().toString()
    assert {r.file_path: round(r.own) for r in own.collect()} == {"a": 0, "b": 1}


def test_a_boosted_model_bins_its_rows_once_and_grows_spark_trees(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, w = rng.integers(0, 9, (400, 4)).astype(float), rng.integers(1, 4, 400).astype(float)
    y = (x[:, 0] + x[:, 1] * 0.7 + rng.random(400) * 3 > 8).astype(float)
    df = spark.createDataFrame([(x[i].tolist(), float(y[i]), float(w[i])) for i in range(400)], "x array<double>, label double, w double").withColumn("vec", array_to_vector("x"))
    made, was = [], trees.fit_bins
    monkeypatch.setattr(trees, "fit_bins", lambda *a: made.append(1) or was(*a))
    model = boost(df, weight="w", rounds=3, step=1.0, depth=3)
    assert len(made) == 1 and len(model.stages) == 3
    g = df.withColumn("g", F.col("label") - 1 / (1 + F.exp(-F.lit(model.init_margin))))
    tree = DecisionTreeRegressor(featuresCol="vec", labelCol="g", weightCol="w", maxDepth=3).fit(g)
    want = [r.prediction for r in tree.transform(g).collect()]
    got = [r.margin - model.init_margin for r in BoostedModel(model.init_margin, model.stages[:1], "vec").margin(df).collect()]
    assert np.allclose(want, got)


def test_a_boosted_model_of_one_class_has_a_stage_a_round(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1.0)] * 30, "x array<double>, label double").withColumn("vec", array_to_vector("x"))
    model = boost(df, rounds=2, depth=2)
    assert [t["feature"] for _, t in model.stages] == [[-1], [-1]] and model.stages[0][1]["value"][0] > 0


def test_samples_are_as_many_files_for_each_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "SAMPLES", 20)
    df = spark.range(0, 1000, 1, 4).select(F.lit("clean_1").alias("filename"), (F.col("id") % 4).alias("part"))
    assert training.write_samples(df, f"{tmp_path}/s") == 12
    files = spark.read.parquet(f"{tmp_path}/s").inputFiles()
    assert len(files) == 48 and spark.read.parquet(f"{tmp_path}/s").count() == 1000


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_integer_of_the_file_is_not_cut_byte_by_byte(spark):
    rows = [bytes(range(200, 212)), b"\xff" * 9, b"\x00\x01\x02\x80", b""]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, c binary")
    got = df.select("k", *[le_uint("c", at, width).alias(f"v{at}_{width}") for at in (0, 3, 1 << 33) for width in (1, 2, 4, 7)])
    assert _plan(df.select(le_uint("c", 3, 4).alias("v"))).count("hex(") <= 2  # a common part; it was cut out of five
    for r in got.collect():
        for at in (0, 3, 1 << 33):
            for width in (1, 2, 4, 7):
                own = rows[r.k][at:at + width]
                assert r[f"v{at}_{width}"] == (int.from_bytes(own, "little") if len(own) == width else None)


def test_directories_are_compiled(spark):
    df = with_pe_headers(spark.createDataFrame([(b"MZ",)], "content binary"))
    dirs = next(line for line in _plan(df).split("\n") if "AS _dirs#" in line)
    own = dirs[:dirs.index("AS _dirs#")].rsplit(" AS ", 1)[0]
    assert "rva" in own and "lambda" not in own  # a lambda is interpreted


def test_texts_of_imports_are_made_once(spark):
    df = spark.createDataFrame([([(0, "ws2_32.dll", "Connect", None), (0, "ws2_32.dll", None, 7)],), ([],)],
                               "i array<struct<entry_pos: int, dll: string, api: string, ordinal: bigint>>")
    out = add_import_features(df, "i")
    assert _plan(out).count("concat_ws(") == 1
    assert [r.api_network_ratio for r in out.collect()] == [1 / 3, None] and "connect" in C.keyword_lists(False)["api"]["network"]


def test_scaled_hash_slots_equal_the_normalised_ones(spark):
    df = spark.createDataFrame([([3, 7, 255],), ([],), ([0],)], "s array<int>")
    for r in df.select("s", hash_vector_scaled(F.col("s")).alias("v"), hash_vector_raw(F.col("s")).alias("raw")).collect():
        norm = sum(x * x for x in r.raw) ** 0.5
        assert r.v == [x / norm * C.HASH_SLOT_SCALE if norm else 0.0 for x in r.raw]
