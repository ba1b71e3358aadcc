"""Scan path, stream, model store and restarts."""
import os

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hexlens.operators import families as FM
from hexlens.operators import training as TR
from hexlens.operators.boosting import BoostedModel, boost, fp_reinforcement
from hexlens.operators.discovery import discover_families
from hexlens.operators.ranking import group_quantile
from hexlens.operators.scan import scan_corpus, scan_summary
from hexlens.session import release_materialized, scratch_table_path, table_exists
from hexlens.sources import sinks as SK
from hexlens.sources.models import load_experts, save_experts
from hexlens.streaming.incremental import saved_epochs
from hexlens.streaming.scan_stream import run_scan_stream, verdicts

FAMILY = "struct<cluster_id:int,family_name:string,is_new_family:boolean>"


@pytest.fixture
def scored(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(300)], "id long, v array<double>, label double")
    return df.withColumn("vec", array_to_vector("v"))


def test_stream_takes_files_with_old_times_and_scores_each_content_once(spark, tmp_path):
    root, at = tmp_path / "in", scratch_table_path(spark, f"stream-test-{os.getpid()}")
    root.mkdir()
    for i in range(6):
        (root / f"a{i}.bin").write_bytes(b"x" * (1 + i % 3))
    run = lambda: run_scan_stream(spark, str(root), f"{at}/v", f"{at}/c", {0: F.lit(0.99), 1: F.lit(0.5)}, max_files_per_trigger=2, require_pe=False)
    run()
    first = {r.sha256: r.file_path for r in verdicts(spark, f"{at}/v").collect()}
    assert len(first) == 3
    late = root / "late.bin"
    late.write_bytes(b"unseen")
    os.utime(late, (1_000_000, 1_000_000))  # years before every other file
    (root / "copy.bin").write_bytes(b"xx")
    run()
    rows = verdicts(spark, f"{at}/v").collect()
    assert len(rows) == 4 and sum(r.file_path.endswith("late.bin") for r in rows) == 1
    assert {r.sha256: r.file_path for r in rows}.items() >= first.items()


def test_cache_hits_skip_the_features_and_keep_the_path(spark):
    from test_pe import make_pe
    pe = [make_pe([(".text", bytes([i]) * 512, 512, 0x60000020)]) for i in range(3)]
    files = spark.createDataFrame([(f"/in/{i}.exe", len(p), p) for i, p in enumerate(pe)] + [("/in/t.txt", 2, b"hi"), ("/out/x.exe", len(pe[0]), pe[0]), ("/in/copy.exe", len(pe[1]), pe[1])],
                                  "path string, length long, content binary")
    sha = files.where("path = '/in/1.exe'").select(F.sha2("content", 256)).first()[0]
    cache = spark.createDataFrame([(sha, 0.995, (4, "fam", False))], f"sha256 string, score double, malware_family {FAMILY}")
    got = {r.file_path: r for r in scan_corpus(files, {0: F.lit(0.1), 1: F.lit(0.1)}, cache=cache, allowed_root="/in").collect()}
    assert set(got) == {"/in/0.exe", "/in/1.exe", "/in/2.exe", "/in/copy.exe"}
    for p in ("/in/1.exe", "/in/copy.exe"):
        assert got[p].cache_hit and got[p].is_malware and got[p].confidence == 0.995 and got[p].virus_family == "fam"
    assert not got["/in/0.exe"].is_malware and got["/in/0.exe"].confidence == pytest.approx(0.9) and got["/in/0.exe"].malware_family is None
    s = scan_summary(scan_corpus(files, {0: F.lit(0.1)}, cache=cache, allowed_root="/in")).first()
    assert (s.files, s.malware, s.new_families) == (4, 2, 0)


def test_boosted_model_scores_like_its_trees_and_survives_a_restart(spark, scored):
    m = boost(scored, rounds=5, depth=3, warmup=4)
    assert [round(s, 6) for s, _ in m.stages] == [0.001, 0.02575, 0.0505, 0.07525, 0.1]
    at = scratch_table_path(spark, f"boosted-test-{os.getpid()}")
    assert BoostedModel.load(spark, at) is None
    m.save(spark, at)
    again = BoostedModel.load(spark, at)
    assert again == m
    got = [r.score for r in again.predict(scored).orderBy("id").collect()]

    def walk(t, x):
        i = 0
        while t["feature"][i] >= 0:
            i = t["left"][i] if x[t["feature"][i]] <= t["threshold"][i] else t["right"][i]
        return t["value"][i]
    for r, s in zip(scored.orderBy("id").collect(), got):
        margin = m.init_margin + sum(step * walk(t, r.v) for step, t in m.stages)
        assert s == pytest.approx(1 / (1 + np.exp(-margin)))
    more = boost(scored, rounds=2, depth=2, model=again, warmup=4)
    assert len(more.stages) == 7 and len(again.stages) == 5 and [s for s, _ in more.stages[5:]] == [0.1, 0.1]
    experts = {0: m, 1: TR.train_gbt(scored, features="vec", max_iter=2, max_depth=2)}
    save_experts(spark, experts, f"{at}-experts")
    loaded = load_experts(spark, f"{at}-experts", routes=(0, 1, 2))
    assert set(loaded) == {0, 1} and loaded[0] == m
    rows = scored.withColumn("route", (F.col("id") % 2).cast("int"))
    a, b = (sorted((r.id, r.score) for r in TR.expert_predict(rows, "route", e, "vec").collect()) for e in (experts, loaded))
    assert a == b


def test_known_false_positives_are_reweighted_in_the_training_rows(spark, scored):
    start = BoostedModel(0.0, (), "vec")
    fps = spark.createDataFrame([(1,), (2,), (2,), (9999,)], "id long")
    _, h = fp_reinforcement(scored.where("id % 2 = 0"), scored.where("id % 2 = 1"), "id", start, known_fps=fps, max_iter=1, rounds=1, threshold=0.4)
    benign = scored.where("id % 2 = 1 and label = 0").count()
    assert h == [(0, benign, 1)]


def test_stores_reject_what_does_not_fit(spark, tmp_path):
    at = str(tmp_path / "model")
    m = spark.createDataFrame([(1, [1.0, 2.0], 1.0, "a"), (2, [1.0], 1.0, "b")], "cluster_id int, centroid array<double>, threshold double, family_name string")
    scaler = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0])], "mean array<double>, scale array<double>")
    SK.write_family_model(m, scaler, at)
    with pytest.raises(ValueError):
        SK.load_family_model(spark, at)
    SK.write_family_model(m.limit(1), scaler, at)
    assert SK.load_family_model(spark, at).count() == 1
    bad = tmp_path / "cache"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        SK.append_cache(spark, spark.createDataFrame([("a",)], "sha256 string"), str(bad))


def test_small_tables_are_in_every_split(spark):
    small = TR.split_60_20_20(spark.range(10), "id")
    assert {(r.split, r["count"]) for r in small.groupBy("split").count().collect()} == {("train", 10), ("val", 10), ("test", 10)}
    assert TR.split_60_20_20(spark.range(11), "id").count() == 11


def test_quantiles_of_equal_values_and_several_batches(spark):
    rows = [(0, 1.0)] * 3000 + [(0, 2.0)] * 500 + [(1, float(i % 7)) for i in range(900)] + [(None, 5.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.g: r.q for r in group_quantile(df.where("g is not null"), ["g"], "v", 0.9, "q").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in (0, 1):
        assert got[g] == pytest.approx(np.percentile([v for k, v in rows if k == g], 90))


def test_nearest_centroid_in_blocks_equals_one_block(spark, monkeypatch):
    rng = np.random.default_rng(2)
    c, x = rng.normal(size=(9, 3)), rng.normal(size=(40, 3))
    model = spark.createDataFrame([(i, c[i].tolist(), 1.0, f"f{i}") for i in range(9)], "cluster_id int, centroid array<double>, threshold double, family_name string")
    rows = spark.createDataFrame([(i % 5, x[i].tolist()) for i in range(40)], "id long, x array<double>")  # repeated ids
    one = sorted(tuple(r) for r in FM.nearest_centroid(rows, "x", model).select("id", "x", "nearest_cluster_id", "distance").collect())
    monkeypatch.setattr(FM, "BROADCAST_MODEL_BYTES", 2 * 3 * 8)
    many = sorted(tuple(r) for r in FM.nearest_centroid(rows, "x", model).select("id", "x", "nearest_cluster_id", "distance").collect())
    assert len(one) == 40 and one == many
    for _, v, k, d in one:
        assert k == int(np.argmin(np.linalg.norm(c - v, axis=1))) and d == pytest.approx(np.linalg.norm(c - v, axis=1).min())


def test_family_discovery_chain(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(30, 5)) + 12 * k for k in range(3)])
    df = spark.createDataFrame([(f"f{i}", x[i].tolist()) for i in range(90)], "filename string, v array<double>")
    out = discover_families(df, "v", k=3, pca=3, min_family_size=5)
    assert sorted(r.n for r in out["sizes"].collect()) == [30, 30, 30] and out["model"].count() == 3
    q = out["quality"].first()
    assert q.silhouette > 0.8 and q.calinski_harabasz > 100
    with pytest.raises(ValueError):
        TR.kmeans_clusters(TR.assemble(df.limit(2), "v", "z"), "z", k=3)


def test_missing_folders_and_release(spark, tmp_path):
    assert not table_exists(spark, str(tmp_path / "none")) and saved_epochs(spark, str(tmp_path / "none")) == []
    assert release_materialized(spark) > 0 and release_materialized(spark) == 0
