"""Lookup without moving contents, and the stream's keyed state."""
import os
import random
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlens.operators import keyfilter as K
from hexlens.operators import scan as S
from hexlens.session import scratch_table_path
from hexlens.sources import sinks as SK
from hexlens.sources.files import read_paths
from hexlens.streaming import scan_stream as ST

FAMILY = "struct<cluster_id:int,family_name:string,is_new_family:boolean>"


def sha_rows(spark, n, share):
    return spark.range(n).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("sha256"), (F.col("id") % 100 < share * 100).alias("miss"))


@pytest.mark.parametrize("share,part_bytes", [(0.3, K.PART_BYTES), (0.8, K.PART_BYTES), (0.5, 6000)])
def test_members_are_exact(spark, share, part_bytes):
    keys = sha_rows(spark, 20_000, share).cache()
    parts = K.members(keys, "sha256", "miss", part_bytes)
    assert (len(parts) > 1) == (part_bytes < K.PART_BYTES)
    told = keys.select("miss", sum(p(F.col("sha256")).cast("int") for p in parts).alias("n"))
    assert {(r.miss, r.n): r["count"] for r in told.groupBy("miss", "n").count().collect()} == {(True, 1): int(20_000 * share), (False, 0): 20_000 - int(20_000 * share)}
    keys.unpersist()


def test_members_of_one_kind_or_none(spark):
    assert K.members(sha_rows(spark, 0, 0.5), "sha256", "miss") == []
    assert K.members(sha_rows(spark, 50, 0.0), "sha256", "miss") == []
    only, = K.members(sha_rows(spark, 50, 1.0), "sha256", "miss")
    assert sha_rows(spark, 50, 1.0).where(only(F.col("sha256"))).count() == 50


def test_the_filter_passes_few_other_keys(spark):
    keys = sha_rows(spark, 40_000, 0.5)
    bits = K.build(keys.where("miss"), "sha256", 20_000)
    rows = keys.select("miss", *[h.alias(n) for n, h in zip(("a", "b"), K.hashes(F.col("sha256")))]).toPandas()
    yes = K.passes(bits, rows["a"].to_numpy(), rows["b"].to_numpy())
    assert yes[rows["miss"]].all() and yes[~rows["miss"]].mean() < 0.03


def test_a_scan_with_a_cache_moves_no_content(spark, monkeypatch):
    plans = []
    write = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), write(df, name))[1])
    files = spark.range(400).select(F.format_string("/in/%d.bin", "id").alias("path"), F.lit(100).cast("long").alias("length"),
                                    F.encode(F.repeat((F.col("id") % 150).cast("string"), 50), "UTF-8").alias("content")).repartition(3)
    cache = (files.select(F.sha2("content", 256).alias("sha256")).distinct().orderBy("sha256").limit(70)
             .select("sha256", F.lit(0.995).alias("score"), F.lit(None).cast(FAMILY).alias("malware_family")))
    cache = write(cache, "some-cache")
    files = write(files, "some-files")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = S.scan_corpus(files, {0: F.lit(0.1), 1: F.lit(0.1)}, cache=cache, require_pe=False)
        known = {r.sha256 for r in cache.collect()}
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 400 and all(r.cache_hit == (r.sha256 in known) and r.is_malware == r.cache_hit for r in rows)
    assert any(n == "scan-features" for n, _ in plans)
    for name, plan in plans:
        for line in plan.splitlines():
            if re.search(r"Exchange|Join", line):
                assert "content" not in line, (name, line)
        if name == "scan-features":
            assert "Exchange" not in plan and "Join" not in plan


def test_cached_verdicts_are_kept_by_prefix(spark, tmp_path):
    at = str(tmp_path / "cache")
    rows = sha_rows(spark, 600, 1.0).withColumn("score", F.lit(0.5))
    assert SK.append_cache(spark, rows.limit(400), at) == 400
    assert SK.append_cache(spark, rows, at) == 200 and SK.append_cache(spark, rows, at) == 0
    assert SK.read_cache(spark, at).count() == 600 and sorted(SK.read_cache(spark, at).columns) == ["miss", "score", "sha256"]
    few = rows.orderBy("sha256").limit(2)
    got = SK.read_cache(spark, at, few)
    assert 2 <= got.count() < 30 and few.join(got, "sha256").count() == 2
    assert "PartitionFilters: [prefix" in got._jdf.queryExecution().executedPlan().toString().replace("isnotnull", "prefix")


def test_paths_with_glob_characters(spark, tmp_path):
    names = ["a*b.bin", "a[1].bin", "{x,y}.bin", "plain.bin", "sp ace.bin", "axb.bin", "a1.bin"]
    for k, n in enumerate(names):
        (tmp_path / n).write_bytes(bytes([k]))
    every = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").load(str(tmp_path)).collect()}
    some = sorted(every)[:5]
    assert {r.path: bytes(r.content) for r in read_paths(spark, some).collect()} == {p: every[p] for p in some}


def run(spark, root, at, n=3):
    ST.run_scan_stream(spark, str(root), f"{at}/v", f"{at}/c", {0: F.lit(0.99), 1: F.lit(0.5)}, max_files_per_trigger=n, require_pe=False)
    return {r.sha256: (r.file_path, r.epoch) for r in ST.verdicts(spark, f"{at}/v").collect()}


def test_state_outlives_restarts_and_a_replayed_batch_changes_nothing(spark, tmp_path):
    r = random.Random(1)
    root, at = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    for k in range(8):
        (root / f"a{k}.bin").write_bytes(b"x" * (1 + k % 4))
    first = run(spark, root, at)
    assert len(first) == 4
    for k in range(4):  # copies, and two new contents
        (root / f"b{k}.bin").write_bytes(b"x" * (1 + k) if k < 2 else b"y" * k)
    second = run(spark, root, at)
    assert len(second) == 6 and second.items() >= first.items()
    commits = f"{at}/c/commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    os.remove(f"{commits}/{last}")  # as if the driver had died before the batch was committed
    if os.path.exists(f"{commits}/.{last}.crc"):
        os.remove(f"{commits}/.{last}.crc")
    assert run(spark, root, at) == second
    shutil.rmtree(f"{at}/v")  # the state, not the table, knows what has been seen
    (root / "c.bin").write_bytes(b"xx")
    (root / "d.bin").write_bytes(b"new")
    only, = run(spark, root, at).values()
    assert only[0].endswith("d.bin")
    assert spark.conf.get(ST.STORE, None) != ST.ROCKSDB


def test_the_first_path_of_a_content_is_its_smallest(spark, tmp_path):
    root, at = tmp_path / "in", scratch_table_path(spark, f"smallest-{os.getpid()}")
    root.mkdir()
    for k in range(6):
        (root / f"{5 - k}.bin").write_bytes(b"same")
    (path, _), = run(spark, root, at, n=10).values()
    assert path.endswith("/0.bin")
    assert np.isscalar(len(path))


def test_batches_list_their_own_files_and_commit_only_changes(spark, tmp_path):
    """40 files a trigger, above Spark's bound of 32 for a listing job: the batches start none, and the state's parts write change logs."""
    root, at = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    for k in range(90):
        (root / f"a{k:02}.bin").write_bytes(b"x" * (1 + k % 3))
    names = (ST.LISTED, ST.COMPACTED, ST.STORE, ST.PARTITIONS, ST.CHANGES)
    before, seen = {k: spark.conf.get(k, None) for k in names}, []

    def scan(files, *args, **kw):
        seen.append(files)
        assert int(spark.conf.get(ST.LISTED)) >= 40
        return files.select("path").withColumns({"sha256": F.lit("s"), "file_path": F.col("path")})
    was, ST.scan_corpus = ST.scan_corpus, scan
    try:
        ST.run_scan_stream(spark, str(root), f"{at}/v", f"{at}/c", {}, max_files_per_trigger=40)
    finally:
        ST.scan_corpus = was
    assert seen and {k: spark.conf.get(k, None) for k in names} == before
    logs = list((tmp_path / "out" / "c" / "state").rglob("*.changelog"))
    assert logs and not [p for p in (tmp_path / "out" / "c" / "sources").rglob("*.compact")]


def test_cards_are_written_without_files_of_checksums(spark, tmp_path):
    import os

    from hexlens.plans import scan as S
    spark.range(20).selectExpr("id as s_suppkey", "cast(id % 3 as int) as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    root = S.write_cards(spark, str(tmp_path), S._SHARED, "cards-test").removeprefix("file:")
    names = [n for _, _, files in os.walk(root) for n in files]
    assert len([n for n in names if n.endswith(".txt")]) == 20 and not [n for n in names if n.endswith(".txt.crc")]
    got = spark.read.text(root)
    assert {(r.s_suppkey, r.value) for r in got.collect()} == {(k, f"nation {k % 3}") for k in range(20)}
