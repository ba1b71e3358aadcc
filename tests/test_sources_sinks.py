import json
import os

from pyspark.sql import functions as F

from hexlens.operators import joins as J
from hexlens.session import scratch_table_path
from hexlens.sources import files as SF
from hexlens.sources import sinks as SK


def test_binary_file_source_and_predicates(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "good_one.EXE").write_bytes(b"MZ" + b"\x00" * 100)
    (tmp_path / "a" / "x.dll").write_bytes(b"hello")
    (tmp_path / "big.bin").write_bytes(b"\x00" * 5000)
    flat = SF.read_files(spark, str(tmp_path))
    assert flat.count() == 1
    deep = SF.read_files(spark, str(tmp_path), recursive=True, max_size=1000)
    assert deep.count() == 2
    exts = SF.ext_filter(deep, [".exe"]).select(SF.base_name("path").alias("n")).collect()
    assert [r.n for r in exts] == ["good_one.EXE"]
    lab = deep.select(SF.base_name("path").alias("n"), SF.infer_label("path").alias("l")).collect()
    assert {r.n: r.l for r in lab} == {"good_one.EXE": 0, "x.dll": 1}
    df = spark.createDataFrame([("/r/a/b",), ("/r",), ("/rx/a",), ("",), ("/r/a\u0000",)], "p string")
    got = [r.ok for r in df.select(SF.path_guard("p", "/r").alias("ok")).collect()]
    assert got == [True, True, False, False, False]


def test_resolve_label_precedence(spark):
    df = spark.createDataFrame([("clean_virus.exe", "1"), ("trojan.exe", "0"), ("x.exe", "benign"),
                                ("y.exe", None)], "n string, s string")
    got = [r.l for r in df.select(SF.resolve_label("n", "s").alias("l")).collect()]
    assert got == [0, 1, 0, 1]


def test_cache_append_and_merge(spark):
    path = scratch_table_path(spark, f"cache_test_{os.getpid()}")
    v1 = spark.createDataFrame([("a", True), ("b", False), ("a", True)], "sha256 string, is_malware boolean")
    assert SK.append_cache(spark, v1, path) == 2
    v2 = spark.createDataFrame([("b", True), ("c", False)], "sha256 string, is_malware boolean")
    assert SK.append_cache(spark, v2, path) == 1
    assert spark.read.parquet(path).count() == 3
    older = spark.createDataFrame([(1, "benign"), (2, "malicious")], "k int, v string")
    newer = spark.createDataFrame([(2, "benign"), (3, "benign")], "k int, v string")
    assert {r.k: r.v for r in J.merge_maps(older, newer, "k", "v").collect()} == {1: "benign", 2: "benign", 3: "benign"}


def test_results_and_metadata(spark, tmp_path):
    res = spark.createDataFrame([("/x/a", "a", 10, True, 0.99), ("/x/b", "b", 5, False, 0.7)],
                                "file_path string, file_name string, file_size long, is_malware boolean, confidence double")
    SK.write_results(res, str(tmp_path / "out"))
    SK.write_malicious_paths(res, str(tmp_path / "mal"))
    assert [r.value for r in spark.read.text(str(tmp_path / "mal")).collect()] == ["/x/a"]
    assert spark.read.option("header", "true").csv(str(tmp_path / "out" / "csv")).count() == 2
    meta = tmp_path / "metadata.json"
    meta.write_text(json.dumps({"f1": "benign", "f2": "malicious"}))
    m = SF.read_metadata_json(spark, str(meta)).collect()
    assert {r.filename: r.label for r in m} == {"f1": "benign", "f2": "malicious"}
    wide = SK.features_as_columns(spark.createDataFrame([("f", [1.0, 2.0, 3.0])], "filename string, features array<double>"))
    assert SK.feature_columns(wide) == ["feature_0", "feature_1", "feature_2"]
    assert wide.select(F.col("feature_2")).first()[0] == 3.0
