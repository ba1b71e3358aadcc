"""Spark session helpers.

Cluster deployments bring their own session; these helpers only fill in
settings that are unset, so the cluster's configuration always wins.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings the engine relies on; applied only when the session has none.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # whole files cross to Python in Arrow batches, which Spark bounds by rows only: set it lower for files of many MB
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "hexlens") -> SparkSession:
    """Create (or reuse) a session for local runs and tests."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.driver.memory", os.environ.get("HEXLENS_DRIVER_MEMORY", "16g"))
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment to shared storage and is used
    as is. Only a local master, whose executors are this process, may do without:
    a fresh scratch folder is then created and registered.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="hexlens-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint dir for a materialised table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but computes the plan exactly once
    (a reliable RDD checkpoint recomputes an uncached plan), stores columnar
    data, and later reads get column pruning.  Survives executor loss: the
    table lives in shared storage.
    """
    return materialize_at(df, name)[0]


def materialize_at(df, name: str):
    """``materialize``, with the path, for ``discard``."""
    import uuid
    spark = df.sparkSession
    path = scratch_table_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    _MATERIALIZED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete one table that ``materialize_at`` wrote, and that no later plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    own = _MATERIALIZED.get(spark.sparkContext.applicationId, [])
    if path in own:
        own.remove(path)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Shuffle files go with the job that wrote them, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


_MATERIALIZED: dict[str, list[str]] = {}
_ONCE: dict[tuple, object] = {}
#: Keys that ``materialize_once`` found written already, in the order asked for.
REUSED: list[tuple] = []


def materialize_once(spark: SparkSession, key: tuple, build, name: str):
    """``materialize(build())``, written the first time that this application asks for ``key``."""
    k = (spark.sparkContext.applicationId, *key)
    if k in _ONCE:
        REUSED.append(k)
    else:
        _ONCE[k] = materialize(build(), name)
    return _ONCE[k]


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists in whatever store the path names (errors of the store are raised)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def release_materialized(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` wrote for this application; returns how many.

    Call it when no DataFrame built on them is used any more.
    """
    app = spark.sparkContext.applicationId
    for k in [k for k in _ONCE if k[0] == app]:
        del _ONCE[k]
    paths = _MATERIALIZED.pop(app, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``hexlens`` importable in executor Python workers (UDFs reference it).

    Equivalent of ``spark-submit --py-files``: the package is zipped once per
    application on the driver and added with ``addPyFile``; Spark distributes
    it to every executor.  No-op when already shipped for this application.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    staging = tempfile.mkdtemp(prefix="hexlens-pyfiles-")  # code only; addPyFile copies it to the executors
    atexit.register(shutil.rmtree, staging, ignore_errors=True)
    zpath = os.path.join(staging, "hexlens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
