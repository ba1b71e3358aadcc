"""Score newly arrived files once per content (T1-T3) with Structured Streaming.

``binaryFile`` stream (explicit schema, at most N files per trigger) -> content
hash -> keyed state -> ``foreachBatch``: the batch scan of the contents that the
state had not seen.  The state (sha256 -> first path and number of copies) lies
in RocksDB beside the checkpoint: a batch looks up its own keys and reads no
table, so its plan and its time don't depend on how much has been scanned.  It
survives a restart, and a batch that is replayed starts from the state before it
and replaces the partition of its epoch.

Only keys pass the state's shuffle.  The new contents are then read by their
paths, of which a batch has as many as the trigger allows.  Nothing is dropped
by file time: a file with an old time is scanned like any other.  A file that
is changed between the two reads is scanned as it is then.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hexlens import config as C
from hexlens.operators.scan import scan_corpus
from hexlens.session import table_exists
from hexlens.sources.files import read_paths, stream_files

STORE = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
#: A batch commits the changes of the state, and not a synchronised copy of its files in each part.
CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
#: Paths that the driver lists itself; for more it starts a job.
LISTED = "spark.sql.sources.parallelPartitionDiscovery.threshold"
#: Batches after which the source writes the names of all files anew.
COMPACTED = "spark.sql.streaming.fileSource.log.compactInterval"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEEN = "path string, copies long"


def first_of_content(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A row for a content that the state doesn't know: its smallest path in this batch."""
    paths = pd.concat(b["path"] for b in batches)
    path, copies = state.get if state.exists else (None, 0)
    state.update((path or paths.min(), copies + len(paths)))
    if path is None:
        yield pd.DataFrame({"sha256": [key[0]], "path": [paths.min()]})


def new_contents(files: DataFrame) -> DataFrame:
    """sha256 and path of every content that the stream sees for the first time."""
    keys = files.select(F.sha2("content", 256).alias("sha256"), "path")
    return keys.groupBy("sha256").applyInPandasWithState(first_of_content, "sha256 string, path string", SEEN, "append", GroupStateTimeout.NoTimeout)


def verdicts(spark: SparkSession, table_dir: str, before: int | None = None) -> DataFrame | None:
    """The verdict table (of epochs before one); None while there is none."""
    if not table_exists(spark, table_dir):
        return None
    t = spark.read.parquet(table_dir)
    return t if before is None else t.where(F.col("epoch") != before)


@contextmanager
def settings(spark: SparkSession, own: dict[str, str]) -> Iterator[None]:
    """The session with these settings, and then with those before."""
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def run_scan_stream(spark: SparkSession, root: str, table_dir: str, checkpoint_dir: str, experts: dict,
                    max_files_per_trigger: int = C.SERVICE_MAX_BATCH_SIZE, glob: str | None = None, **scan) -> None:
    """Process every file present under ``root`` (availableNow) and stop; ``scan``: further options of the scan."""
    files = stream_files(spark, root, max_files_per_trigger, glob)

    def batch(df: DataFrame, epoch: int) -> None:
        paths = [r.path for r in df.select("path").collect()]  # the state is asked once; max_files_per_trigger at most
        if paths:
            out = scan_corpus(read_paths(df.sparkSession, paths).select("path", "length", "content"), experts, **scan)
            out.write.mode("overwrite").parquet(f"{table_dir}/epoch={epoch}")

    # each partition of the state costs a batch a task and a commit, whatever it holds: not more than can run at once
    most = min(int(spark.conf.get(PARTITIONS)), spark.sparkContext.defaultParallelism)
    own = {STORE: ROCKSDB, PARTITIONS: str(most), CHANGES: "true"}  # the query has its own copy of them once it is started
    source = {COMPACTED: "100", LISTED: str(max(int(spark.conf.get(LISTED)), max_files_per_trigger))}  # read by the source as it runs
    with settings(spark, source):
        with settings(spark, own):
            q = (new_contents(files).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint_dir)
                 .trigger(availableNow=True).start())
        q.awaitTermination()
