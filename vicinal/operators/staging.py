"""Intermediate results that many parts of a job read, written once."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that this process has made, for ``cleared``.
_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it is unset, a local master (tests) gets a temporary one;
    on a cluster that is an error, since executors don't see the driver's disk."""
    context = spark.sparkContext
    if (root := spark.conf.get("spark.checkpoint.dir", None)) is None:
        root = context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        root = context.getCheckpointDir()
    return root


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name for a new folder in the shared one."""
    _made.append(os.path.join(shared_root(spark), f"{kind}-{uuid.uuid4().hex}"))
    return _made[-1]


def cleared(spark: SparkSession) -> None:
    """Deletes all that was staged so far. For the end of a job: results that have not been written yet are lost."""
    jvm = spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again. Its plan ends there, and a lost executor loses nothing of it."""
    path = new_folder(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a batch and of a file of ``replayed``, at most and about.
ROWS_A_BATCH, ROWS_A_FILE = 8_000_000, 500_000


def replayed(df: DataFrame, order: str, batches: int = 4) -> DataFrame:
    """``df`` as a stream that brings one span of the time ``order`` at a time: equal spans, the first one first.

    ``df`` is computed once. Large tables have more spans, so that a batch and its state stay bounded, and each span has
    several files, which are written and read side by side.
    """
    spark, rows = df.sparkSession, staged(df)
    at = F.col(order).cast("double")
    low, high, n = rows.agg(F.min(at), F.max(at), F.count("*")).first()
    batches = max(batches, -(-n // ROWS_A_BATCH))
    span = ((high or 0) - (low or 0)) / batches or 1.0
    part = F.coalesce(F.least(F.floor((at - (low or 0)) / span), F.lit(batches - 1)), F.lit(0))

    def written(width: int) -> str:
        path = new_folder(spark, "replayed")
        for k in range(batches):
            some = rows.where(part == k)
            (some.coalesce(1) if width == 1 else some.repartition(width)).write.mode("append").parquet(path)
        return path

    width = max(1, -(-n // (batches * ROWS_A_FILE)))
    path = written(width)
    if len(spark.read.schema(df.schema).parquet(path).inputFiles()) != batches * width:
        # A span with too few rows for its files would let the next one's into its batch.
        path, width = written(1), 1
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", width).parquet(path)


#: State on executors' disks, with each batch's changes alone in the checkpoint.
_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; a stream keeps what it began with."""
    before = {name: spark.conf.get(name, None) for name in _ON_DISK}
    for name, value in _ON_DISK.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def drained(stream: DataFrame, keys: list[str]) -> DataFrame:
    """What an aggregating stream says of each key in the end. Each batch writes the rows that it has changed, under its
    number, so a batch that is run again replaces itself."""
    spark = stream.sparkSession
    out = new_folder(spark, "drained")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    query = stream.writeStream.outputMode("update").foreachBatch(write)
    query.option("checkpointLocation", new_folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*").select(stream.columns)
