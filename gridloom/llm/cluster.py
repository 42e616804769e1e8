"""Lineage cuts in the folder that the cluster shares, and bucket counts that follow the input."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Unset, a temporary folder serves, but in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="gridloom-checkpoint-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def cut(df: DataFrame, *, tidy: bool = True) -> DataFrame:
    """df, computed once and written to the shared folder, so that a lost executor costs no recomputation and a second use no second run.

    Spark removes the files when the frame is collected as garbage (``spark.cleaner.referenceTracking.cleanCheckpoints``).  With tidy, garbage is
    collected before the work begins: until then the shuffle files of the step before would stay."""
    spark = df.sparkSession
    shared_dir(spark)
    if tidy:
        collect_garbage(spark)
    return df.checkpoint(eager=True)


def collect_garbage(spark: SparkSession) -> None:
    """Spark deletes shuffle files when the driver collects the frames that made them."""
    for _ in range(2):  # the plan's handles go in the first round, what they held in the second
        gc.collect()
        drop_handles(spark)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    release_memory()


def drop_handles(spark: SparkSession) -> None:
    """Tells the JVM now of the handles that Python no longer has: py4j leaves that to a thread that looks once a second, too late for the collection that follows."""
    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    while waiting:
        try:
            gone = waiting.pop()
        except IndexError:  # that thread took the last one
            return
        if isinstance(gone, str):  # its sign to end
            waiting.appendleft(gone)
            return
        client, handle = gone
        client.garbage_collect_object(handle, False)


def release_memory() -> None:
    """Gives what this process has freed back to the system: Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """df written once as Parquet in the shared folder, for the time of the block: texts take less room so than in a checkpoint."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}"
    collect_garbage(spark)
    df.write.option("compression", "zstd").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows up to which a frame of a few numbers a row is broadcast (some 10 MB); larger ones are joined by shuffle.
BESIDE = 200_000


def beside(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast join if its rows, counted here, are few enough."""
    return F.broadcast(df) if df.count() <= BESIDE else df


def buckets_for(df: DataFrame, per_partition: int = 2) -> int:
    """Hash buckets for an exchange of what df's rows yield: in proportion to the input's partitions, so that a bucket's size doesn't grow."""
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(per_partition * df.rdd.getNumPartitions(), shuffle)
