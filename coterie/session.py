"""Session helpers: lineage cuts, scratch paths, parallelism."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def _set_checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # Only a session in one process (a test) gets a folder of its own.
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="coterie-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back, so an
    iterative plan stays short and survives lost executors."""
    _set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{_set_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a parquet table in the shared checkpoint folder, read back.

    For results that several later steps read: they are computed once, survive
    lost executors, and the optimizer knows their true size, so a small one is
    broadcast without a hint and a large one is not.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(spark: SparkSession, *steps: Callable[[], DataFrame]) -> list[DataFrame]:
    """What the steps return.  None needs another one, so their jobs share the executors:
    one that waits for the driver or for its last task leaves cores to the others."""
    _set_checkpoint_dir(spark)
    with ThreadPoolExecutor(len(steps)) as pool:
        return [found.result() for found in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that a task sorts or aggregates where they are many.
ROWS_PER_TASK = 1 << 19


def dealt(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """``df`` of ``n_rows`` rows, dealt by ``keys`` over more tasks than a shuffle has by
    itself if these would get more than ROWS_PER_TASK rows each."""
    tasks = -(-n_rows // ROWS_PER_TASK)
    return df.repartition(tasks, *keys) if tasks > shuffle_width(df.sparkSession) else df
