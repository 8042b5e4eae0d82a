"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import pickle
import sys
import tempfile
import uuid
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_value(module: str) -> None:
    """Ship the functions of a module with the tasks, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def send(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object with its class, for executors without the package; ``received`` unpacks it in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast) -> Any:
    return pickle.loads(sent.value)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _place(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def keep(df: DataFrame, name: str, shelf: list[str] | None = None, by: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write a table once and read it back: lineage ends here, and lost executors cost nothing.

    The files go when the session ends, or before that with the ``shelf`` that notes them.  ``by`` names a
    column whose values get a folder each.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by, compression=compression)
    files, where = _place(spark, path)
    files.deleteOnExit(where)
    if shelf is not None:
        shelf.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, shelf: list[str]) -> None:
    """Delete the tables of a shelf, once nothing reads them any more."""
    while shelf:
        files, where = _place(spark, shelf.pop())
        files.delete(where, True)


def bound_batches(spark: SparkSession, size: str = "2m") -> None:
    """Python tasks of the session get so many bytes at once, however long texts are, unless the session has its own bound."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Up to so many short rows (ids, hashes, counts) a table may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 100_000


def broadcast_small(df: DataFrame) -> DataFrame:
    """Mark a written table of short rows for broadcast if its count allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
