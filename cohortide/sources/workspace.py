"""Intermediate tables in shared storage, and size-checked broadcasts.

A study reads the clinical tables once and then works on much smaller derived
tables.  Those are written as parquet to the folder named by ``spark.checkpoint.dir``:
a lost executor costs the tasks it was running, not the whole lineage.  Tables that
are used by person are bucketed on ``person_id``, so the windows, joins and
aggregates that follow need no further shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

# A lookup row here is a few integers and dates, so this stays near 100 MB.
BROADCAST_ROWS = 1_000_000


COLOCATE = "spark.sql.requireAllClusterKeysForCoPartition"
BUCKETS = "spark.cohortide.buckets"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """Folder that all executors share, named by the cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def bucket_count(spark: SparkSession) -> int:
    """Person buckets: the setting ``spark.cohortide.buckets``, else the session's shuffle width.

    A bucket should hold a few hundred MB: about 4,000 for each TB of clinical tables.
    """
    return int(spark.conf.get(BUCKETS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def place(df: DataFrame, by: str = "person_id") -> DataFrame:
    """Shuffle rows to the buckets of ``by``: what follows per person needs no other shuffle."""
    return df.repartition(bucket_count(df.sparkSession), by)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect its garbage.

    For writes and collects that nobody runs again: their shuffles would be made anew.
    """
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        _restore(spark, {CLEAN_UP: before})


def _restore(spark: SparkSession, settings: dict[str, str | None]) -> None:
    for name, value in settings.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


def _place(spark: SparkSession, path: str) -> tuple:
    """File system and Hadoop path of a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def fingerprint(frames: Iterable[DataFrame], *settings: object) -> str:
    """Digest of settings and of the files that frames read: name, length and time of each.

    Folders are listed, files are not opened.  Only frames over files are told apart by it.
    """
    seen = hashlib.sha256(repr(settings).encode())
    for frame in frames:
        spark = frame.sparkSession
        for folder in sorted({f.rsplit("/", 1)[0] for f in frame.inputFiles()}):
            files, where = _place(spark, folder)
            listed = [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files.listStatus(where)]
            seen.update(repr(sorted(listed)).encode())
        seen.update(b"|")
    return seen.hexdigest()[:24]


class Workspace:
    """Writes intermediate tables once and hands back readers on them.

    Joins on (study cohort, person) or (outcome, person) may use the person buckets as
    they are; Spark allows that when told that part of the join keys is enough to
    co-locate rows.  The session's own setting comes back with ``close``.  Unions of such rows stay in their buckets, too.
    Shuffle files of a table go as soon as it is written, so that those of one table at a time are on disk.

    With a ``key``, the tables of ``stage`` outlive a run that fails: the next workspace of that key, in
    any session, reads the finished ones and builds the others.
    """

    def __init__(self, spark: SparkSession, key: str | None = None):
        self.spark = spark
        self.lasting = f"{checkpoint_root(spark)}/cohortide-run-{key}-{bucket_count(spark)}" if key else None
        self.colocate = spark.conf.get(COLOCATE, None)
        spark.conf.set(COLOCATE, "false")
        self.tag = uuid.uuid4().hex[:12]
        self.root = f"{checkpoint_root(spark)}/cohortide-{self.tag}"
        self.count, self.kept = 0, []

    def keep(
        self, df: DataFrame, name: str, by: str | None = "person_id", placed: bool = False
    ) -> DataFrame:
        """Write ``df`` and read it back, bucketed on ``by`` unless that is None.

        ``placed`` says that ``place`` has already put the rows where they belong.
        """
        self.count += 1
        name = f"{name}_{self.count}"
        path = f"{self.root}/{name}"
        self.kept.append(name)
        if by is None:
            return self._write(df, path)
        return self._write_bucketed(df if placed else place(df, by), f"cohortide_{self.tag}_{name}", path, by)

    def drop(self, name: str) -> None:
        """Drop what ``keep`` wrote under a name, once what was made of it is written."""
        for kept in [k for k in self.kept if k.rsplit("_", 1)[0] == name]:
            self.spark.sql(f"DROP TABLE IF EXISTS cohortide_{self.tag}_{kept}")
            files, folder = _place(self.spark, f"{self.root}/{kept}")
            files.delete(folder, True)
            self.kept.remove(kept)

    def _write(self, rows: DataFrame, path: str) -> DataFrame:
        with shuffles_removed(self.spark):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def _write_bucketed(self, rows: DataFrame, table: str, path: str, by: str) -> DataFrame:
        writer = rows.write.mode("overwrite").bucketBy(bucket_count(self.spark), by).option("path", path)
        with shuffles_removed(self.spark):
            writer.option("compression", "zstd").saveAsTable(table)
        return self._bucketed(table, by)

    def _bucketed(self, table: str, by: str) -> DataFrame:
        """Rows of a bucketed table whose unions with other rows by person need no shuffle.

        Spark compares columns of a union with their qualifier, which a table's column has and the scan's has not; an alias
        has none.  Without metadata of its own the alias would be optimized away.
        """
        rows = self.spark.table(table)
        own = F.col(by).alias(by, metadata={"bucketed": True})
        return rows.select(*(own if c == by else F.col(c) for c in rows.columns))

    def stage(
        self, name: str, build: Callable[[], DataFrame], by: str | None = "person_id", placed: bool = False
    ) -> DataFrame:
        """``keep`` what ``build`` returns, or read it if an earlier run of the key has finished it.

        ``build`` is only called when it has to be, so whatever a finished table was made of is neither
        planned nor read.  Spark marks a folder once all its files are there; one without the mark is written anew.
        """
        if self.lasting is None:
            return self.keep(build(), name, by, placed)
        path, table = f"{self.lasting}/{name}", f"cohortide_{self.tag}_{name}"
        files, mark = _place(self.spark, f"{path}/_SUCCESS")
        done = files.exists(mark)
        if by is None:
            return self.spark.read.parquet(path) if done else self._write(build(), path)
        if not done:
            rows = build()
            return self._write_bucketed(rows if placed else place(rows, by), table, path, by)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) "
            f"INTO {bucket_count(self.spark)} BUCKETS LOCATION '{path}'"
        )
        return self._bucketed(table, by)

    def close(self, finished: bool = True) -> None:
        """Drop the kept tables with their files, and give the session its setting back.

        The files of stages with a key stay unless the run has ``finished``.
        """
        for table in self.spark.catalog.listTables():
            if table.name.startswith(f"cohortide_{self.tag}_"):
                self.spark.sql(f"DROP TABLE IF EXISTS {table.name}")
        for root in [self.root, *([self.lasting] if self.lasting and finished else [])]:
            files, folder = _place(self.spark, root)
            files.delete(folder, True)
        _restore(self.spark, {COLOCATE: self.colocate})


def broadcast_hint(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> Callable[[DataFrame], DataFrame]:
    """Count ``df`` once; what comes back hints broadcasts of its parts if it is small, and nothing else."""
    return F.broadcast if df.limit(max_rows + 1).count() <= max_rows else lambda part: part


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` after counting that it is small; beyond that leave the join to Spark.

    Without the hint the join falls back to a shuffle join, with skewed partitions
    split at run time.
    """
    return broadcast_hint(df, max_rows)(df)
