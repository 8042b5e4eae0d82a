"""Cohort tables, manifests and result sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortide import schemas
from cohortide.sources.workspace import shuffles_removed


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV list of cohorts to build: (id, name)."""
    raw = spark.read.csv(path, header=True, schema=schemas.MANIFEST)
    return raw.select(F.col("cohortId").cast("long").alias("cohort_definition_id"), "name")


def read_concept_sets(spark: SparkSession, path: str) -> DataFrame:
    """CSV concept sets: codeset, concept_id, include_descendants."""
    return spark.read.csv(path, header=True, schema=schemas.CONCEPT_SET)


# A cohort table is a folder with versions, each a write's data, and snapshots: numbered lists of
# (cohort, version), of which the last one counts.  Writing a table means staging a version and then
# naming a new snapshot, so readers see the table before or after a write and never between.


def _files(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    where = place(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    files, place = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place(path))) if files.exists(place(path)) else []


def _snapshots(spark: SparkSession, path: str) -> list[str]:
    return [n for n in _names(spark, f"{path}/_snapshots") if n.isdigit()]


def _listed(spark: SparkSession, path: str, snapshot: str) -> dict[int, str]:
    """Of a snapshot: the version that holds each cohort."""
    lines = spark.read.text(f"{path}/_snapshots/{snapshot}").collect()
    return {int(c): v for c, v in (r[0].split(" ") for r in lines)}


def _current(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    known = _snapshots(spark, path)
    return (int(known[-1]), _listed(spark, path, known[-1])) if known else (0, {})


def _switch(spark: SparkSession, path: str, number: int, versions: dict[int, str]) -> None:
    """Name the next snapshot.  Renaming is one step, and fails if another writer has taken the number."""
    files, place = _files(spark, path)
    staged = place(f"{path}/_snapshots/staged-{uuid.uuid4().hex}")
    out = files.create(staged)
    out.write(bytearray("".join(f"{c} {v}\n" for c, v in sorted(versions.items())), "utf-8"))
    out.close()
    name = place(f"{path}/_snapshots/{number:010d}")
    if files.exists(name) or not files.rename(staged, name):
        files.delete(staged, False)
        raise RuntimeError(f"another run has written to {path} meanwhile")


def _tidy(spark: SparkSession, path: str) -> None:
    """Delete what neither of the last two snapshots lists; readers of the one before may still be at work."""
    files, place = _files(spark, path)
    known = _snapshots(spark, path)
    used = {(v, c) for k in known[-2:] for c, v in _listed(spark, path, k).items()}
    for folder in _names(spark, path):
        version = folder.removeprefix("version=")
        if version == folder:
            continue
        cohorts = [n for n in _names(spark, f"{path}/{folder}") if "=" in n]
        gone = [n for n in cohorts if (version, int(n.split("=")[1])) not in used]
        for name in [folder] if len(gone) == len(cohorts) else [f"{folder}/{n}" for n in gone]:
            files.delete(place(f"{path}/{name}"), True)
    for k in known[:-2]:
        files.delete(place(f"{path}/_snapshots/{k}"), False)


def empty_cohort_table(spark: SparkSession, path: str) -> None:
    """Create the cohort table, dropping what was there."""
    path = path.rstrip("/")
    number, _ = _current(spark, path)
    _switch(spark, path, number + 1, {})
    _tidy(spark, path)


def write_cohorts(cohorts: DataFrame, path: str, ids: Iterable[int] = ()) -> None:
    """Replace the cohorts present in ``cohorts`` and those in ``ids``, in one step; leave the others in the table alone.

    A cohort of ``ids`` without rows ends up empty.  A run that dies before its end leaves the table as
    it was.  Rows are dealt by cohort and split by size, so a cohort with most rows has many
    writers and a small one a single file.
    """
    spark, path, version = cohorts.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    number, versions = _current(spark, path)
    rows = cohorts.select([F.col(f.name).cast(f.dataType) for f in schemas.COHORT])
    with shuffles_removed(spark):
        rows.hint("rebalance", F.col("cohort_definition_id")).write.partitionBy("cohort_definition_id").parquet(f"{path}/version={version}")
    filled = {int(n.split("=")[1]) for n in _names(spark, f"{path}/version={version}") if "=" in n}
    kept = {c: v for c, v in versions.items() if c not in filled | set(ids)}
    _switch(spark, path, number + 1, kept | dict.fromkeys(filled, version))
    _tidy(spark, path)


def delete_cohorts(spark: SparkSession, ids: Iterable[int], path: str, target: str) -> None:
    """Copy the table at ``path`` to ``target`` without the given cohorts."""
    kept = read_cohorts(spark, path).where(~F.col("cohort_definition_id").isin(list(ids)))
    write_cohorts(kept, target)


def read_cohorts(spark: SparkSession, path: str) -> DataFrame:
    """Read a cohort table back, as its last snapshot has it, with an integer cohort id."""
    path = path.rstrip("/")
    _, versions = _current(spark, path)
    if not versions:
        return spark.createDataFrame([], schemas.COHORT).withColumn("cohort_definition_id", F.col("cohort_definition_id").cast("int"))
    folders = [f"{path}/version={v}/cohort_definition_id={c}" for c, v in sorted(versions.items())]
    df = spark.read.schema(schemas.COHORT).option("basePath", path).parquet(*folders)
    return df.select(
        F.col("cohort_definition_id").cast("int").alias("cohort_definition_id"),
        "subject_id",
        "cohort_start_date",
        "cohort_end_date",
    )


def write_results(results: dict[str, DataFrame], path: str, database: str) -> None:
    """One parquet folder per result and database: a run replaces the results of its own database alone."""
    for name, df in results.items():
        with shuffles_removed(df.sparkSession):
            df.drop("db").write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}/db={quote(database, safe='')}")


def read_results(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A result of all databases, each row with the name of its own (``db``)."""
    folder = f"{path.rstrip('/')}/{name}"
    found = spark.read.parquet(folder).drop("db").schema
    return spark.read.schema(found.add("db", "string")).parquet(folder)  # names stay text, "007" too
