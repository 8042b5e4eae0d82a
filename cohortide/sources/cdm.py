"""The clinical tables as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cohortide import schemas


@dataclass(frozen=True)
class Cdm:
    """One DataFrame per clinical table, all lazy."""

    spark: SparkSession
    person: DataFrame
    observation_period: DataFrame
    condition_occurrence: DataFrame
    drug_exposure: DataFrame
    drug_era: DataFrame
    measurement: DataFrame
    observation: DataFrame
    concept: DataFrame
    concept_ancestor: DataFrame


def _open(spark: SparkSession, read: Callable[[str], DataFrame]) -> Cdm:
    tables = {}
    for name, schema in schemas.CLINICAL_TABLES.items():
        df = read(name)
        known = {c.lower(): c for c in df.columns}
        missing = [f.name for f in schema if f.name not in known]
        if missing:
            raise ValueError(f"table {name} lacks columns {missing}")
        tables[name] = df.select([df[known[f.name]].cast(f.dataType).alias(f.name) for f in schema])
    return Cdm(spark=spark, **tables)


def read_parquet(spark: SparkSession, root: str) -> Cdm:
    """Open ``<root>/<table>.parquet`` files or folders."""
    base = root.rstrip("/")
    return _open(spark, lambda name: spark.read.parquet(f"{base}/{name}.parquet"))


def read_catalog(spark: SparkSession, clinical_schema: str, vocabulary_schema: str | None = None) -> Cdm:
    """Open catalog tables; the vocabulary may live in a schema of its own."""
    vocabulary_schema = vocabulary_schema or clinical_schema

    def read(name: str) -> DataFrame:
        schema = vocabulary_schema if name.startswith("concept") else clinical_schema
        return spark.table(f"{schema}.{name}")

    return _open(spark, read)
