"""Cohort lists: which cohorts a run writes, and under which numbers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from cohortide.plans.specs import CohortSpec
from cohortide.sources.literals import literal_table


def resolve(manifest: DataFrame, specs: Iterable[CohortSpec]) -> dict[int, int]:
    """Number in ``specs`` -> number in the manifest, (cohort_definition_id, name), matched by name.

    A manifest lists definitions, so it is as short as they are.  Unknown names and numbers or names given twice are errors.
    """
    by_name = {s.name: s.id for s in specs}
    listed = [(r["cohort_definition_id"], r["name"]) for r in manifest.select("cohort_definition_id", "name").collect()]
    unknown = sorted({str(n) for _, n in listed if n not in by_name})
    if unknown:
        raise ValueError(f"no definition for {', '.join(unknown)}")
    for values in zip(*listed, strict=True):
        if None in values or len(set(values)) < len(values):
            raise ValueError("numbers and names of a manifest must be given once each")
    return {by_name[name]: id for id, name in listed}


def renumbered(cohorts: DataFrame, numbers: dict[int, int]) -> DataFrame:
    """Rows of the listed cohorts under the manifest's numbers."""
    table = literal_table(cohorts.sparkSession, list(numbers.items()), "cohort_definition_id int, _listed int")
    rows = cohorts.join(F.broadcast(table), "cohort_definition_id")
    return rows.withColumn("cohort_definition_id", F.col("_listed")).select(*cohorts.columns)
