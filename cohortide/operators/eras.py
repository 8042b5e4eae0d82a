"""Merging of overlapping or nearby intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def collapse(
    intervals: DataFrame,
    keys: list[str],
    pad: Column | int = 0,
    start: str = "start_date",
    end: str = "end_date",
) -> DataFrame:
    """Merge intervals whose gap is at most ``pad`` days; touching intervals merge.

    Intervals with the same start merge anyway, so only the latest end per start day
    is kept before the window: the sort per key is bounded by days on record.  A new
    era begins where the start lies beyond the latest end so far plus the pad.
    """
    pad_col = F.lit(pad) if isinstance(pad, int) else pad
    extra = [] if isinstance(pad, int) else [F.first(pad_col).alias("__pad")]
    days = intervals.groupBy(*keys, start).agg(F.max(end).alias(end), *extra)
    step = F.lit(pad) if isinstance(pad, int) else F.col("__pad")
    ordered = W.partitionBy(*keys).orderBy(start)
    latest = F.max(end).over(ordered.rowsBetween(W.unboundedPreceding, -1))
    begins = F.when(F.col(start) <= F.date_add(latest, step), 0).otherwise(1)
    return (
        days.withColumn("__new", begins)
        .withColumn("__era", F.sum("__new").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "__era")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("__era")
    )


def drug_eras(drug_exposure: DataFrame, gap: int = 30) -> DataFrame:
    """Continuous use per person and drug, bridging gaps of up to ``gap`` days.

    Exposures are shuffled once, by person and drug; few of them start on the same day, so combining those first
    would only shuffle them twice.
    """
    from cohortide.operators.events import drug_end

    used = drug_exposure.select(
        "person_id",
        "drug_concept_id",
        F.col("drug_exposure_start_date").alias("drug_era_start_date"),
        drug_end().alias("drug_era_end_date"),
    )
    keys = ["person_id", "drug_concept_id"]
    return collapse(used.repartition(*keys), keys, gap, "drug_era_start_date", "drug_era_end_date")
