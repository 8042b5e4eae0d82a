"""Kaplan-Meier curves on a daily grid, for all pairs, slices and strata at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortide.functions.tails import Z95
from cohortide.operators.covariates import COVID_FLAG
from cohortide.operators.followup import PAIR, count_cells
from cohortide.operators.population import age_bands

CURVE = [*PAIR, "slice", "strata", "grp"]
FLAG_STRATA = ("cond_comp", "drug_comp", "cond_drug_comp")
PROFILE = ("gender", "age", *FLAG_STRATA, COVID_FLAG)


def slices() -> Column:
    """Slices a row belongs to: everyone, and one of the two by recent infection."""
    own = F.when(F.col(COVID_FLAG) == 1, "Covid").otherwise("No covid")
    return F.array(F.lit("All"), own)


def strata() -> Column:
    """The eleven stratifications a row belongs to, as (strata, grp)."""

    def label(*names: str) -> Column:
        parts = [F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names]
        return F.concat_ws(", ", *parts)

    def entry(name: str, group: Column) -> Column:
        return F.struct(F.lit(name).alias("strata"), group.alias("grp"))

    bands = ("age_gr", "age_gr2", "age_gr3")
    return F.array(
        entry("overall", F.lit("overall")),
        entry("gender", label("gender")),
        *(entry(f, label(f)) for f in FLAG_STRATA),
        *(entry(f"{b}_gender", label(b, "gender")) for b in bands),
        *(entry(b, label(b)) for b in bands),
    )


def stratified_counts(pop: DataFrame, facts: DataFrame, pairs: DataFrame, earliest: bool = False) -> DataFrame:
    """People and events by day for every curve."""
    cells = count_cells(pop, facts, pairs, {c: F.col(c) for c in PROFILE}, earliest=earliest)
    return (
        cells.withColumns(age_bands())
        .withColumn("slice", F.explode(slices()))
        .select(*PAIR, "slice", "days", "event", "n", F.inline(strata()))
        .groupBy(*CURVE, F.col("days").alias("time"))
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("event")).alias("n_event"))
    )


def reportable(counts: DataFrame) -> DataFrame:
    """Drop slices with fewer than 5 people, populations of 5 or fewer, and rare flags."""
    of_slice = W.partitionBy(*PAIR, "slice", "strata")
    of_pair = W.partitionBy(*PAIR, "strata")
    flagged = F.col("grp") == F.concat(F.col("strata"), F.lit("=1"))
    return (
        counts.withColumns(
            {
                "__slice": F.sum("n").over(of_slice),
                "__flagged": F.sum(F.when(flagged, F.col("n")).otherwise(0)).over(of_slice),
                "__pair": F.sum(F.when(F.col("slice") == "All", F.col("n")).otherwise(0)).over(of_pair),
            }
        )
        .where((F.col("__slice") >= 5) & (F.col("__pair") > 5))
        .where(~F.col("strata").isin(*FLAG_STRATA) | (F.col("__flagged") > 5))
        .drop("__slice", "__flagged", "__pair")
    )


def kaplan_meier(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Curves from counts per key and time (``n`` leaving, ``n_event`` of them with the event).

    ``counts`` holds one row per key and time.  Every day from 0 to the last time of the curve gets a row.  Limits use the log
    scale.  A curve has at most one row per day of follow-up, so the windows are small.
    """
    in_order = W.partitionBy(*keys).orderBy("time")
    # Each row also stands for the days since the row before, on which nobody leaves.
    first_day = F.coalesce(F.lag("time").over(in_order), F.lit(-1)) + 1
    here = F.col("day") == F.col("time")
    daily = (
        counts.withColumn("__from", first_day)
        .select(*keys, "time", "n", "n_event", F.explode(F.sequence("__from", "time")).alias("day"))
        .select(
            *keys,
            F.col("day").alias("time"),
            F.when(here, F.col("n")).otherwise(0).alias("n"),
            F.when(here, F.col("n_event")).otherwise(0).alias("n_event"),
        )
    )
    onwards = W.partitionBy(*keys).orderBy(F.desc("time")).rowsBetween(W.unboundedPreceding, 0)
    so_far = W.partitionBy(*keys).orderBy("time").rowsBetween(W.unboundedPreceding, 0)
    at_risk, events = F.col("n_risk").cast("double"), F.col("n_event").cast("double")
    survivors = at_risk - events
    some_left = survivors > 0
    log_step = F.when(some_left, F.log(survivors / at_risk)).otherwise(F.lit(0.0))
    var_step = F.when(some_left, F.try_divide(events, at_risk * survivors)).otherwise(F.lit(0.0))
    curve = (
        daily.withColumn("n_risk", F.sum("n").over(onwards))
        .withColumns(
            {
                "__log": F.sum(log_step).over(so_far),
                "__var": F.sum(var_step).over(so_far),
                "__dead": F.max(F.when(some_left, 0).otherwise(1)).over(so_far),
                "cum_n_event": F.sum("n_event").over(so_far),
            }
        )
    )
    alive = F.col("__dead") == 0
    surv = F.exp(F.col("__log"))
    reach = F.lit(Z95) * F.sqrt("__var")
    return curve.select(
        *keys,
        "time",
        "n_risk",
        "n_event",
        "cum_n_event",
        F.when(alive, surv).otherwise(F.lit(0.0)).alias("surv"),
        F.when(alive, surv * F.exp(-reach)).alias("lower"),
        F.when(alive, F.least(F.lit(1.0), surv * F.exp(reach))).alias("upper"),
    )
