"""Characteristics tables and age histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortide.functions import numbers
from cohortide.operators.covariates import COVID_FLAG
from cohortide.operators.followup import PAIR, people_with_outcome
from cohortide.plans import definitions as d
from cohortide.sources.literals import literal_table

OVERALL = "Overall"
AGE_LABELS = {
    "<20": "age_under_20",
    "20-29": "age_20_29",
    "30-39": "age_30_39",
    "40-49": "age_40_49",
    "50-59": "age_50_59",
    "60-69": "age_60_69",
    "70-79": "age_70_79",
    ">=80": "age_80u",
}
BRAND_LABELS = {"index_az": "AZ", "index_jnj": "janssen", "index_pfizer": "pfizer", "index_mrna": "moderna"}
# Row names that are not just the sentence-cased variable.
RENAMED = {
    "sex_male": "Sex: Male",
    "prior_obs_years": "Years of prior observation time",
    "cond_comp": "One or more condition of interest",
    "drug_comp": "One or more medication of interest",
    "cond_drug_comp": "One or more condition/ medication of interest",
}


def counted_variables() -> dict[str, str]:
    """Variable -> SQL condition counted over people."""
    counted = {v: f"contains(vax_type, '{brand}')" for v, brand in BRAND_LABELS.items()}
    counted |= {v: f"age_gr3 = '{band}'" for band, v in AGE_LABELS.items()}
    counted["sex_male"] = "gender = 'Male'"
    flags = [COVID_FLAG, *(f"{c}_all_history" for c in d.CONDITIONS), *d.DRUGS]
    counted |= {f: f"{f} = 1" for f in [*flags, "cond_comp", "drug_comp", "cond_drug_comp"]}
    return counted


def _vax_types(rows: DataFrame) -> DataFrame:
    names = literal_table(rows.sparkSession, list(d.EXPOSURES.items()), "cohort_definition_id long, vax_type string")
    return rows.join(F.broadcast(names), "cohort_definition_id", "left")


def characteristics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Long table (keys, var, n, total, percent, low, mid, high, first, last).

    A single aggregate over the people; quartiles interpolate linearly and are taken
    over whole days or years, so their state is bounded by distinct days.
    """
    counted = counted_variables()
    wide = (
        _vax_types(rows)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("total"),
            F.min("index_date").alias("first_day"),
            F.max("index_date").alias("last_day"),
            F.expr("percentile(age, array(0.25D, 0.5D, 0.75D)) AS age_q"),
            F.expr("percentile(prior_obs_days, array(0.25D, 0.5D, 0.75D)) AS obs_q"),
            *(F.expr(f"count_if({sql}) AS {v}") for v, sql in counted.items()),
        )
    )

    def row(var: str, n: str = "NULL", q: str | None = None, day: str = "NULL", scale: float = 1.0) -> str:
        low, mid, high = (f"{q}[{i}] / {scale}D" if q else "CAST(NULL AS DOUBLE)" for i in range(3))
        return (
            f"struct('{var}' AS var, CAST({n} AS BIGINT) AS n, {low} AS low, {mid} AS mid, {high} AS high, "
            f"CAST({day} AS DATE) AS day)"
        )

    entries = [
        row("n", n="total"),
        row("min_index_date", day="first_day"),
        row("max_index_date", day="last_day"),
        row("age", q="age_q"),
        row("prior_obs_years", q="obs_q", scale=365.25),
        *(row(v, n=v) for v in counted),
    ]
    return wide.select(*keys, "total", F.expr(f"inline(array({', '.join(entries)}))"))


def with_text(table: DataFrame) -> DataFrame:
    """Add the row label and the printed value; counts of 1 to 4 show as "<5".

    Unlike a test on the printed text, this also hides a bare population size of 1 to 4.
    """
    label = F.regexp_replace(numbers.sentence_case(F.col("var")), "_", " ")
    for var, text in RENAMED.items():
        label = F.when(F.col("var") == var, text).otherwise(label)
    plain = F.when(F.col("var") == "n", numbers.count_text(F.col("n"))).otherwise(
        numbers.count_percent_text(F.col("n"), F.col("total"))
    )
    digits = F.when(
        F.col("var") == "age", numbers.median_range_text(F.col("low"), F.col("mid"), F.col("high"), 0)
    ).otherwise(numbers.median_range_text(F.col("low"), F.col("mid"), F.col("high"), 1))
    value = (
        F.when(F.col("n").between(1, 4), "<5")
        .when(F.col("n").isNotNull(), plain)
        .when(F.col("day").isNotNull(), F.col("day").cast("string"))
        .when(F.col("mid").isNotNull(), digits)
    )
    return table.withColumns({"label": label, "value": value})


def patient_characteristics(pop: DataFrame, facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Everyone, and people with each outcome in follow-up, as one long table.

    ``outcome_id`` is NULL for the whole study population.
    """
    overall = characteristics(pop, ["study_id"]).withColumn("outcome_id", F.lit(None).cast("int"))
    cases = characteristics(people_with_outcome(pop, facts, pairs), PAIR)
    return overall.unionByName(cases)


def wide_characteristics(table: DataFrame, outcome_names: dict[int, str] = d.OUTCOMES) -> DataFrame:
    """One row per study cohort and variable, a column for everyone and for each outcome."""
    names = literal_table(table.sparkSession, list(outcome_names.items()), "outcome_id int, outcome_name string")
    named = table.join(F.broadcast(names), "outcome_id", "left").withColumn(
        "outcome_name", F.coalesce("outcome_name", F.lit(OVERALL))
    )
    return named.groupBy("study_id", "label").pivot("outcome_name", [OVERALL, *outcome_names.values()]).agg(
        F.first("value")
    )


def histogram(rows: DataFrame, keys: list[str], width: int = 3) -> DataFrame:
    """Counts and density of age in bins centred on multiples of ``width``, empty bins included.

    Bins are open on the left and closed on the right.
    """
    half = width / 2
    bins = rows.groupBy(*keys, F.ceil((F.col("age") - half) / width).cast("int").alias("bin")).agg(
        F.count("*").alias("n")
    )
    ends = bins.groupBy(*keys).agg(
        F.min("bin").alias("first"), F.max("bin").alias("last"), F.sum("n").alias("total")
    )
    # At most one row per key and bin: both sides are small whatever the population.
    grid = ends.select(*keys, "total", F.explode(F.sequence("first", "last")).alias("bin"))
    count = F.coalesce("n", F.lit(0).cast("long"))
    centre = (F.col("bin") * width).cast("double")
    return grid.join(bins, [*keys, "bin"], "left").select(
        *keys,
        centre.alias("x"),
        (centre - half).alias("xmin"),
        (centre + half).alias("xmax"),
        count.alias("count"),
        (count / (F.col("total") * width)).alias("density"),
    )


def age_histograms(pop: DataFrame, facts: DataFrame, pairs: DataFrame, more_than: int = 30) -> DataFrame:
    """Age of everyone, and of people with each outcome where more than 30 have it.

    Rows are given for both settings of the prior observation requirement; they agree,
    as the population already requires a year of observation.
    """
    overall = histogram(pop, ["study_id"]).withColumn("outcome_id", F.lit(None).cast("int"))
    cases = people_with_outcome(pop, facts, pairs)
    many = cases.groupBy(*PAIR).agg(F.count("*").alias("n")).where(F.col("n") > more_than).drop("n")
    by_outcome = histogram(cases.join(F.broadcast(many), PAIR), PAIR)
    both = F.array(F.lit("No"), F.lit("Yes"))
    return overall.unionByName(by_outcome).withColumn("prior_obs_required", F.explode(both))
