"""Comorbidity, medication and infection history of the study population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortide.operators import concepts, events as ev
from cohortide.operators.population import PERSON_KEY
from cohortide.plans import definitions as d
from cohortide.sources.cdm import Cdm
from cohortide.sources.workspace import place

COVID_FLAG = "covid_year_prior"


def _cohort_rows(code: str, date: str) -> list[Column]:
    return [
        F.col(code).alias("cohort_definition_id"),
        F.col("person_id").alias("subject_id"),
        F.col(date).alias("cohort_start_date"),
        F.col(date).alias("cohort_end_date"),
    ]


def condition_firsts(cdm: Cdm, tops: dict[str, int] = d.CONDITIONS) -> DataFrame:
    """One row per person with the first date of each condition group, in one scan and shuffle."""
    members = concepts.ancestor_members(cdm.spark, tops, cdm.concept_ancestor)
    hits = ev.code_list_rows(
        cdm.condition_occurrence, "condition_concept_id", "condition_start_date", members
    )
    return hits.groupBy("person_id").agg(
        *(F.expr(f"min(CASE WHEN code = {code} THEN event_date END) AS {name}_first") for name, code in tops.items())
    )


def comorbidity_cohorts(firsts: DataFrame, exposed: DataFrame, tops: dict[str, int] = d.CONDITIONS) -> DataFrame:
    """First dates of exposed people as cohort rows, one per person and condition group."""
    pairs = ", ".join(f"struct({code}L AS code, {name}_first AS first_date)" for name, code in tops.items())
    return (
        firsts.join(exposed.select("person_id"), "person_id", "left_semi")
        .select("person_id", F.expr(f"inline(array({pairs}))"))
        .where(F.col("first_date").isNotNull())
        .select(*_cohort_rows("code", "first_date"))
    )


def medication_days(cdm: Cdm, eras_from, tops: dict[str, int] = d.DRUGS) -> DataFrame:
    """(person_id, day, mask): drug classes with an era starting that day and lasting past a date.

    Bit i of the mask stands for the i-th class.
    """
    members = concepts.ancestor_members(cdm.spark, tops, cdm.concept_ancestor)
    recent = cdm.drug_era.where(F.col("drug_era_end_date") >= F.lit(eras_from))
    hits = ev.code_list_rows(recent, "drug_concept_id", "drug_era_start_date", members)
    bits = " ".join(f"WHEN {code} THEN {1 << i}L" for i, code in enumerate(tops.values()))
    return place(hits).groupBy("person_id", F.col("event_date").alias("day")).agg(
        F.expr(f"bit_or(CASE code {bits} END) AS mask")
    )


def medication_cohorts(days: DataFrame, exposed: DataFrame, tops: dict[str, int] = d.DRUGS) -> DataFrame:
    """Distinct era starts of exposed people as cohort rows, one per person, class and day."""
    codes = ", ".join(f"struct({code}L AS code, {1 << i}L AS bit)" for i, code in enumerate(tops.values()))
    return (
        days.join(exposed.select("person_id"), "person_id", "left_semi")
        .select("person_id", "day", "mask", F.expr(f"inline(array({codes}))"))
        .where("mask & bit != 0")
        .select(*_cohort_rows("code", "day"))
    )


def firsts_from_cohorts(comorbidities: DataFrame, tops: dict[str, int] = d.CONDITIONS) -> DataFrame:
    """``condition_firsts`` of exposed people from stored comorbidity cohorts."""
    return comorbidities.groupBy(F.col("subject_id").alias("person_id")).agg(
        *(
            F.expr(f"min(CASE WHEN cohort_definition_id = {code} THEN cohort_start_date END) AS {name}_first")
            for name, code in tops.items()
        )
    )


def days_from_cohorts(medications: DataFrame, tops: dict[str, int] = d.DRUGS) -> DataFrame:
    """``medication_days`` of exposed people from stored medication cohorts."""
    bits = " ".join(f"WHEN {code} THEN {1 << i}L" for i, code in enumerate(tops.values()))
    return medications.groupBy(F.col("subject_id").alias("person_id"), F.col("cohort_start_date").alias("day")).agg(
        F.expr(f"bit_or(CASE cohort_definition_id {bits} END) AS mask")
    )


def condition_flags(pop: DataFrame, firsts: DataFrame, tops: dict[str, int] = d.CONDITIONS) -> DataFrame:
    """One 0/1 column per condition: recorded on a day before the index date."""
    flags = [f"CAST(coalesce({name}_first < index_date, false) AS INT) AS {name}_all_history" for name in tops]
    return pop.join(firsts, "person_id", "left").selectExpr(*pop.columns, *flags)


def recent_flags(
    pop: DataFrame,
    medications: DataFrame,
    covid: DataFrame,
    covid_from_year: int,
    tops: dict[str, int] = d.DRUGS,
) -> DataFrame:
    """0/1 columns for drugs 183 to 4 days before the index and infection in the year up to it.

    ``medications`` are masks by person and day.  Index dates and days of a person pass by in one order of
    dates, and each index date reads the last day so far of every drug and of infection: the work is linear
    in days and index dates, whoever has how many.
    """
    people = pop.select("person_id").distinct()
    last = {name: F.expr(f"CASE WHEN mask & {1 << i}L != 0 THEN day END") for i, name in enumerate(tops)}
    # a drug day is visible four days later
    drugs = medications.select("person_id", F.date_add("day", 4).alias("at"), *(c.alias(n) for n, c in last.items()))
    infected = covid.where(F.year("cohort_start_date") >= covid_from_year).select(
        F.col("subject_id").alias("person_id"),
        F.col("cohort_start_date").alias("at"),
        F.col("cohort_start_date").alias(COVID_FLAG),
    )
    days = drugs.unionByName(infected, allowMissingColumns=True).join(people, "person_id", "left_semi")
    stream = days.unionByName(
        pop.select(*PERSON_KEY, F.col("index_date").alias("at")), allowMissingColumns=True
    )
    so_far = Window.partitionBy("person_id").orderBy("at", F.col("study_id").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    names = [*tops, COVID_FLAG]
    seen = stream.select(*PERSON_KEY, "at", *(F.max(n).over(so_far).alias(n) for n in names)).where("study_id IS NOT NULL")
    floor = {n: F.date_sub("at", 183) for n in tops} | {COVID_FLAG: F.add_months("at", -12)}
    flags = [F.coalesce(F.col(n) >= floor[n], F.lit(False)).cast("int").alias(n) for n in names]
    return pop.join(seen.select(*PERSON_KEY, *flags), PERSON_KEY).select(*pop.columns, *names)


def composite_flags(pop: DataFrame) -> DataFrame:
    """1 when any condition, any drug, or either of interest is present."""

    def any_of(names: list[str]) -> Column:
        return (sum((F.col(n) for n in names[1:]), F.col(names[0])) > 0).cast("int")

    conditions = [f"{n}_all_history" for n in d.CONDITIONS_OF_INTEREST]
    drugs = list(d.DRUGS_OF_INTEREST)
    return pop.withColumns(
        {
            "cond_comp": any_of(conditions),
            "drug_comp": any_of(drugs),
            "cond_drug_comp": any_of(conditions + drugs),
        }
    )
