"""Study populations: one row per study cohort and person, with index date and profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cohortide.functions import dates
from cohortide.plans import definitions as d
from cohortide.sources.cdm import Cdm
from cohortide.sources.literals import literal_table
from cohortide.sources.workspace import Workspace

STUDY_IDS = {name: id for id, name in d.EXPOSURES.items()} | {
    name: max(d.EXPOSURES) + 1 + i for i, name in enumerate(d.COMPOSITES)
}
GENERAL_POPULATION_ID = STUDY_IDS[d.GENERAL_POPULATION]
PERSON_KEY = ["study_id", "person_id"]


def study_table(spark: SparkSession) -> DataFrame:
    """(study_id, study_cohort)."""
    return literal_table(spark, [(i, n) for n, i in STUDY_IDS.items()], "study_id int, study_cohort string")


def membership_table(spark: SparkSession, studies: tuple[str, ...] | None = None) -> DataFrame:
    """(study_id, cohort_definition_id, role): which cohorts enter a study and which end follow-up."""
    ids = {name: id for id, name in d.EXPOSURES.items()}
    rows = [
        (STUDY_IDS[study], ids[name], role)
        for role, table in (("entry", d.study_members()), ("next", d.study_censors()))
        for study, names in table.items()
        if studies is None or study in studies
        for name in names
    ]
    return literal_table(spark, rows, "study_id int, cohort_definition_id long, role string")


def study_entries(cohorts: DataFrame, members: DataFrame) -> DataFrame:
    """First exposure per study and person, ties counted, with the next vaccine date.

    ``n_entries`` is the number of exposure cohorts that start on the index date.
    """
    firsts = (
        cohorts.join(F.broadcast(members), "cohort_definition_id")
        .groupBy("study_id", F.col("subject_id").alias("person_id"), "cohort_definition_id", "role")
        .agg(F.min("cohort_start_date").alias("start_date"))
    )
    # One row per exposure cohort at most, so this window stays tiny for everyone.
    everyone = W.partitionBy(*PERSON_KEY)
    entry = F.col("role") == "entry"
    return (
        firsts.withColumns(
            {
                "index_date": F.min(F.when(entry, F.col("start_date"))).over(everyone),
                "next_vax_date": F.min(F.when(~entry, F.col("start_date"))).over(everyone),
            }
        )
        .where(entry & (F.col("start_date") == F.col("index_date")))
        .groupBy(*PERSON_KEY)
        .agg(
            F.min("index_date").alias("index_date"),
            F.min("next_vax_date").alias("next_vax_date"),
            F.min("cohort_definition_id").alias("cohort_definition_id"),
            F.count("*").alias("n_entries"),
        )
    )


def period_summary(periods: DataFrame) -> DataFrame:
    """Per person: number of distinct observation periods, and the dates of a single one."""
    return periods.groupBy("person_id").agg(
        F.count("*").alias("n_periods"), F.min("op_start").alias("op_start"), F.max("op_end").alias("op_end")
    )


def containing_period(entries: DataFrame, periods: DataFrame) -> DataFrame:
    """Per study and person: the observation period that contains the index date."""
    return (
        entries.select(*PERSON_KEY, "index_date")
        .join(periods, "person_id")
        .where(F.col("index_date").between(F.col("op_start"), F.col("op_end")))
        .groupBy(*PERSON_KEY)
        .agg(F.min("op_start").alias("op_start"), F.max("op_end").alias("op_end"))
        .withColumn("n_periods", F.lit(1).cast("long"))
    )


def assemble(
    cdm: Cdm,
    entries: DataFrame,
    periods: DataFrame,
    tail_days: int = 7,
    op_containing_index: bool = False,
) -> DataFrame:
    """Attach person and observation period; drop ambiguous people and late index dates.

    People with several same-day exposures, or with several observation periods, are
    dropped.  ``op_containing_index`` keeps the latter, using the period around the index.
    """
    if op_containing_index:
        spans, key = containing_period(entries, periods), PERSON_KEY
    else:
        spans, key = period_summary(periods), ["person_id"]
    last_day = periods.select(F.max("op_end").alias("last_day")).scalar()
    return (
        entries.join(spans, key, "left")
        .where((F.col("n_entries") == 1) & (F.coalesce("n_periods", F.lit(1)) == 1))
        .where(F.col("index_date") < F.date_sub(last_day, tail_days))
        .join(cdm.person, "person_id")
        .drop("n_entries", "n_periods")
    )


def _banded(column: str, edges: list[tuple[int, str]], last: str) -> Column:
    bands = F.when(F.col(column) < edges[0][0], edges[0][1])
    for limit, label in edges[1:]:
        bands = bands.when(F.col(column) < limit, label)
    return bands.otherwise(F.when(F.col(column).isNotNull(), last))


def age_bands(column: str = "age") -> dict[str, Column]:
    """The three groupings of age, by upper edge."""
    return {
        "age_gr": _banded(
            column,
            [(20, "<20"), (45, "20-44"), (55, "45-54"), (65, "55-64"), (75, "65-74"), (85, "75-84")],
            ">=85",
        ),
        "age_gr2": _banded(column, [(45, "<=44"), (65, "45-64")], ">=65"),
        "age_gr3": _banded(
            column,
            [(20, "<20")] + [(top, f"{top - 10}-{top - 1}") for top in range(30, 81, 10)],
            ">=80",
        ),
    }


def with_age_and_sex(base: DataFrame) -> DataFrame:
    """Age at index and sex.

    Age counts completed years when everyone in the study cohort has a full date of
    birth, and is the difference of calendar years for everyone otherwise.
    """
    complete = base.groupBy("study_id").agg(
        F.bool_and(F.col("month_of_birth").isNotNull() & F.col("day_of_birth").isNotNull()).alias("complete")
    )
    born = dates.birth_date(F.col("year_of_birth"), F.col("month_of_birth"), F.col("day_of_birth"))
    age = F.when(F.col("complete"), dates.age_in_years(F.col("index_date"), born)).otherwise(
        F.year("index_date") - F.col("year_of_birth")
    )
    sex = F.when(F.col("gender_concept_id") == d.MALE, "Male").when(
        F.col("gender_concept_id") == d.FEMALE, "Female"
    )
    # One row per study cohort, so the broadcast is bounded by the study definition.
    return (
        base.join(F.broadcast(complete), "study_id")
        .withColumns({"age": age, "gender": sex})
        .withColumns(age_bands())
        .drop("complete", "gender_concept_id", "month_of_birth", "day_of_birth")
    )


def usable(pop: DataFrame, born_after: int | None = None) -> DataFrame:
    """Keep adults up to 110 with known sex and a year of earlier observation."""
    keep = (
        F.col("age").between(18, 110)
        & F.col("gender").isNotNull()
        & F.col("op_end").isNotNull()
        & (F.col("prior_obs_days") / F.lit(365.25) >= 1)
    )
    if born_after is not None:
        keep = keep & (F.col("year_of_birth") > born_after)
    return pop.withColumn("prior_obs_days", F.date_diff("index_date", "op_start")).where(keep)


def study_population(
    cdm: Cdm,
    cohorts: DataFrame,
    periods: DataFrame,
    studies: tuple[str, ...] | None = None,
    work: Workspace | None = None,
    born_after: int | None = None,
    op_containing_index: bool = False,
) -> DataFrame:
    """All study cohorts in one pass: index date, follow-up limits, age, sex, months since start."""
    entries = study_entries(cohorts, membership_table(cdm.spark, studies))
    base = assemble(cdm, entries, periods, op_containing_index=op_containing_index)
    base = work.keep(base, "population_base") if work else base
    return usable(with_age_and_sex(base), born_after)


def with_months_since_start(pop: DataFrame, exposures: DataFrame) -> DataFrame:
    """Calendar months from the first vaccine in the data; NULL for the general population."""
    first = (
        exposures.where(F.col("cohort_definition_id") != GENERAL_POPULATION_ID)
        .select(F.min("cohort_start_date").alias("first"))
        .scalar()
    )
    months = dates.months_between_calendar(first, F.col("index_date"))
    return pop.withColumn(
        "months_since_start", F.when(F.col("study_id") != GENERAL_POPULATION_ID, months)
    )


_PRIME = 2147483647


def person_hash(seed: int) -> str:
    """SQL for a number from 0 to 2^31 - 2 that depends on the person and a seed; integers only, so
    that other engines get the same."""
    start = f"((person_id % {_PRIME}) * 48271 + {seed % _PRIME} * 69621 + 11) % {_PRIME}"
    return f"((({start}) * ({start})) % {_PRIME} * 16807 + ({start})) % {_PRIME}"


def sample(pop: DataFrame, rows: int, seed: int = 0, edge_rows: int = 10_000) -> DataFrame:
    """Exactly ``rows`` rows (or all), those with the lowest hash of the person, then person and study.

    The range of hashes that straddles the cut is counted in ever finer parts, at most 4,096 at a
    time, until it holds few rows or a single hash; only those are sorted.
    """
    hashed = pop.withColumn("__hash", F.expr(person_hash(seed)))
    low, high, taken, edge = 0, _PRIME, 0, None
    while True:
        width = max(1, -(-(high - low) // 4096))
        part = F.floor((F.col("__hash") - low) / width).cast("int")
        inside = hashed.where((F.col("__hash") >= low) & (F.col("__hash") < high))
        cut = None
        for number, n in sorted(inside.groupBy(part.alias("part")).count().collect()):
            if taken + n > rows:
                cut, edge = number, n
                break
            taken += n
        if cut is None:
            return pop if high == _PRIME else hashed.where(F.col("__hash") < high).drop("__hash")
        low, high = low + cut * width, min(high, low + (cut + 1) * width)
        if edge <= edge_rows or width == 1:
            break
    whole = hashed.where(F.col("__hash") < low)
    last = hashed.where((F.col("__hash") >= low) & (F.col("__hash") < high))
    last = last.orderBy("__hash", *[c for c in ("person_id", "study_id") if c in pop.columns]).limit(rows - taken)
    return whole.unionByName(last).drop("__hash")
