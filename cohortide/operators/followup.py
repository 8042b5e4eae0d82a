"""Follow-up of each study population for each outcome.

Most people never have a given outcome, and for them time at risk does not depend on
which outcome is asked for.  So the outcome facts are kept only for people who have
outcome rows, and tables of counts are made once for "nobody has the outcome" and then
corrected by those few people.  The counts are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortide.operators.population import GENERAL_POPULATION_ID, PERSON_KEY

PAIR = ["study_id", "outcome_id"]


def _is_general() -> Column:
    return F.col("study_id") == GENERAL_POPULATION_ID


def horizon(days: int = 28, general_months: int = 24) -> Column:
    """Last day of follow-up: 28 days, or two years in the general population."""
    return F.when(_is_general(), F.add_months("index_date", general_months)).otherwise(
        F.date_add("index_date", days)
    )


def _next_vax() -> Column:
    """Next vaccine, ignored when recorded before the index date."""
    return F.when(F.col("next_vax_date") >= F.col("index_date"), F.col("next_vax_date"))


def outcome_facts(pop: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per study cohort, outcome and person with any outcome row: what happened when.

    A person's rows of an outcome pass by in one order of dates, with two marks for each index date: one
    before the first day of follow-up, one after the last.  Running counts at the marks, the last date before and the
    next one after give washout, history, rows in follow-up and the first follow-up date.  The work is linear in
    a person's rows and index dates.
    """
    events = outcomes.select(
        F.col("cohort_definition_id").cast("int").alias("outcome_id"),
        F.col("subject_id").alias("person_id"),
        F.col("cohort_start_date").alias("at"),
    )
    vax = F.when(~_is_general(), _next_vax())
    index = pop.select(
        *PERSON_KEY, "index_date", F.least(horizon(), F.date_sub(vax, 1)).alias("last_day")
    ).join(events.select("person_id", "outcome_id").distinct(), "person_id")
    # order within a day: the first mark, then outcome rows, then the second mark
    marks = F.inline(
        F.array(
            F.struct(F.col("index_date").alias("at"), F.lit(0).alias("kind")),
            F.struct(F.col("last_day").alias("at"), F.lit(2).alias("kind")),
        )
    )
    stream = events.withColumn("kind", F.lit(1)).unionByName(
        index.select(*PAIR, "person_id", marks), allowMissingColumns=True
    )
    own = Window.partitionBy("person_id", "outcome_id")
    forward = own.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backward = own.orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    event = F.when(F.col("kind") == 1, F.col("at"))
    seen = stream.withColumns(
        {
            "n_rows": F.count(event).over(own),
            "earliest": F.min(event).over(own),
            "so_far": F.count(event).over(forward),
            "before": F.max(event).over(forward),
            "after": F.min(event).over(backward),
        }
    ).where("kind <> 1")

    def at_mark(kind: int, name: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(name)))

    facts = seen.groupBy(*PAIR, "person_id").agg(
        F.max("n_rows").alias("n_rows"),
        F.max("earliest").alias("earliest"),
        at_mark(0, "at").alias("index_date"),
        at_mark(0, "before").alias("before"),
        (at_mark(2, "so_far") - at_mark(0, "so_far")).alias("followup_rows"),
        at_mark(0, "after").alias("after"),
    )
    year_before = F.add_months("index_date", -12)
    return facts.select(
        *PAIR,
        "person_id",
        "n_rows",
        F.coalesce(F.col("before") >= year_before, F.lit(False)).alias("washout"),
        (F.col("earliest") < year_before).alias("history"),
        "followup_rows",
        F.when(F.col("followup_rows") > 0, F.col("after")).alias("event_date"),
    )


def open_pairs(facts: DataFrame, minimum: int = 5) -> DataFrame:
    """Study cohort and outcome pairs with enough outcome rows, and enough in follow-up.

    At most study cohorts times outcomes rows.
    """
    return (
        facts.groupBy(*PAIR)
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum(F.when(~F.col("washout"), F.col("followup_rows")).otherwise(0)).alias("followup_rows"),
        )
        .where((F.col("n_rows") >= minimum) & (F.col("followup_rows") >= minimum))
    )


def censored_days(earliest: bool = False) -> Column:
    """Days at risk without the outcome: to the next vaccine, else end of observation, else horizon.

    A next vaccine within the horizon wins even over an earlier end of observation, unless the
    ``earliest`` of the three is asked for.
    """
    vax = F.when(~_is_general() & (_next_vax() < horizon()), _next_vax())
    observed = F.least(F.col("op_end"), horizon())
    end = F.least(vax, observed) if earliest else F.coalesce(vax, observed)
    return F.date_diff(end, F.col("index_date"))


def time_at_risk(pop: DataFrame, facts: DataFrame, pairs: DataFrame, earliest: bool = False) -> DataFrame:
    """One row per study cohort, outcome and person at risk: days, event flag, history flag.

    People with the outcome in the year before are left out.  This is the full table;
    the summaries below work from counts instead.
    """
    known = facts.select(*PAIR, "person_id", "washout", "history", "event_date")
    happened = F.col("event_date").isNotNull()
    return (
        pop.join(F.broadcast(pairs.select(*PAIR)), "study_id")
        .join(known, [*PAIR, "person_id"], "left")
        .where(~F.coalesce("washout", F.lit(False)))
        .withColumns(
            {
                "history_outcome": F.coalesce("history", F.lit(False)).cast("int"),
                "f_u_outcome": happened.cast("int"),
                "f_u_outcome_days": F.when(happened, F.date_diff("event_date", "index_date")).otherwise(
                    censored_days(earliest)
                ),
            }
        )
        .drop("washout", "history")
    )


def people_with_outcome(pop: DataFrame, facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Profiles of the people with an outcome in follow-up, for the open pairs."""
    cases = facts.where(~F.col("washout") & F.col("event_date").isNotNull())
    return cases.join(F.broadcast(pairs.select(*PAIR)), PAIR).select(
        *PAIR, "person_id", "event_date"
    ).join(pop, PERSON_KEY)


def count_cells(
    pop: DataFrame,
    facts: DataFrame,
    pairs: DataFrame,
    profile: dict[str, Column],
    by_day: bool = True,
    earliest: bool = False,
) -> DataFrame:
    """Counts of people at risk by profile, days at risk and event flag, per open pair.

    ``profile`` maps cell columns to expressions over the population.  People without
    outcome rows are counted once for all outcomes; people with washout or an event
    are then taken out of, or moved between, cells.  Without ``by_day`` all days at risk
    share a cell, with ``days`` 0.
    """
    names = list(profile)
    days, event_day = censored_days(earliest), F.date_diff("event_date", "index_date")
    if not by_day:
        days = event_day = F.lit(0)
    people = pop.select(
        *PERSON_KEY, "index_date", days.alias("days"), *(c.alias(n) for n, c in profile.items())
    )
    plain = people.groupBy("study_id", *names, "days").agg(F.count("*").alias("n"))
    for_all = plain.join(F.broadcast(pairs.select(*PAIR)), "study_id").select(
        *PAIR, *names, "days", F.lit(0).alias("event"), "n"
    )
    changed = (
        facts.where(F.col("washout") | F.col("event_date").isNotNull())
        .select(*PAIR, "person_id", "washout", "event_date")
        .join(F.broadcast(pairs.select(*PAIR)), PAIR)
        .join(people, PERSON_KEY)
    )
    moves = F.array(
        F.struct(F.col("days").alias("at"), F.lit(0).alias("event"), F.lit(-1).cast("long").alias("n")),
        F.struct(
            event_day.alias("at"),
            F.lit(1).alias("event"),
            F.lit(1).cast("long").alias("n"),
        ),
    )
    delta = (
        changed.withColumn("__moves", moves)
        .select(*PAIR, *names, "washout", F.inline("__moves"))
        .where("event = 0 OR NOT washout")
        .groupBy(*PAIR, *names, F.col("at").alias("days"), "event")
        .agg(F.sum("n").alias("n"))
    )
    return (
        for_all.unionByName(delta)
        .groupBy(*PAIR, *names, "days", "event")
        .agg(F.sum("n").alias("n"))
        .where("n > 0")
    )
