"""From events to cohort rows, for any number of cohorts at once.

All steps work on person-day rows (see ``compact_by_day``) and are keyed by person, so
on tables bucketed by person no step shuffles.  Counts of events in a window around an
index date come from a frame of days that runs along the person's days, not from joining index
events with events: the work stays linear for people with very long records.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window as W, functions as F

from cohortide.operators import eras, events as ev
from cohortide.plans.specs import CohortSpec, Criterion, criteria_of
from cohortide.sources.literals import literal_table
from cohortide.sources.cdm import Cdm
from cohortide.sources.workspace import Workspace, bucket_count, place

KEY = ["cohort_id", "person_id"]
EVENT_KEY = [*KEY, "start_date", "op_start", "op_end"]
INDEX_DAY = ["person_id", "start_date", "op_start", "op_end"]
#: Cohorts that a mask of asking cohorts holds.
MASKED = 62


def _limit_table(spark: SparkSession, specs: list[CohortSpec]) -> DataFrame:
    rows = [
        (
            s.id,
            s.prior_days,
            s.post_days,
            s.first_primary,
            s.first_qualified,
            s.first_included,
            (1 << len(s.rules)) - 1,
        )
        for s in specs
    ]
    return F.broadcast(
        literal_table(
            spark, rows,
            "cohort_id long, prior_days int, post_days int, first_primary boolean, "
            "first_qualified boolean, first_included boolean, full_mask long",
        )
    )


def _exit_table(spark: SparkSession, specs: list[CohortSpec]) -> DataFrame:
    rows = [(s.id, s.exit.kind, s.exit.days, s.exit.bound, s.pad) for s in specs]
    return F.broadcast(
        literal_table(
            spark, rows, "cohort_id long, exit_kind string, exit_days int, exit_bound string, pad int"
        )
    )


def _first_per_person(rows: DataFrame, flag: str, specs: list[CohortSpec]) -> DataFrame:
    """Keep the earliest row per person in cohorts whose ``flag`` is set.

    Ties on the day go to the earlier end, then the earlier observation period; the
    row then stands for a single event.
    """
    if not any(getattr(s, flag) for s in specs):
        return rows
    order = W.partitionBy(*KEY).orderBy("start_date", "min_end", "op_start", "op_end")
    ranked = rows.withColumn("__rank", F.row_number().over(order))
    kept = ranked.where(~F.col(flag) | (F.col("__rank") == 1)).drop("__rank")
    one = F.col(flag)
    return kept.withColumns(
        {
            "n": F.when(one, F.lit(1).cast("long")).otherwise(F.col("n")),
            "max_end": F.when(one, F.col("min_end")).otherwise(F.col("max_end")),
        }
    )


def inside_periods(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Attach rows with a ``start_date`` to every period of the person that contains it.

    Periods of a person that overlap form an island.  The latest island to begin is carried along in
    day order, so each row meets one island, and only the periods of that island are tried: the work is linear
    in days and periods, but for periods that overlap.
    """
    extra = [c for c in periods.columns if c != "person_id"]
    before = W.partitionBy("person_id").orderBy("op_start", "op_end")
    reach = F.max("op_end").over(before.rowsBetween(W.unboundedPreceding, -1))
    begins = F.when(F.coalesce(F.col("op_start") > reach, F.lit(True)), 1).otherwise(0)
    islands = (
        periods.withColumn("__begins", begins)
        .withColumn("__island", F.sum("__begins").over(before.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("person_id", "__island")
        .agg(F.min("op_start").alias("start_date"), F.collect_list(F.struct(*extra)).alias("__periods"))
        .drop("__island")
        .withColumn("__row", F.lit(0))
    )
    carried = rows.columns
    stream = rows.withColumn("__row", F.lit(1)).unionByName(islands, allowMissingColumns=True)
    behind = W.partitionBy("person_id").orderBy("start_date", "__row").rowsBetween(W.unboundedPreceding, 0)
    return (
        stream.withColumn("__periods", F.last("__periods", ignorenulls=True).over(behind))
        .where("__row = 1")
        .select(*carried, F.inline("__periods"))
        .where(F.col("start_date").between(F.col("op_start"), F.col("op_end")))
    )


def primary_events(cdm: Cdm, days: DataFrame, periods: DataFrame, specs: list[CohortSpec]) -> DataFrame:
    """Entry events inside an observation period: the person-day rows of each cohort.

    ``days`` are person-day rows by criterion, ``periods`` the compacted observation
    periods.  A day is attached to every period containing it, ``n`` counting the
    recorded events.
    """
    spark = cdm.spark
    ids = {c: i for i, c in enumerate(criteria_of(specs))}
    parts = []
    entry = [(s.id, ids[c]) for s in specs for c in s.entry]
    if entry:
        map_ = F.broadcast(literal_table(spark, entry, "cohort_id long, criterion_id int"))
        parts.append(
            days.join(map_, "criterion_id")
            .groupBy(*KEY, "start_date")
            .agg(F.sum("n").alias("n"), F.min("min_end").alias("min_end"), F.max("max_end").alias("max_end"))
        )
    covering = [(s.id, s.covering) for s in specs if s.covering]
    if covering:
        dates = F.array(
            *(F.struct(F.lit(i).cast("long").alias("cohort_id"), F.lit(d).alias("start_date")) for i, d in covering)
        )
        parts.append(
            periods.select("*", F.inline(dates))
            .where(F.col("start_date").between(F.col("op_start"), F.col("op_end")))
            .groupBy(*KEY, "start_date")
            .agg(F.sum("n_op").alias("n"))
            .select(
                *KEY,
                "start_date",
                "n",
                F.col("start_date").alias("min_end"),
                F.col("start_date").alias("max_end"),
            )
        )
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    observed = inside_periods(rows, periods).join(_limit_table(spark, specs), "cohort_id").where(
        (F.date_add("op_start", F.col("prior_days")) <= F.col("start_date"))
        & (F.date_add("start_date", F.col("post_days")) <= F.col("op_end"))
    )
    return observed.withColumn("n", F.col("n") * F.col("n_op")).drop("n_op", "prior_days", "post_days")


def qualified_events(cdm: Cdm, days: DataFrame, periods: DataFrame, specs: list[CohortSpec]) -> DataFrame:
    """Primary events after the first-event limits."""
    rows = primary_events(cdm, days, periods, specs)
    rows = _first_per_person(rows, "first_primary", specs)
    return _first_per_person(rows, "first_qualified", specs)


def numbered_events(events: DataFrame, periods: DataFrame) -> DataFrame:
    """Events of one cohort numbered per person by date, attached to their observation period.

    Same-day events are ordered by end date and period; identical ones share a row with
    their count, so numbers ``event_id .. event_id + n - 1`` belong to the row.
    """
    same = events.groupBy("person_id", "start_date", "end_date").agg(F.count("*").alias("n"))
    rows = inside_periods(same, periods)
    rows = rows.withColumn("n", F.col("n") * F.col("n_op")).drop("n_op")
    order = W.partitionBy("person_id").orderBy("start_date", "end_date", "op_start", "op_end")
    before = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("event_id", F.coalesce(before, F.lit(0)) + 1)


def _window_rules(spark: SparkSession, specs: list[CohortSpec], ids: dict[Criterion, int]) -> DataFrame | None:
    rows = [
        (
            s.id,
            r,
            k,
            ids[near.criterion],
            near.first,
            near.last,
            near.inside_period,
            near.at_least,
            near.exactly,
            rule.match == "any",
        )
        for s in specs
        for r, rule in enumerate(s.rules)
        for k, near in enumerate(rule.nearby)
    ]
    if not rows:
        return None
    return literal_table(
            spark, rows,
        "cohort_id long, rule_id int, part int, criterion_id int, first_day int, last_day int, "
        "inside_period boolean, at_least int, exactly int, match_any boolean",
    )


def _by_window(rules: DataFrame) -> list[list[Row]]:
    """Rule parts by their window of days, at most ``MASKED`` cohorts at a time; rules are declarations, so few."""
    windows: dict[tuple, list[Row]] = {}
    for r in rules.collect():
        windows.setdefault((r["first_day"], r["last_day"], r["inside_period"]), []).append(r)
    groups = []
    for parts in windows.values():
        cohorts = sorted({r["cohort_id"] for r in parts})
        for i in range(0, len(cohorts), MASKED):
            groups.append([r for r in parts if r["cohort_id"] in cohorts[i : i + MASKED]])
    return groups


def _window_counts(
    index: DataFrame, parts: list[Row], days: DataFrame, periods: DataFrame | None
) -> tuple[DataFrame, dict[int, int], dict[int, Column]]:
    """Events of each criterion in one window of days around the index days that ask for it.

    Cohorts share their index days: one row each, with the cohorts that ask as bits of ``asks``.  Events, a row per day with
    a column per criterion, are put in one stream with the index days, and a frame of days runs along it.  For windows inside
    the observation period, events are attached to the periods that contain them first, to those of the index days unless
    ``periods`` has all.  Also returns the bit of each cohort and the count of each criterion.
    """
    window = parts[0]
    bits = {c: i for i, c in enumerate(sorted({r["cohort_id"] for r in parts}))}
    names = {c: f"n_{i}" for i, c in enumerate(sorted({r["criterion_id"] for r in parts}))}
    cases = " ".join(f"WHEN {c} THEN {1 << i}L" for c, i in bits.items())
    asked = (
        index.where(F.col("cohort_id").isin(list(bits)))
        .groupBy(*INDEX_DAY)
        .agg(F.expr(f"bit_or(CASE cohort_id {cases} END) AS asks"))
    )
    facts = (
        days.where(F.col("criterion_id").isin(list(names)))
        .groupBy("person_id", "start_date")
        .agg(*(F.sum(F.when(F.col("criterion_id") == c, F.col("n"))).alias(name) for c, name in names.items()))
    )
    own = ["person_id"]
    if window["inside_period"]:
        if periods is None:
            periods = asked.select("person_id", "op_start", "op_end").distinct()
        facts = inside_periods(facts, periods.select("person_id", "op_start", "op_end"))
        own += ["op_start", "op_end"]
    first, last = window["first_day"], window["last_day"]
    around = W.partitionBy(*own).orderBy(F.unix_date("start_date")).rangeBetween(
        W.unboundedPreceding if first is None else first, W.unboundedFollowing if last is None else last
    )
    counted = (
        asked.unionByName(facts, allowMissingColumns=True)
        .withColumns({name: F.coalesce(F.sum(name).over(around), F.lit(0).cast("long")) for name in names.values()})
        .where("asks IS NOT NULL")
    )
    return counted, bits, {c: F.col(name) for c, name in names.items()}


def _asking(cohorts: int) -> Column:
    """The bits that are set in ``asks``, a row for each."""
    every = ", ".join(map(str, range(cohorts)))
    return F.expr(f"explode(filter(array({every}), b -> asks & shiftleft(1L, b) != 0)) AS bit")


def count_nearby(index: DataFrame, rules: DataFrame, days: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Number of events in each rule part's window: one row per index event and part."""
    part_columns = ["rule_id", "part", "at_least", "exactly", "match_any"]
    counted, table, most = [], [], 0
    for window, parts in enumerate(_by_window(rules)):
        rows, bits, counts = _window_counts(index, parts, days, periods)
        place_of = {c: i + 1 for i, c in enumerate(counts)}
        table += [
            (window, bits[r["cohort_id"]], r["cohort_id"], *(r[c] for c in part_columns), place_of[r["criterion_id"]])
            for r in parts
        ]
        most = max(most, len(bits))
        counted.append(rows.select(F.lit(window).alias("window"), *INDEX_DAY, "asks", F.array(*counts.values()).alias("counts")))
    stream = counted[0]
    for rows in counted[1:]:
        stream = stream.unionByName(rows)
    parts = literal_table(
        index.sparkSession, table,
        "window int, bit int, cohort_id long, rule_id int, part int, at_least int, exactly int, match_any boolean, at int",
    )
    # A row for each part is many times what is counted: dealt to more tasks, before they are made.
    return (
        stream.repartition(2 * bucket_count(index.sparkSession), "person_id")
        .select("window", *INDEX_DAY, "counts", _asking(most))
        .join(F.broadcast(parts), ["window", "bit"])
        .select(*EVENT_KEY, *part_columns, F.element_at("counts", F.col("at")).alias("n_events"))
    )


def rules_met(index: DataFrame, rules: DataFrame, days: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """(event key, rule_id) for the groups of nearby counts that hold.

    What a rule asks of one window is decided on the index day, once for all cohorts that ask the same; only what holds
    gets a row.  A rule holds when every window of its parts does, or any of them where any will do.
    """
    groups = _by_window(rules)
    windows = Counter(rule for parts in groups for rule in {(r["cohort_id"], r["rule_id"]) for r in parts})
    held = None
    for parts in groups:
        rows, bits, counts = _window_counts(index, parts, days, periods)
        own: dict[tuple, list[Row]] = {}
        for r in parts:
            own.setdefault((r["cohort_id"], r["rule_id"]), []).append(r)
        tests: dict[tuple, int] = {}
        table = []
        for (id, rule), group in own.items():
            any_of = group[0]["match_any"]
            test = (any_of, tuple(sorted({(r["criterion_id"], r["at_least"], r["exactly"]) for r in group}, key=repr)))
            at = tests.setdefault(test, len(tests) + 1)
            table.append((bits[id], id, rule, at, 1 if any_of else windows[(id, rule)]))
        verdicts = []
        for any_of, asked in tests:
            holds = [counts[c] >= least if exactly is None else counts[c] == exactly for c, least, exactly in asked]
            verdicts.append(reduce(or_ if any_of else and_, holds))
        asking = F.broadcast(
            literal_table(index.sparkSession, table, "bit int, cohort_id long, rule_id int, at int, needed int")
        )
        met = (
            rows.select(*INDEX_DAY, F.array(*verdicts).alias("verdicts"), _asking(len(bits)))
            .join(asking, "bit")
            .where(F.element_at("verdicts", F.col("at")))
            .select(*EVENT_KEY, "rule_id", "needed")
        )
        held = met if held is None else held.unionByName(met)
    return (
        held.groupBy(*EVENT_KEY, "rule_id")
        .agg(F.count("*").alias("held"), F.max("needed").alias("needed"))
        .where("held >= needed")
        .select(*EVENT_KEY, "rule_id")
    )


def _age_rules(cdm: Cdm, index: DataFrame, specs: list[CohortSpec]) -> DataFrame | None:
    rows = [(s.id, r, rule.min_age) for s in specs for r, rule in enumerate(s.rules) if rule.min_age is not None]
    if not rows:
        return None
    ages = F.broadcast(literal_table(cdm.spark, rows, "cohort_id long, rule_id int, min_age int"))
    born = cdm.person.select("person_id", "year_of_birth")
    return (
        index.join(ages, "cohort_id")
        .join(born, "person_id")
        .where(F.year("start_date") - F.col("year_of_birth") >= F.col("min_age"))
        .select(*EVENT_KEY, "rule_id")
    )


def _observation_rules(
    cdm: Cdm, index: DataFrame, periods: DataFrame, specs: list[CohortSpec]
) -> DataFrame | None:
    """A period starting early enough, long enough, that covers the index date."""
    rows = [
        (s.id, r, rule.observed_since, rule.observed_days)
        for s in specs
        for r, rule in enumerate(s.rules)
        if rule.observed_since
    ]
    if not rows:
        return None
    rules = F.broadcast(
        literal_table(cdm.spark, rows, "cohort_id long, rule_id int, since date, min_days int")
    )
    asked = index.join(rules, "cohort_id").alias("i")
    long_ones = ev.long_periods(periods, max(r[2] for r in rows), min(r[3] for r in rows)).alias("a")
    met = asked.join(
        long_ones,
        (F.col("i.person_id") == F.col("a.person_id"))
        & (F.col("a.op_start") < F.col("i.since"))
        & (F.date_diff("a.op_end", "a.op_start") >= F.col("i.min_days"))
        & F.col("a.op_start").between(F.col("i.op_start"), F.col("i.op_end"))
        & (F.col("a.op_start") <= F.date_sub("i.start_date", F.col("i.min_days")))
        & F.col("a.op_end").between(F.col("i.start_date"), F.col("i.op_end")),
        "left_semi",
    )
    return met.select(*EVENT_KEY, "rule_id")


def inclusion_hits(
    cdm: Cdm, index: DataFrame, days: DataFrame, periods: DataFrame, specs: list[CohortSpec]
) -> DataFrame | None:
    """(event key, rule_id) of every rule met, all kinds of rules together."""
    ids = {c: i for i, c in enumerate(criteria_of(specs))}
    rules = _window_rules(cdm.spark, specs, ids)
    parts = [
        rules_met(index, rules, days, periods) if rules is not None else None,
        _age_rules(cdm, index, specs),
        _observation_rules(cdm, index, periods, specs),
    ]
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    return hits


def with_mask(index: DataFrame, hits: DataFrame | None) -> DataFrame:
    """Add ``mask``: bit r is set when inclusion rule r holds; 0 without rules."""
    if hits is None:
        return index.withColumn("mask", F.lit(0).cast("long"))
    carried = [c for c in index.columns if c not in EVENT_KEY]
    bits = hits.select(*EVENT_KEY, F.expr("shiftleft(1L, rule_id)").alias("mask"))
    index = index.withColumn("mask", F.lit(0).cast("long"))
    # events of cohorts without rules are done
    rows = index.where("full_mask != 0").unionByName(bits, allowMissingColumns=True)
    ruled = place(rows).groupBy(*EVENT_KEY).agg(
        F.bit_or("mask").alias("mask"), *(F.max(c).alias(c) for c in carried)
    )
    return place(ruled.unionByName(index.where("full_mask = 0")))


def included_events(masked: DataFrame, specs: list[CohortSpec]) -> DataFrame:
    """Events meeting every rule, the first per person where the cohort says so."""
    return _first_per_person(masked.where("mask = full_mask"), "first_included", specs)


def next_event_day(index: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """Add the first fact day strictly after ``start_date``, per cohort and person."""
    carried = index.columns
    stream = index.withColumns({"day": F.col("start_date"), "is_fact": F.lit(0)}).unionByName(
        facts.select(*KEY, F.col("start_date").alias("day")).withColumn("is_fact", F.lit(1)),
        allowMissingColumns=True,
    )
    # Latest day first, and a fact on the index day after the index event: the rows
    # already passed are exactly the later days.
    later = W.partitionBy(*KEY).orderBy(F.desc("day"), "is_fact").rowsBetween(W.unboundedPreceding, 0)
    fact_day = F.when(F.col("is_fact") == 1, F.col("day"))
    return (
        stream.withColumn(column, F.min(fact_day).over(later)).where("is_fact = 0").select(*carried, column)
    )


def covering_era_end(index: DataFrame, spans: DataFrame, column: str) -> DataFrame:
    """Add the end of the era that covers ``start_date``; eras of a person are disjoint."""
    carried = index.columns
    stream = index.withColumns({"day": F.col("start_date"), "is_index": F.lit(1)}).unionByName(
        spans.select(*KEY, F.col("start_date").alias("day"), F.col("end_date").alias("__end")).withColumn(
            "is_index", F.lit(0)
        ),
        allowMissingColumns=True,
    )
    behind = W.partitionBy(*KEY).orderBy("day", "is_index").rowsBetween(W.unboundedPreceding, 0)
    last_end = F.last("__end", ignorenulls=True).over(behind)
    covered = F.when(F.col("__last") >= F.col("start_date"), F.col("__last"))
    return (
        stream.withColumn("__last", last_end)
        .where("is_index = 1")
        .withColumn(column, covered)
        .select(*carried, column)
    )


def strategy_end() -> Column:
    """End date by offset, from the columns of the exit table."""
    start, end = F.col("start_date"), F.col("max_end")
    moved = F.date_add(F.when(F.col("exit_kind") == "start", start).otherwise(end), F.col("exit_days"))
    bounded = F.when(F.col("exit_bound") == "period", F.least(moved, F.col("op_end"))).otherwise(
        F.greatest(moved, start)
    )
    return F.when(F.col("exit_kind").isin("start", "end"), bounded).otherwise(F.col("op_end"))


def cohort_intervals(cdm: Cdm, included: DataFrame, days: DataFrame, specs: list[CohortSpec]) -> DataFrame:
    """Start and earliest valid end of every included event.

    Only cohorts with drug eras or censoring are lined up with those events; the rest
    take their end from the row itself.
    """
    spark = cdm.spark
    ids = {c: i for i, c in enumerate(criteria_of(specs))}
    exits = _exit_table(spark, specs)

    def finish(rows: DataFrame, ends: list[Column]) -> DataFrame:
        valid = [F.when(e >= F.col("start_date"), e) for e in ends]
        earliest = F.least(*valid) if len(valid) > 1 else valid[0]
        return (
            rows.withColumn("end_date", earliest)
            .where(F.col("end_date").isNotNull())
            .select(*KEY, "start_date", "end_date", "pad")
        )

    def of(chosen: list[CohortSpec]) -> DataFrame:
        rows = included
        if len(chosen) < len(specs):
            rows = rows.where(F.col("cohort_id").isin([s.id for s in chosen]))
        return rows.join(exits, "cohort_id")

    parts = []
    plain = [s for s in specs if s.exit.kind != "era" and not s.censor]
    if plain:
        parts.append(finish(of(plain), [strategy_end()]))
    other = [s for s in specs if s not in plain]
    if other:
        rows, ends = of(other), [strategy_end()]
        eras_for = [
            (s.id, ids[Criterion("drug_exposure", s.exit.era_codeset, concept)], s.exit.era_gap)
            for s in other
            if s.exit.kind == "era"
            for concept in ("standard", "source")
        ]
        if eras_for:
            map_ = F.broadcast(literal_table(spark, eras_for, "cohort_id long, criterion_id int, gap int"))
            used = days.join(map_, "criterion_id").select(
                *KEY, "start_date", F.col("max_end").alias("end_date"), "gap"
            )
            rows = covering_era_end(rows, eras.collapse(used, KEY, F.col("gap")), "era_end")
            ends.append(F.col("era_end"))
        censors = [(s.id, ids[c]) for s in other for c in s.censor]
        if censors:
            map_ = F.broadcast(literal_table(spark, censors, "cohort_id long, criterion_id int"))
            facts = days.join(map_, "criterion_id").select(*KEY, "start_date").distinct()
            rows = next_event_day(rows, facts, "censor_day")
            ends.append(F.when(F.col("censor_day") <= F.col("op_end"), F.col("censor_day")))
        parts.append(finish(rows, ends))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def as_cohort_rows(spans: DataFrame) -> DataFrame:
    return spans.select(
        F.col("cohort_id").alias("cohort_definition_id"),
        F.col("person_id").alias("subject_id"),
        F.col("start_date").alias("cohort_start_date"),
        F.col("end_date").alias("cohort_end_date"),
    )


def as_stored(cohorts: DataFrame) -> DataFrame:
    """Stored cohort rows in the types that the builder gives."""
    return cohorts.select(
        F.col("cohort_definition_id").cast("long").alias("cohort_definition_id"),
        "subject_id",
        "cohort_start_date",
        "cohort_end_date",
    )


def person_days(
    cdm: Cdm, codesets: DataFrame, specs: list[CohortSpec], work: Workspace | None = None, name: str = "days"
) -> DataFrame:
    """Person-day rows of all criteria the specs use, kept by person when a workspace is given."""
    criteria = criteria_of(specs)
    if not criteria:
        return literal_table(
            cdm.spark, [],
            "criterion_id int, person_id long, start_date date, n long, min_end date, max_end date",
        )
    parts = ev.extract_days(cdm, codesets, criteria)
    # written one by one, so that the shuffles of one clinical table at a time are on disk
    return reduce(DataFrame.unionByName, [work.keep(part, name) for part in parts] if work else parts)


def masked_events(
    cdm: Cdm, days: DataFrame, periods: DataFrame, specs: list[CohortSpec], work: Workspace | None = None
) -> DataFrame:
    """Qualified events with the bit mask of the inclusion rules they meet."""
    index = qualified_events(cdm, days, periods, specs)
    if any(s.rules for s in specs) and work:
        index = work.keep(index, "qualified")
    return with_mask(index, inclusion_hits(cdm, index, days, periods, specs))


def build_cohorts(
    cdm: Cdm,
    codesets: DataFrame,
    specs: list[CohortSpec],
    work: Workspace | None = None,
    periods: DataFrame | None = None,
    days: DataFrame | None = None,
) -> DataFrame:
    """Cohort rows of all specs: one scan per clinical table, one pass over each person.

    Give a workspace to keep the person-day rows (used by entry, rules and censoring)
    instead of deriving them again for each use.
    """
    if periods is None:
        periods = ev.compact_periods(cdm.observation_period)
        periods = work.keep(periods, "periods") if work else periods
    if days is None:
        days = person_days(cdm, codesets, specs, work)
    masked = masked_events(cdm, days, periods, specs, work)
    spans = cohort_intervals(cdm, included_events(masked, specs), days, specs)
    return as_cohort_rows(eras.collapse(spans, KEY, F.col("pad")))


def enough_rows(cohorts: DataFrame, more_than: int = 5) -> DataFrame:
    """Cohorts with more than ``more_than`` rows: (cohort_definition_id, n)."""
    return (
        cohorts.groupBy("cohort_definition_id").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    )
