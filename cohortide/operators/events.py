"""Clinical rows to events: one scan per clinical table, whatever the number of criteria."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from cohortide.plans.specs import Criterion
from cohortide.sources.literals import literal_table
from cohortide.sources.cdm import Cdm
from cohortide.sources.workspace import BROADCAST_ROWS, broadcast_checked, place

#: Codes that are listed for the reader one by one, and ranges that cover them in any case.
LISTED, TILES = 1000, 16

#: Criteria that a mask holds.
MASKED = 62


def drug_end() -> Column:
    """Recorded end, else start plus days of supply, else the next day."""
    start = F.col("drug_exposure_start_date")
    return F.coalesce(
        F.col("drug_exposure_end_date"), F.date_add(start, F.col("days_supply")), F.date_add(start, 1)
    )


def _domain_rows(cdm: Cdm, domain: str) -> DataFrame:
    """(person_id, start_date, end_date, standard, source, value columns) of one table."""
    none_long, none_int, none_double = (F.lit(None).cast(t) for t in ("long", "int", "double"))
    if domain == "drug_exposure":
        return cdm.drug_exposure.select(
            "person_id",
            F.col("drug_exposure_start_date").alias("start_date"),
            drug_end().alias("end_date"),
            F.col("drug_concept_id").alias("standard"),
            F.col("drug_source_concept_id").alias("source"),
            none_double.alias("value"),
            none_int.alias("unit"),
            none_int.alias("value_concept"),
        )
    if domain == "observation":
        return cdm.observation.select(
            "person_id",
            F.col("observation_date").alias("start_date"),
            F.date_add("observation_date", 1).alias("end_date"),
            F.col("observation_concept_id").alias("standard"),
            F.col("observation_source_concept_id").alias("source"),
            none_double.alias("value"),
            none_int.alias("unit"),
            F.col("value_as_concept_id").alias("value_concept"),
        )
    if domain == "condition_occurrence":
        return cdm.condition_occurrence.select(
            "person_id",
            F.col("condition_start_date").alias("start_date"),
            F.coalesce("condition_end_date", F.date_add("condition_start_date", 1)).alias("end_date"),
            F.col("condition_concept_id").alias("standard"),
            none_long.alias("source"),
            none_double.alias("value"),
            none_int.alias("unit"),
            none_int.alias("value_concept"),
        )
    return cdm.measurement.select(
        "person_id",
        F.col("measurement_date").alias("start_date"),
        F.date_add("measurement_date", 1).alias("end_date"),
        F.col("measurement_concept_id").alias("standard"),
        none_long.alias("source"),
        F.col("value_as_number").alias("value"),
        F.col("unit_concept_id").alias("unit"),
        F.col("value_as_concept_id").alias("value_concept"),
    )


def _wanted_codes(lookup: DataFrame, most: int = LISTED, tiles: int = TILES) -> list[Row]:
    """Of each domain, kind of code and date bound: the wanted codes in at most ``tiles`` ranges, with their list as
    long as all of them are at most ``most``.  What reaches the driver has a bound, however many codes are wanted.
    A code counts where its earliest bound is: a row that meets a later one meets that, too.
    """
    group = ["domain", "concept", "bound"]
    bound = F.when(F.bool_and(F.col("bound").isNotNull()), F.min("bound")).alias("bound")
    codes = lookup.groupBy("domain", "concept", "concept_id").agg(bound)
    order = Window.partitionBy(*group).orderBy("concept_id")
    codes = codes.withColumns({"at": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy(*group))})
    codes = codes.withColumn("tile", F.floor(F.col("at") * tiles / F.col("n")))
    ranges = codes.groupBy(*group, "n", "tile").agg(F.min("concept_id").alias("lo"), F.max("concept_id").alias("hi"), F.collect_list("concept_id").alias("codes"))
    return ranges.withColumn("codes", F.when(F.col("n") <= most, F.col("codes"))).collect()


def _reader_test(wanted: list[Row], domain: str) -> Column:
    """Rows that some criterion may want, for the parquet reader: the code is listed and in a range of wanted codes, and the
    date not before the bound of the criteria with that code."""
    test = F.lit(False)
    groups: dict[tuple, list[Row]] = {}
    for r in sorted((r for r in wanted if r["domain"] == domain), key=lambda r: (r["concept"], str(r["bound"]), r["tile"])):
        groups.setdefault((r["concept"], r["bound"]), []).append(r)
    for (column, bound), ranges in groups.items():
        own = F.lit(False)
        for r in ranges:
            own = own | F.col(column).between(r["lo"], r["hi"])
        if ranges[0]["codes"] is not None:
            own = F.col(column).isin([c for r in ranges for c in r["codes"]]) & own
        test = test | (own if bound is None else (F.col("start_date") >= F.lit(bound)) & own)
    return test


def _test(c: Criterion) -> Column | None:
    """What a row has to meet besides its code."""
    tests = []
    if c.after:
        tests.append(F.col("start_date") > F.lit(c.after))
    if c.not_before:
        tests.append(F.col("start_date") >= F.lit(c.not_before))
    if c.value_min is not None:
        tests.append(F.col("value") >= F.lit(c.value_min))
    if c.value_max is not None:
        tests.append(F.col("value") <= F.lit(c.value_max))
    if c.units:
        tests.append(F.col("unit").isin(list(c.units)))
    if c.value_concepts:
        tests.append(F.col("value_concept").isin(list(c.value_concepts)))
    return reduce(and_, tests) if tests else None


def _marked(cdm: Cdm, codesets: DataFrame, criteria: list[Criterion]) -> Iterator[tuple[DataFrame, list[str], dict[int, tuple]]]:
    """Of each domain: (person_id, start_date, end_date, masks), one row per clinical row that some criterion wants.

    The criteria become a lookup table by code, whose masks have a bit for each criterion; joined to a single scan of the
    clinical table, a row has the bits of all criteria that want it, by one kind of code or another.  Which codes are wanted,
    and from which date on, reaches the reader.  With each: the names of the masks, ``MASKED`` criteria in one, and
    the mask and bit of each criterion.
    """
    rows = [(i, c.domain, c.concept, c.codeset, c.after, c.not_before) for i, c in enumerate(criteria)]
    table = F.broadcast(
        literal_table(
            cdm.spark, rows,
            "criterion_id int, domain string, concept string, codeset string, after date, not_before date",
        )
    )
    lookup = codesets.join(table, "codeset").drop("codeset")
    codes = lookup.select("domain", "concept", "concept_id").distinct().groupBy("domain", "concept").count()
    large = {(r["domain"], r["concept"]) for r in codes.collect() if r["count"] > BROADCAST_ROWS}
    wanted_codes = _wanted_codes(lookup.withColumn("bound", F.coalesce("after", "not_before")))
    for domain in dict.fromkeys(c.domain for c in criteria):
        own = [i for i, c in enumerate(criteria) if c.domain == domain]
        bits = {i: (f"mask_{at // MASKED}", at % MASKED) for at, i in enumerate(own)}
        masks = list(dict.fromkeys(m for m, _ in bits.values()))
        base = _domain_rows(cdm, domain)
        base = base.where(_reader_test(wanted_codes, domain))
        found: dict[str, list[Column]] = {m: [] for m in masks}
        kinds = list(dict.fromkeys(criteria[i].concept for i in own))
        if len(kinds) == 1:
            base = base.where(F.col(kinds[0]).isNotNull())
        for kind in kinds:
            of_kind = [i for i in own if criteria[i].concept == kind]
            words = []
            for m in masks:
                cases = " ".join(f"WHEN {i} THEN {1 << bits[i][1]}L" for i in of_kind if bits[i][0] == m)
                words.append(F.expr(f"bit_or(CASE criterion_id {cases or 'WHEN -1 THEN 0L'} ELSE 0L END) AS __{kind}_{m}"))
            wanted = (
                lookup.where((F.col("domain") == domain) & (F.col("concept") == kind))
                .groupBy(F.col("concept_id").alias(f"__{kind}"))
                .agg(*words)
            )
            if (domain, kind) not in large:
                wanted = F.broadcast(wanted)
            base = base.join(wanted, F.col(kind) == F.col(f"__{kind}"), "inner" if len(kinds) == 1 else "left")
            for m in masks:
                found[m].append(F.coalesce(F.col(f"__{kind}_{m}"), F.lit(0).cast("long")))
        columns = {m: reduce(lambda x, y: x.bitwiseOR(y), found[m]) for m in masks}
        alike: dict[tuple, list[int]] = {}  # criteria of the same test
        for i in own:
            c = criteria[i]
            alike.setdefault((c.after, c.not_before, c.value_min, c.value_max, c.units, c.value_concepts), []).append(i)
        for same in alike.values():
            test = _test(criteria[same[0]])
            if test is None:
                continue
            for m in masks:
                failed = sum(1 << bits[i][1] for i in same if bits[i][0] == m)
                if failed:
                    columns[m] = columns[m].bitwiseAND(F.when(test, F.lit(-1).cast("long")).otherwise(F.lit(~failed).cast("long")))
        hit = base.select("person_id", "start_date", "end_date", *(c.alias(m) for m, c in columns.items()))
        yield hit.where(reduce(or_, [F.col(m) != 0 for m in masks])), masks, bits


def _criteria_in(bits: dict[int, tuple]) -> Column:
    """The criteria whose bits are set, a row for each."""
    pairs = ", ".join(f"CASE WHEN {m} & {1 << at}L != 0 THEN {i} END" for i, (m, at) in bits.items())
    return F.expr(f"explode(array_compact(array({pairs}))) AS criterion_id")


def extract_events(cdm: Cdm, codesets: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """(criterion_id, person_id, start_date, end_date), one row per clinical row and criterion.

    A clinical row matching several criteria appears once for each, from a single scan of the table.
    """
    parts = [
        rows.select(_criteria_in(bits), "person_id", "start_date", "end_date")
        for rows, _, bits in _marked(cdm, codesets, criteria)
    ]
    return reduce(DataFrame.unionByName, parts)


def extract_days(cdm: Cdm, codesets: DataFrame, criteria: list[Criterion]) -> list[DataFrame]:
    """``compact_by_day`` of the events of criteria, by criterion and placed by person: a table for each domain.

    Rows are combined and shuffled with the set of criteria that want them, and get a row for each criterion
    only where they end up.
    """
    parts = []
    for rows, masks, bits in _marked(cdm, codesets, criteria):
        placed = place(compact_by_day(rows, *masks))
        days = placed.select(_criteria_in(bits), "person_id", "start_date", "n", "min_end", "max_end")
        parts.append(
            days.groupBy("criterion_id", "person_id", "start_date")
            .agg(F.sum("n").alias("n"), F.min("min_end").alias("min_end"), F.max("max_end").alias("max_end"))
        )
    return parts


def compact_by_day(events: DataFrame, *keys: str) -> DataFrame:
    """One row per key, person and start day: count, earliest and latest end.

    Cohort logic only looks at days, so nothing is lost, and one person can hold at
    most as many rows as there are days on record however many raw rows there were.
    The aggregate combines before the shuffle, so a person with a large share of all
    rows does not make a large task here or later.
    """
    return events.groupBy(*keys, "person_id", "start_date").agg(
        F.count("*").alias("n"), F.min("end_date").alias("min_end"), F.max("end_date").alias("max_end")
    )


def code_list_rows(rows: DataFrame, code_column: str, date_column: str, members: DataFrame) -> DataFrame:
    """(person_id, event_date) of rows whose code is on a list, with the list's columns."""
    listed = broadcast_checked(members.withColumnRenamed("concept_id", code_column))
    extra = [c for c in members.columns if c != "concept_id"]
    return rows.join(listed, code_column).select(*extra, "person_id", F.col(date_column).alias("event_date"))


def code_list_events(
    rows: DataFrame, code_column: str, date_column: str, members: DataFrame, people: DataFrame | None = None
) -> DataFrame:
    """Distinct (code, person_id, event_date) for code lists, restricted to given people."""
    hits = code_list_rows(rows, code_column, date_column, members).distinct()
    if people is not None:
        hits = hits.join(people.select("person_id"), "person_id", "left_semi")
    return hits


def compact_periods(observation_period: DataFrame) -> DataFrame:
    """Distinct observation periods of each person, with how often each is recorded."""
    return observation_period.groupBy(
        "person_id",
        F.col("observation_period_start_date").alias("op_start"),
        F.col("observation_period_end_date").alias("op_end"),
    ).agg(F.count("*").alias("n_op"))


def long_periods(periods: DataFrame, since: dt.date, min_days: int = 365) -> DataFrame:
    """Observation periods that start before a date and last at least ``min_days``."""
    return periods.where(
        (F.col("op_start") < F.lit(since)) & (F.date_diff("op_end", "op_start") >= min_days)
    )
