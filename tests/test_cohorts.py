from __future__ import annotations

from table_rows import day, rows

from cohortide.operators import attrition, cohort, events
from cohortide.plans import definitions as d
from cohortide.plans.specs import CohortSpec, Criterion, Exit, Nearby, Rule, criteria_of
from cohortide.sources.literals import literal_table

PERIOD = [(i, i, "2015-01-01", "2022-12-31") for i in range(1, 12)]
PEOPLE = [(i, 8507, 1960, 1, 1) for i in range(1, 12)]
CONDITION = Criterion("condition_occurrence", "c")


def build(cdm, codes, *specs):
    return rows(cohort.build_cohorts(cdm, codes, list(specs)).drop("cohort_definition_id"))


def vaccines(codes_of):
    sets = {"vaccine_AZ": [1], "vaccine_pfizer": [2], "vaccine_moderna": [3], "vaccine_janssen": [4]}
    sets |= {"vaccine_any": [1, 2, 3, 4], "vaccine_mrna": [2, 3], "vaccine_vector": [1, 4]}
    sets |= {"vaccine_not_AZ": [2, 3, 4], "vaccine_not_pfizer": [1, 3, 4], "vaccine_not_moderna": [1, 2, 4]}
    return codes_of(**sets)


def spec(id):
    return next(s for s in d.exposure_specs() + d.outcome_specs() + d.covid_specs() if s.id == id)


def test_second_dose_window(cdm_of, codes_of):
    """Earlier dose at -180 and -14 days counts; at -181 and -13 it does not."""
    first = {1: "2021-01-01", 2: "2020-12-31", 3: "2021-06-16", 4: "2021-06-17"}
    cdm = cdm_of(
        person=PEOPLE,
        observation_period=PERIOD,
        drug_exposure=[(p, p, 1, None, s) for p, s in first.items()]
        + [(10 + p, p, 2, None, "2021-06-30") for p in first],
    )
    got = build(cdm, vaccines(codes_of), spec(204))
    assert [g[0] for g in got] == [1, 3]
    assert got[0][1:] == (day("2021-06-30"), day("2021-07-28"))
    mixed = build(cdm, vaccines(codes_of), spec(205))
    assert [g[0] for g in mixed] == [1, 3]


def test_first_dose_needs_no_earlier_vaccine_and_is_censored(cdm_of, codes_of):
    cdm = cdm_of(
        person=[*PEOPLE[:5], (6, 8507, 2010, 1, 1), *PEOPLE[6:]],
        observation_period=PERIOD[:7] + [(8, 8, "2019-12-15", "2022-12-31"), (9, 9, "2015-01-01", "2021-03-10")],
        drug_exposure=[
            (1, 1, 2, None, "2021-03-01"),
            (2, 2, 2, None, "2021-03-01"),
            (3, 2, 1, None, "2021-02-28"),  # other brand the day before
            (4, 3, 2, None, "2021-03-01"),
            (5, 3, 3, None, "2021-03-01"),  # same day does not exclude or censor
            (6, 4, 2, None, "2021-03-01"),
            (7, 4, 1, None, "2021-03-02"),  # next vaccine ends the cohort
            (8, 5, 99, 2, "2021-03-01"),  # by source code
            (9, 6, 2, None, "2021-03-01"),  # a child
            (10, 7, 2, None, "2020-12-01"),  # not after the start of vaccination
            (11, 8, 2, None, "2021-03-01"),  # observed too late
            (12, 9, 2, None, "2021-03-01"),  # observation ends first
        ],
        observation=[(1, 10, 2, None, "2021-03-01")],
    )
    got = build(cdm, vaccines(codes_of), spec(102))
    start = day("2021-03-01")
    assert got == [
        (1, start, day("2021-03-29")),
        (3, start, day("2021-03-29")),
        (4, start, day("2021-03-02")),
        (5, start, day("2021-03-29")),
        (9, start, day("2021-03-10")),
    ]


def test_drug_codes_look_past_the_observation_period(cdm_of, codes_of):
    """Only the first of the four "none before" checks ignores the period."""
    cdm = cdm_of(
        person=PEOPLE,
        observation_period=PERIOD,
        drug_exposure=[
            (1, 1, 2, None, "2021-03-01"),
            (2, 1, 1, None, "2014-01-01"),  # standard code, before the period: excludes
            (3, 2, 2, None, "2021-03-01"),
            (4, 2, 99, 1, "2014-01-01"),  # source code, before the period: ignored
        ],
    )
    assert [g[0] for g in build(cdm, vaccines(codes_of), spec(102))] == [2]


def test_exits_and_pads(cdm_of, codes_of):
    cdm = cdm_of(
        observation_period=[(1, 1, "2020-01-01", "2020-12-31")],
        condition_occurrence=[
            (1, 1, 7, "2020-03-01", "2020-03-05"),
            (2, 1, 7, "2020-04-05", None),
            (3, 1, 7, "2020-12-31", "2021-02-01"),
        ],
    )
    codes = codes_of(c=[7])

    def run(exit, pad=0):
        return [(s.isoformat(), e.isoformat()) for _, s, e in build(cdm, codes, CohortSpec(1, "x", (CONDITION,), exit=exit, pad=pad))]

    assert run(Exit("start", 28)) == [
        ("2020-03-01", "2020-03-29"), ("2020-04-05", "2020-05-03"), ("2020-12-31", "2020-12-31")]
    assert run(Exit("end", 1)) == [
        ("2020-03-01", "2020-03-06"), ("2020-04-05", "2020-04-07"), ("2020-12-31", "2020-12-31")]
    assert run(Exit("end", 1, "start"))[-1] == ("2020-12-31", "2021-02-02")
    assert run(Exit("end", 1), pad=30)[0] == ("2020-03-01", "2020-04-07")
    assert run(Exit("period")) == [("2020-03-01", "2020-12-31")]
    assert run(Exit("start", 0, "start"), pad=30)[0] == ("2020-03-01", "2020-03-01")


def test_drug_era_exit(cdm_of, codes_of):
    cdm = cdm_of(
        observation_period=[(1, 1, "2019-01-01", "2021-12-31")],
        drug_exposure=[
            (1, 1, 10, None, "2019-02-01", "2019-02-10"),
            (2, 1, 10, None, "2019-03-12", "2019-03-20"),  # 30 days later: same era
            (3, 1, 99, 10, "2019-04-01", "2019-04-10"),  # by source code extends the era
            (4, 1, 10, None, "2020-01-01", "2020-01-05"),
        ],
    )
    got = build(cdm, codes_of(k=[10]), d.drug_template(1, "k", "k"))
    assert got == [(1, day("2019-02-01"), day("2019-04-10")), (1, day("2020-01-01"), day("2020-01-05"))]


def test_covering_date_and_first_only(cdm_of, codes_of):
    cdm = cdm_of(
        observation_period=[
            (1, 1, "2016-01-01", "2017-06-30"),
            (2, 2, "2017-01-01", "2020-12-31"),
            (3, 3, "2017-01-02", "2020-12-31"),
        ],
        condition_occurrence=[(1, 2, 9, "2018-05-01"), (2, 2, 9, "2018-04-01"), (3, 3, 9, "2016-01-01")],
    )
    codes = codes_of(covid_diagnosis=[9])
    assert build(cdm, codes, spec(301)) == [
        (1, day("2017-01-01"), day("2017-06-30")),
        (2, day("2017-01-01"), day("2017-12-31")),
    ]
    assert build(cdm, codes, spec(1)) == [(2, day("2018-04-01"), day("2020-12-31"))]


def test_two_periods_and_many_copies(cdm_of, codes_of):
    """Events outside every period drop out; copies of an event count but do not multiply eras."""
    cdm = cdm_of(
        observation_period=[(1, 1, "2020-01-01", "2020-01-31"), (2, 1, "2020-06-01", "2020-06-30")],
        condition_occurrence=[(i, 1, 7, "2020-01-10", f"2020-01-{11 + i % 3}") for i in range(9)]
        + [(20, 1, 7, "2020-03-01"), (21, 1, 7, "2020-06-01")],
    )
    s = CohortSpec(1, "x", (CONDITION,), exit=Exit("end", 0))
    codes = codes_of(c=[7])
    assert build(cdm, codes, s) == [
        (1, day("2020-01-10"), day("2020-01-13")),
        (1, day("2020-06-01"), day("2020-06-02")),
    ]
    numbered = cohort.numbered_events(
        events.extract_events(cdm, codes, [CONDITION]), events.compact_periods(cdm.observation_period)
    )
    assert rows(numbered.select("event_id", "n")) == [(1, 3), (4, 3), (7, 3), (10, 1)]


def test_nearby_counts_at_least_two(cdm_of, codes_of):
    cdm = cdm_of(
        observation_period=[(p, p, "2020-01-01", "2020-12-31") for p in (1, 2)],
        condition_occurrence=[(p, p, 7, "2020-05-11") for p in (1, 2)]
        + [(10, 1, 8, "2020-05-01"), (11, 1, 8, "2020-05-21"), (12, 2, 8, "2020-04-30"), (13, 2, 8, "2020-05-21")],
    )
    near = Nearby(Criterion("condition_occurrence", "k"), -10, 10, at_least=2)
    s = CohortSpec(1, "x", (CONDITION,), rules=(Rule("two", (near,)),))
    assert [g[0] for g in build(cdm, codes_of(c=[7], k=[8]), s)] == [1]


def test_attrition(cdm_of, codes_of):
    cdm = cdm_of(
        person=[(1, 8507, 1960), (2, 8507, 2015), (3, 8507, 1960)],
        observation_period=[(p, p, "2020-01-01", "2020-12-31") for p in (1, 2, 3)],
        condition_occurrence=[(1, 1, 7, "2020-05-01"), (2, 1, 7, "2020-06-01"), (3, 2, 7, "2020-05-01"), (4, 3, 7, "2020-05-01")],
        observation=[(1, 1, 8, None, "2020-05-31"), (2, 2, 8, None, "2020-05-01")],
    )
    near = Nearby(Criterion("observation", "k"), -5, 5)
    s = CohortSpec(1, "x", (CONDITION,), rules=(Rule("near", (near,)), Rule("adult", min_age=18)))
    codes = codes_of(c=[7], k=[8])
    periods = events.compact_periods(cdm.observation_period)
    days = cohort.person_days(cdm, codes, [s])
    masked = cohort.masked_events(cdm, days, periods, [s])
    counts = attrition.mask_counts(masked)
    assert rows(counts.select("mode_id", "inclusion_rule_mask", "person_count")) == [
        (0, 1, 1), (0, 2, 2), (0, 3, 1), (1, 1, 1), (1, 2, 1), (1, 3, 1)]
    stats = attrition.rule_statistics(counts, [s]).select("mode_id", "rule_sequence", "person_count", "gain_count", "person_total")
    assert rows(stats) == [(0, 0, 2, 2, 4), (0, 1, 3, 1, 4), (1, 0, 2, 1, 3), (1, 1, 2, 1, 3)]
    assert rows(attrition.summary_statistics(counts, [s])) == [(1, 0, 4, 1), (1, 1, 3, 1)]


def test_long_record_of_one_person(spark, cdm_of, codes_of):
    """One person holds a third of all rows; the counts still match a direct count."""
    raw = spark.range(9_000).selectExpr(
        "id AS condition_occurrence_id",
        "CASE WHEN id % 3 = 0 THEN 1L ELSE 2 + id % 200 END AS person_id",
        "CASE WHEN id % 2 = 0 THEN 7L ELSE 8L END AS condition_concept_id",
        "date_add(DATE'2016-01-01', CAST((id * 37) % 700 AS INT)) AS condition_start_date",
        "CAST(NULL AS DATE) AS condition_end_date",
        "CAST(NULL AS BIGINT) AS visit_occurrence_id",
    )
    base = cdm_of(observation_period=[(p, p, "2016-01-01", "2017-12-31") for p in range(1, 203)])
    cdm = type(base)(**{**base.__dict__, "condition_occurrence": raw})
    near = Nearby(Criterion("condition_occurrence", "k"), -30, -1)
    s = CohortSpec(1, "x", (CONDITION,), rules=(Rule("before", (near,)),))
    codes = codes_of(c=[7], k=[8])
    days = cohort.person_days(cdm, codes, [s])
    periods = events.compact_periods(cdm.observation_period)
    index = cohort.qualified_events(cdm, days, periods, [s])
    rules = cohort._window_rules(spark, [s], {c: i for i, c in enumerate(criteria_of([s]))})
    got = {(r.person_id, r.start_date): r.n_events for r in cohort.count_nearby(index, rules, days).collect()}
    facts: dict = {}
    for r in raw.collect():
        facts.setdefault((r.person_id, r.condition_concept_id), []).append(r.condition_start_date)
    for (person, code), dates in facts.items():
        if code == 7:
            for at in set(dates):
                other = facts.get((person, 8), [])
                assert got[(person, at)] == sum(1 <= (at - o).days <= 30 for o in other)


def test_days_meet_only_the_periods_around_them(spark):
    """A person with thousands of periods: rows stay in proportion, overlapping periods included."""
    many = spark.range(3000).selectExpr(
        "1L AS person_id", "date_add(DATE'2000-01-01', CAST(id * 3 AS INT)) AS op_start",
        "date_add(DATE'2000-01-01', CAST(id * 3 + 1 AS INT)) AS op_end", "1L AS n_op",
    )
    nested = literal_table(
        spark,
        [(2, day("2001-01-01"), day("2001-12-31"), 1), (2, day("2001-03-01"), day("2001-04-01"), 2), (2, day("2001-06-01"), day("2002-02-01"), 1), (2, day("2003-01-01"), day("2003-01-01"), 1)],
        "person_id long, op_start date, op_end date, n_op long",
    )
    periods = many.unionByName(nested)
    days = spark.range(9000).selectExpr("1L AS person_id", "date_add(DATE'2000-01-01', CAST(id AS INT)) AS start_date", "id AS n")
    days = days.unionByName(
        spark.range(1100).selectExpr("2L AS person_id", "date_add(DATE'2000-12-01', CAST(id AS INT)) AS start_date", "id AS n")
    )
    days = days.unionByName(spark.range(1).selectExpr("3L AS person_id", "DATE'2001-01-01' AS start_date", "id AS n"))
    got = cohort.inside_periods(days, periods).select("person_id", "start_date", "n", "op_start", "op_end", "n_op")
    want = days.join(periods, "person_id").where("start_date BETWEEN op_start AND op_end").select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.where("person_id = 1").count() == 6000
