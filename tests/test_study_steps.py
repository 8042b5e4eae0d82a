from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from table_rows import day, rows
from pyspark.sql import functions as F

from cohortide.operators import covariates, events, followup, population
from cohortide.operators.population import GENERAL_POPULATION_ID as GENERAL
from cohortide.plans import definitions as d
from cohortide.sources.literals import literal_table

COHORT = "cohort_definition_id long, subject_id long, cohort_start_date date, cohort_end_date date"


def cohorts_df(spark, data):
    return literal_table(spark, [(c, p, day(s), day(s)) for c, p, s in data], COHORT)


def study(cdm, cohorts, **kw):
    return population.study_population(cdm, cohorts, events.compact_periods(cdm.observation_period), **kw)


@pytest.fixture(scope="module")
def people(cdm_of):
    return dict(
        person=[(p, 8507 if p % 2 else 8532, 1960, 6, 15) for p in range(1, 10)] + [(10, 0, 1960, 6, 15)],
        observation_period=[(p, p, "2018-01-01", "2022-12-31") for p in (1, 2, 3, 5, 6, 7, 8, 10)]
        + [(40, 4, "2018-01-01", "2021-12-31"), (41, 4, "2022-02-01", "2022-12-31"), (70, 9, "2020-09-01", "2022-12-31")],
    )


def test_population_rules(spark, cdm_of, people):
    cohorts = cohorts_df(
        spark,
        [
            (102, 1, "2021-02-01"),
            (204, 1, "2021-02-20"),
            (102, 2, "2021-02-01"),
            (103, 2, "2021-02-01"),  # two brands the same day
            (102, 3, "2022-12-24"),  # within a week of the end of data
            (102, 4, "2021-02-01"),  # two observation periods
            (102, 5, "2021-02-01"),
            (102, 5, "2021-05-01"),  # a later row of the same cohort
            (102, 8, "2022-12-23"),
            (102, 9, "2021-02-01"),  # less than a year observed
            (102, 10, "2021-02-01"),  # unknown sex
        ],
    )
    pop = study(cdm_of(**people), cohorts)
    got = rows(pop.where("study_id = 102").select("person_id", "index_date", "next_vax_date", "age", "gender"))
    assert got == [
        (1, day("2021-02-01"), day("2021-02-20"), 60, "Male"),
        (2, day("2021-02-01"), None, 60, "Female"),
        (5, day("2021-02-01"), None, 60, "Male"),
        (8, day("2022-12-23"), None, 62, "Female"),
    ]
    any_first = population.STUDY_IDS["Any first-dose"]
    assert [r[0] for r in rows(pop.where(f"study_id = {any_first}").select("person_id"))] == [1, 5, 8]
    kept = study(cdm_of(**people), cohorts, op_containing_index=True)
    assert 4 in [r[0] for r in rows(kept.where("study_id = 102").select("person_id"))]


def test_age_formula_switches_for_everyone(spark, cdm_of, people):
    cohorts = cohorts_df(spark, [(102, 1, "2021-02-01"), (102, 5, "2021-02-01")])
    tables = dict(people)
    tables["person"] = [(1, 8507, 1960, 6, 15), (5, 8507, 1960, 6, None)]
    pop = study(cdm_of(**tables), cohorts)
    assert rows(pop.where("study_id = 102").select("person_id", "age")) == [(1, 61), (5, 61)]


def test_age_bands(spark):
    ages = literal_table(spark, [(a,) for a in (19, 20, 44, 45, 54, 55, 64, 65, 74, 75, 84, 85)], "age int")
    got = [tuple(r) for r in ages.select("age", *(c.alias(n) for n, c in population.age_bands().items())).collect()]
    assert [g[1] for g in got] == [
        "<20", "20-44", "20-44", "45-54", "45-54", "55-64", "55-64", "65-74", "65-74", "75-84", "75-84", ">=85"]
    assert [g[2] for g in got[2:8]] == ["<=44", "45-64", "45-64", "45-64", "45-64", ">=65"]
    assert [g[3] for g in got][:4] == ["<20", "20-29", "40-49", "40-49"] and got[-1][3] == ">=80"


POP = "study_id int, person_id long, index_date date, next_vax_date date, op_end date"


def pop_df(spark, data):
    return literal_table(spark, [(s, p, day(i), day(n), day(o)) for s, p, i, n, o in data], POP)


def test_history_windows(spark):
    pop = pop_df(spark, [(102, p, "2021-07-01", None, "2022-12-31") for p in range(1, 9)])
    bit = 1 << list(d.DRUGS).index("coxibs")
    meds = literal_table(
        spark,
        [(p, day(t), bit) for p, t in enumerate(("2020-12-30", "2020-12-29", "2021-06-27", "2021-06-28"), 1)],
        "person_id long, day date, mask long",
    )  # 183, 184, 4 and 3 days before
    covid = cohorts_df(
        spark,
        [(1, 5, "2020-07-01"), (1, 6, "2020-06-30"), (2, 7, "2021-07-01"), (2, 8, "2021-07-02")],
    )
    got = covariates.recent_flags(pop, meds, covid, 2020)
    assert rows(got.where("coxibs = 1").select("person_id")) == [(1,), (3,)]
    assert rows(got.where("covid_year_prior = 1").select("person_id")) == [(5,), (7,)]
    assert got.where("tamoxifen = 1").count() == 0 and got.count() == 8
    later = covariates.recent_flags(pop, meds, covid, 2021)
    assert rows(later.where("covid_year_prior = 1").select("person_id")) == [(7,)]
    firsts = literal_table(
        spark, [(1, day("2021-06-30")), (2, day("2021-07-01"))], "person_id long, asthma_first date"
    )
    past = covariates.condition_flags(pop, firsts, {"asthma": 1})
    assert rows(past.where("asthma_all_history = 1").select("person_id")) == [(1,)]


def test_comorbidity_first_date_and_descendants(spark, cdm_of):
    cdm = cdm_of(
        condition_occurrence=[(1, 1, 5, "2020-02-01"), (2, 1, 6, "2020-01-01"), (3, 2, 5, "2020-01-01"), (4, 1, 7, "2019-01-01")],
        concept_ancestor=[(100, 5), (100, 6), (200, 7)],
        drug_era=[(1, 5, "2020-03-01", "2020-05-01"), (1, 6, "2020-03-01", "2020-04-30"), (1, 5, "2020-04-01", "2020-06-01")],
    )
    exposed = literal_table(spark, [(1,)], "person_id long")
    firsts = covariates.condition_firsts(cdm, {"x": 100})
    got = covariates.comorbidity_cohorts(firsts, exposed, {"x": 100}).drop("cohort_end_date")
    assert rows(got) == [(100, 1, day("2020-01-01"))]
    days = covariates.medication_days(cdm, day("2020-05-01"), {"x": 100})
    used = covariates.medication_cohorts(days, exposed, {"x": 100}).drop("cohort_end_date")
    assert rows(used) == [(100, 1, day("2020-03-01")), (100, 1, day("2020-04-01"))]


def test_months_since_start(spark, cdm_of):
    pop = pop_df(spark, [(102, 1, "2021-02-28", None, "2022-12-31"), (GENERAL, 2, "2021-03-15", None, "2022-12-31")])
    first = cohorts_df(spark, [(101, 9, "2021-01-31"), (301, 9, "2017-01-01")])
    got = rows(population.with_months_since_start(pop, first).select("person_id", F.round("months_since_start", 6)))
    assert got == [(1, round(28 / 30.4375, 6)), (2, None)]


CASES = [
    # person, next vaccine, end of observation, outcome date -> in follow-up, days
    (1, None, "2022-12-31", "2021-07-01", True, 0),
    (2, None, "2022-12-31", "2021-07-29", True, 28),
    (3, None, "2022-12-31", "2021-07-30", False, 28),
    (4, "2021-07-11", "2022-12-31", "2021-07-11", False, 10),
    (5, "2021-07-11", "2022-12-31", "2021-07-10", True, 9),
    (6, "2021-07-21", "2021-07-06", "2025-01-01", False, 20),
    (7, "2021-09-01", "2021-07-06", "2025-01-01", False, 5),
    (8, "2021-06-01", "2022-12-31", "2025-01-01", False, 28),
    (9, None, "2022-12-31", "2020-06-30", False, 28),  # more than a year before: history only
    (11, "2021-06-01", "2022-12-31", "2021-07-10", True, 9),  # next vaccine before the index date
    (12, "2021-07-01", "2022-12-31", "2021-07-01", False, 0),  # next vaccine on the index date
]


def test_follow_up_edges(spark):
    pop = pop_df(spark, [(102, p, "2021-07-01", v, o) for p, v, o, *_ in CASES] + [(102, 10, "2021-07-01", None, "2022-12-31")])
    outcomes = cohorts_df(spark, [(302, p, e) for p, _, _, e, *_ in CASES] + [(302, 10, "2020-07-01"), (302, 10, "2021-07-05")])
    facts = followup.outcome_facts(pop, outcomes)
    pairs = followup.open_pairs(facts, minimum=1)
    assert rows(pairs.select("n_rows", "followup_rows")) == [(13, 4)]
    tar = followup.time_at_risk(pop, facts, pairs)
    got = rows(tar.select("person_id", "f_u_outcome", "f_u_outcome_days", "history_outcome"))
    assert got == [(p, int(hit), days, int(p == 9)) for p, _, _, _, hit, days in CASES]  # person 10 is washed out
    first = followup.time_at_risk(pop, facts, pairs, earliest=True)
    shorter = {6: 5}  # observation ends before the next vaccine
    assert rows(first.select("person_id", "f_u_outcome_days")) == [(p, shorter.get(p, days)) for p, _, _, _, _, days in CASES]
    assert followup.open_pairs(facts, minimum=5).count() == 0


@pytest.fixture(scope="module")
def long_history(spark):
    """A person with thousands of days and an index date in every study cohort, and some with few."""
    rnd, start = random.Random(4), dt.date(2016, 1, 1)

    def some(n):
        return [start + dt.timedelta(days=rnd.randrange(2200)) for _ in range(n)]

    pop = []
    for person in range(12):
        for study in (GENERAL, 102, 103, 202, 203):
            index = some(1)[0]
            vax = index + dt.timedelta(days=rnd.randrange(-3, 40)) if rnd.random() < 0.5 else None
            pop.append((study, person, index, vax, index + dt.timedelta(days=rnd.randrange(900))))
    days = {p: sorted(set(some(4000 if p == 0 else rnd.randrange(40)))) for p in range(12)}
    return pop, days


def test_histories_equal_a_search_of_all_days(spark, long_history):
    pop, days = long_history
    masks = [(p, t, (p + t.toordinal()) % 1024 & 1 << t.toordinal() % 10) for p, at in days.items() for t in at if t.day % 3]
    ill = [(1, p, t) for p, at in days.items() for t in at if t.day % 7 == 0 and t.year >= 2020]
    covid = spark.createDataFrame( [(i, p, t, t) for i, p, t in ill], COHORT)
    got = covariates.recent_flags(
        spark.createDataFrame( pop, POP), spark.createDataFrame( masks, "person_id long, day date, mask long"), covid, 2020)
    for r in got.collect():
        at = r.index_date
        seen = 0
        for p, t, mask in masks:
            if p == r.person_id and 4 <= (at - t).days <= 183:
                seen |= mask
        assert [r[n] for n in d.DRUGS] == [seen >> i & 1 for i in range(len(d.DRUGS))]
        year = at.replace(year=at.year - 1, day=28) if (at.month, at.day) == (2, 29) else at.replace(year=at.year - 1)
        assert r.covid_year_prior == int(any(p == r.person_id and year <= t <= at for _, p, t in ill))


def test_facts_equal_a_search_of_all_days(spark, long_history):
    pop, days = long_history
    events = [(o, p, t) for p, at in days.items() for t in at for o in (302, 303) if (t.toordinal() + o) % 5 < 3]
    outcomes = spark.createDataFrame( [(o, p, t, t) for o, p, t in events], COHORT)
    facts = followup.outcome_facts(spark.createDataFrame( pop, POP), outcomes)
    joins = [line for line in facts._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1  # index dates with the person's outcomes, not with their days
    want = []
    for study, person, index, vax, _ in pop:
        year = index.replace(year=index.year - 1, day=28) if (index.month, index.day) == (2, 29) else index.replace(year=index.year - 1)
        two = index.replace(year=index.year + 2, day=28) if (index.month, index.day) == (2, 29) else index.replace(year=index.year + 2)
        end = two if study == GENERAL else index + dt.timedelta(days=28)
        for o in (302, 303):
            own = [t for x, p, t in events if (x, p) == (o, person)]
            if not own:
                continue
            free = study == GENERAL or vax is None or vax < index
            hits = [t for t in own if index <= t <= end and (free or t < vax)]
            washout, history = any(year <= t < index for t in own), any(t < year for t in own)
            want.append((study, o, person, len(own), washout, history, len(hits), min(hits, default=None)))
    assert sorted(map(tuple, facts.collect()), key=str) == sorted(want, key=str)


def test_general_population_follows_two_years(spark):
    pop = pop_df(spark, [(GENERAL, 1, "2016-02-29", None, "2022-12-31"), (GENERAL, 2, "2017-01-01", None, "2018-06-01")])
    facts = followup.outcome_facts(pop, cohorts_df(spark, [(302, 1, "2018-02-28"), (302, 2, "2015-02-28")]))
    tar = followup.time_at_risk(pop, facts, followup.open_pairs(facts, minimum=1))
    assert rows(tar.select("person_id", "f_u_outcome", "f_u_outcome_days")) == [(1, 1, 730), (2, 0, 516)]


@pytest.mark.parametrize("earliest", [False, True])
def test_count_cells_equal_the_full_table(spark, earliest):
    rnd = random.Random(3)
    pop = pop_df(
        spark,
        [
            (102, p, "2021-07-01", rnd.choice([None, "2021-07-10", "2021-08-20"]), rnd.choice(["2021-07-15", "2022-01-01"]))
            for p in range(300)
        ],
    ).withColumn("sex", F.when(F.col("person_id") % 2 == 0, "a").otherwise("b"))
    dates = ["2020-06-01", "2020-09-01", "2021-07-03", "2021-07-12", "2021-07-20", "2021-09-01"]
    outcomes = cohorts_df(spark, [(o, rnd.randrange(300), rnd.choice(dates)) for o, _ in itertools.product((302, 303), range(150))])
    facts = followup.outcome_facts(pop, outcomes)
    pairs = followup.open_pairs(facts)
    cells = followup.count_cells(pop, facts, pairs, {"sex": F.col("sex")}, earliest=earliest)
    direct = (
        followup.time_at_risk(pop, facts, pairs, earliest)
        .groupBy("study_id", "outcome_id", "sex", F.col("f_u_outcome_days").alias("days"), F.col("f_u_outcome").alias("event"))
        .agg(F.count("*").alias("n"))
    )
    assert rows(cells) == rows(direct) and pairs.count() == 2


def test_sample_is_stable(spark):
    pop = pop_df(spark, [(102, p, "2021-07-01", None, "2022-12-31") for p in range(50)])
    first = rows(population.sample(pop, 10, seed=1).select("person_id"))
    again = rows(population.sample(pop.repartition(3), 10, seed=1).select("person_id"))
    assert first == again and len(first) == 10
    assert first != rows(population.sample(pop, 10, seed=2).select("person_id"))
