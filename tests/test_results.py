from __future__ import annotations

import math
import random

import numpy as np
import pytest
from table_rows import rows
from pyspark.sql import functions as F

from cohortide.functions.tails import Z95, chi2_tail
from cohortide.operators.covariates import COVID_FLAG
from cohortide.operators import logistic, models, summaries, survival
from cohortide.operators.covariates import COVID_FLAG
from cohortide.plans import definitions as d
from cohortide.sources.literals import literal_table


def km(spark, data):
    counts = literal_table(spark, data, "k string, time int, n long, n_event long")
    return {(r.k, r.time): r for r in survival.kaplan_meier(counts, ["k"]).collect()}


def test_kaplan_meier_by_hand(spark):
    """6 people: events at 1 and 3, two at 3 leave without, the last two at 4, one event."""
    got = km(spark, [("a", 1, 1, 1), ("a", 3, 3, 1), ("a", 4, 2, 1), ("b", 2, 3, 3)])
    assert [got["a", t].n_risk for t in range(5)] == [6, 6, 5, 5, 2]
    s1, s3, s4 = 5 / 6, 5 / 6 * 4 / 5, 5 / 6 * 4 / 5 * 1 / 2
    assert [got["a", t].surv for t in range(5)] == pytest.approx([1, s1, s1, s3, s4])
    g = 1 / (6 * 5) + 1 / (5 * 4)
    assert got["a", 3].lower == pytest.approx(s3 * math.exp(-Z95 * math.sqrt(g)))
    assert got["a", 3].upper == 1.0 and got["a", 0].lower == 1.0
    assert got["a", 4].cum_n_event == 3
    # everyone has the event: the curve ends at zero without limits, and stops at its own last day
    assert got["b", 2].surv == 0 and got["b", 2].lower is None and got["b", 2].upper is None
    assert ("b", 3) not in got


def test_kaplan_meier_without_censoring(spark):
    rnd = random.Random(1)
    times = [rnd.randrange(20) for _ in range(200)]
    got = km(spark, [("a", t, times.count(t), times.count(t)) for t in set(times)])
    for (_, t), r in got.items():
        assert r.surv == pytest.approx(1 - sum(x <= t for x in times) / 200, abs=1e-12)
    risk = [got["a", t].n_risk for t in range(max(times) + 1)]
    assert risk == sorted(risk, reverse=True)


def test_strata_and_gates(spark):
    cells = literal_table(
        spark,
        [("Male" if i % 2 else "Female", 30 + i, int(i < 6), int(i < 5), 1, int(i < 4)) for i in range(20)],
        f"gender string, age int, cond_comp int, drug_comp int, cond_drug_comp int, {COVID_FLAG} int",
    ).selectExpr("*", "1 AS study_id", "302 AS outcome_id", "age % 3 AS days", "0 AS event", "1L AS n")
    counts = (
        cells.withColumns(survival.age_bands())
        .withColumn("slice", F.explode(survival.slices()))
        .select("study_id", "outcome_id", "slice", "n", F.col("days").alias("time"), F.inline(survival.strata()))
        .groupBy(*survival.CURVE, "time")
        .agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("n_event"))
    )
    shown = survival.reportable(counts)
    assert {r.slice for r in shown.select("slice").distinct().collect()} == {"All", "No covid"}  # 4 covid rows
    overall = {r.strata for r in shown.where("slice = 'All'").select("strata").distinct().collect()}
    assert "cond_comp" in overall and "drug_comp" not in overall and len(overall) == 10
    labels = {r.grp for r in shown.where("strata = 'age_gr2_gender'").select("grp").distinct().collect()}
    assert labels == {f"age_gr2={a}, gender={g}" for a in ("<=44", "45-64") for g in ("Male", "Female")}


def newton(x, n, y):
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        info = (x * (n * p * (1 - p))[:, None]).T @ x
        beta = beta + np.linalg.solve(info, x.T @ (y - n * p))
    return beta, np.linalg.inv(info)


def test_logistic_against_numpy(spark):
    rnd = np.random.default_rng(5)
    age, sex = rnd.integers(-3, 4, 80).astype(float), rnd.integers(0, 2, 80).astype(float)
    n = rnd.integers(5, 40, 80)
    y = rnd.binomial(n, 1 / (1 + np.exp(1 - 0.4 * age + 0.7 * sex)))
    data = [(m, 1.0, float(a), float(s), int(k), int(h)) for m in (1, 2) for a, s, k, h in zip(age, sex, n, y)]
    df = literal_table(spark, data, "model_id int, x0 double, x1 double, x2 double, n long, y long")
    fits = logistic.fit_models(df, {1: ["one", "age", "sex"], 2: ["one", "age"]}, ["one", "age", "sex"])
    for m, x in ((1, np.column_stack([np.ones(80), age, sex])), (2, np.column_stack([np.ones(80), age]))):
        beta, cov = newton(x, n, y)
        assert fits[m].converged
        assert fits[m].beta == pytest.approx(beta, abs=1e-8) and fits[m].cov == pytest.approx(cov, abs=1e-8)
    value, se = fits[1].contrast({"age": 2.0, "sex": 1.0})
    c = np.array([0, 2, 1])
    assert value == pytest.approx(c @ fits[1].beta) and se == pytest.approx(math.sqrt(c @ fits[1].cov @ c))
    assert fits[1].wald(["sex"]) == pytest.approx(fits[1].beta[2] ** 2 / fits[1].cov[2, 2])


def test_separated_model_is_marked(spark):
    data = [(1, 1.0, 0.0, 50, 10), (1, 1.0, 1.0, 20, 0), (2, 1.0, 0.0, 30, 5), (2, 1.0, 0.0, 10, 2)]
    df = literal_table(spark, data, "model_id int, x0 double, x1 double, n long, y long")
    fits = logistic.fit_models(df, {1: ["one", "x"], 2: ["one", "x"]}, ["one", "x"])
    assert (fits[1].status, fits[2].status) == ("separated", "singular")


def test_chi2_tails():
    assert chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert chi2_tail(11.0705, 5) == pytest.approx(0.05, abs=1e-6)
    assert chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)


def test_spline_is_linear_outside_the_knots():
    knots = (30.0, 50.0, 70.0)
    f = [logistic.spline_value(a, knots) for a in (20, 30, 75, 80, 85)]
    assert f[0] == f[1] == 0 and f[3] - f[2] == pytest.approx(f[4] - f[3])


@pytest.fixture(scope="module")
def cells(spark):
    """A slice with a strong effect of the first exposure and of sex, none exposed to the last."""
    rnd = np.random.default_rng(11)
    data = []
    for age in range(20, 90, 2):
        for male in (0, 1):
            for mask in (0, 1, 2, 3):
                for months in (0.5, 3.0):
                    n = int(rnd.integers(5, 30))
                    p = 1 / (1 + math.exp(2.5 - 0.02 * (age - 65) - 0.8 * (mask & 1) - 0.5 * male - 0.1 * months))
                    data.append((102, 302, "All", "Male" if male else "Female", age, months, mask, n, int(rnd.binomial(n, p))))
    schema = "study_id int, outcome_id int, slice string, gender string, age int, months double, mask int, n long, y long"
    return literal_table(spark, data, schema)


def split(cells):
    """Cells as cubes, changes and patterns."""
    cubes = models._cubes(cells.withColumn("y", F.lit(0)), ["study_id", "slice"]).drop("y").persist()
    changes = models._cubes(cells.withColumn("n", F.lit(0)), models.SLICE).persist()
    return cubes, changes, models.covariate_patterns(cubes, changes).persist()


def test_odds_ratios_end_to_end(spark, cells):
    cubes, changes, patterns = split(cells)
    results = models.odds_ratios(cubes, changes, patterns).collect()
    got = {(r["var"], r["model"], r["gender"], r["rel_age"]): r for r in results}
    closed = {r["var"]: r for r in models.unadjusted_ratios(patterns).collect()}
    for var in ("asthma", "diabetes_mellitus", "Sex (Male:Female)"):
        fitted = got[var, models.UNADJUSTED, None, None]
        for name in ("or", "or_low", "or_high"):
            assert fitted[name] == pytest.approx(closed[var][name], rel=1e-6)
    assert ("drug_comp", models.UNADJUSTED, None, None) not in got  # nobody exposed
    assert got["Age", None, "Male", 65]["or"] == 1.0 and len([k for k in got if k[0] == "Age"]) == 30
    pdf = cells.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf["mask"] & 1, (pdf.age - 65) / 10, pdf.gender == "Male", pdf.months]).astype(float)
    beta, cov = newton(x, pdf.n.to_numpy(), pdf.y.to_numpy())
    adjusted = got["asthma", models.BY_TIME, None, None]
    curve = len({r for r in got if r[0] == "Age"}) and got["Age", None, "Male", 75]["or"] / got["Age", None, "Male", 65]["or"]
    straight = got["Age", None, "Male", 85]["or"] == pytest.approx(curve**2, rel=1e-9)
    assert straight  # age was taken as linear, as in the numpy fit
    assert adjusted["or"] == pytest.approx(math.exp(beta[1]), rel=1e-6)
    assert adjusted["or_high"] == pytest.approx(math.exp(beta[1] + Z95 * math.sqrt(cov[1, 1])), rel=1e-6)
    only = models.odds_ratios(cubes, changes, patterns, interaction_test="interaction")
    ages = {(r["gender"], r["rel_age"]): r["or"] for r in only.where("var = 'Age'").collect()}
    assert len(ages) == 30


def test_empty_cell_gives_null(spark, cells):
    none = cells.withColumn("y", F.expr("CASE WHEN mask & 2 = 0 THEN y ELSE 0L END"))
    cubes, changes, patterns = split(none)
    row = models.odds_ratios(cubes, changes, patterns).where("var = 'diabetes_mellitus'").collect()
    assert len(row) == 3 and all(r["or"] is None and r["status"] == "separated" for r in row)
    assert models.unadjusted_ratios(patterns).where("var = 'diabetes_mellitus'").first()["or"] is None


def test_cubes_do_not_grow_with_people(spark):
    columns = list(models.variable_columns().values())
    bits = {c: F.expr(f"shiftright(mask, {i}) & 1") for i, c in enumerate(columns)}
    pairs = literal_table(spark, [(102, 302), (102, 303)], "study_id int, outcome_id int")
    sizes = []
    for people in (20_000, 60_000):
        rnd = spark.range(people).selectExpr(
            "102 AS study_id", "id AS person_id", "if(id % 2 = 0, 'Male', 'Female') AS gender",
            "CAST(20 + id % 7 AS INT) AS age", "id % 5 / 30D AS months_since_start",
            f"CAST(pmod(xxhash64(id, 1), 2) AS INT) AS {COVID_FLAG}", f"CAST(pmod(xxhash64(id, 2), {1 << len(columns)}) AS INT) AS mask",
        ).withColumns(bits)
        cubes = models.exposure_cubes(rnd, pairs).persist()
        sizes.append(cubes.count())
        assert cubes.where("slice = 'All'").groupBy("v").agg(F.sum("n").alias("n")).select("n").distinct().first().n == people
    assert sizes[0] == sizes[1] == 3 * 70 * (1 + 2 * len(columns))


def test_changes_correct_the_cubes(spark):
    columns = list(models.variable_columns().values())
    pop = spark.range(200).selectExpr(
        "102 AS study_id", "id AS person_id", "if(id % 3 = 0, 'Male', 'Female') AS gender", "CAST(30 + id % 4 AS INT) AS age",
        "id % 2 / 2D AS months_since_start", f"CAST(id % 5 = 0 AS INT) AS {COVID_FLAG}", *(f"CAST(id % {i + 2} = 0 AS INT) AS {c}" for i, c in enumerate(columns)))
    facts = spark.range(0, 200, 7).selectExpr(
        "102 AS study_id", "302 AS outcome_id", "id AS person_id", "id % 3 = 0 AS washout", "if(id % 2 = 0, DATE'2021-01-05', NULL) AS event_date")
    pairs = literal_table(spark, [(102, 302)], "study_id int, outcome_id int")
    patterns = models.covariate_patterns(models.exposure_cubes(pop, pairs), models.outcome_changes(pop, facts, pairs), 1, 0)
    people = pop.join(facts.drop("study_id"), "person_id", "left").where("washout IS NULL OR NOT washout")
    for i, (var, column) in enumerate(models.variable_columns().items()):
        for slice, where in (("All", "true"), ("Covid", f"{COVID_FLAG} = 1")):
            want = people.where(where).groupBy(F.col(column).alias("value"), "gender", "age").agg(
                F.count("*").alias("n"), F.count("event_date").alias("y"))
            own = (F.col("var") == var) & (F.col("slice") == slice) & (F.col("model") == models.BY_AGE_SEX)
            have = patterns.where(own).select("value", "gender", "age", "n", "y")
            if i % 4 == 0:
                assert sorted(map(tuple, have.collect())) == sorted(map(tuple, want.collect()))


def test_jobs_do_not_grow_with_passes(spark):
    def jobs(rows, name):
        df = literal_table(spark, rows, "model_id int, x0 double, x1 double, n long, y long")
        spark.sparkContext.setJobGroup(name, name)
        fits = logistic.fit_models(df, {1: ["one", "x"]}, ["one", "x"])
        spark.sparkContext.setJobGroup("rest", "rest")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), fits[1].steps

    few = jobs([(1, 1.0, 0.0, 50, 10), (1, 1.0, 1.0, 20, 4)], "few passes")
    many = jobs([(1, 1.0, 0.0, 50, 10), (1, 1.0, 1.0, 20, 0)], "many passes")
    assert many[1] > 3 * few[1] and many[0] == few[0]


def test_small_counts_are_hidden(spark):
    data = [("n", n, 100) for n in (0, 1, 4, 5)] + [("asthma_all_history", n, 100) for n in (0, 1, 4, 5)]
    table = literal_table(spark, data, "var string, n long, total long").selectExpr(
        "*", "CAST(NULL AS DOUBLE) AS low", "CAST(NULL AS DOUBLE) AS mid", "CAST(NULL AS DOUBLE) AS high", "CAST(NULL AS DATE) AS day")
    got = summaries.with_text(table).collect()
    assert [r.value for r in got[:4]] == ["0", "<5", "<5", "5"]
    assert [r.value for r in got[4:]] == ["0 (0.0%)", "<5", "<5", "5 (5.0%)"]
    assert got[4].label == "Asthma all history"


def test_histogram_bins(spark):
    ages = literal_table(spark, [(a,) for a in (18, 19, 20, 28, 28)], "age int").withColumn("k", F.lit(1))
    got = rows(summaries.histogram(ages, ["k"]).select("x", "xmin", "xmax", "count", F.round("density", 6)))
    # 19.5 closes the bin around 18
    assert [(g[0], g[3]) for g in got] == [(18.0, 2), (21.0, 1), (24.0, 0), (27.0, 2)]
    assert got[0][1:3] == (16.5, 19.5) and got[0][4] == round(2 / 15, 6)


def test_definitions_cover_the_study():
    specs = d.exposure_specs() + d.outcome_specs() + d.covid_specs()
    assert len(specs) == 31 and len({s.id for s in specs}) == 31
    used = {c.codeset for s in specs for c in s.entry + s.censor}
    assert used <= set(d.CODESETS) | {name for name, *_ in d.derived_codesets()}
    assert len(d.study_members()) == 19


def test_cubes_shuffle_a_row_for_a_cell(spark, cells):
    """All exposures of a cell travel in one row and get rows of their own behind the shuffle."""
    cubes = models._cubes(cells, models.SLICE)
    text = cubes._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in text.split("Exchange")[0] and "Generate" not in text.split("Exchange")[1]
    for i in (1, 2, 3):
        value = F.expr(f"shiftright(mask, {i - 1}) & 1")
        keys = [*models.SLICE, "value", "gender", "age", "months"]
        plain = cells.withColumn("value", value).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
        assert rows(cubes.where(f"v = {i}").select(*plain.columns)) == rows(plain)
