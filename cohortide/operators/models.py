"""Odds ratios for age, sex and exposures, per study cohort, outcome and slice."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortide.functions.tails import Z95, chi2_tail
from cohortide.operators.followup import PAIR
from cohortide.operators.logistic import FITTED, Fit, fit_models, fits_of, newton, spline_sql, spline_value
from cohortide.operators.population import PERSON_KEY
from cohortide.operators.survival import slices
from cohortide.plans import definitions as d

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE = [*PAIR, "slice"]
SLOTS = ["one", "value", "age", "spline", "male", "mid", "old", "mid_male", "old_male"]
REFERENCE_AGE = 65
AGES = tuple(range(20, 91, 5))
UNADJUSTED, BY_AGE = "Unadjusted", "Adjusted for age"
BY_AGE_SEX, BY_TIME = "Adjusted for age and sex", "Adjusted for age, sex, and calendar time"
RESULT = (
    "study_id int, outcome_id int, slice string, var string, model string, gender string, "
    "n_tot long, n_w_outcome long, `or` double, or_low double, or_high double, "
    "ref_age int, rel_age int, model_type string, status string, steps int"
)


def variable_columns() -> dict[str, str]:
    """Model variable -> population column."""
    return {v: f"{v}_all_history" if v in d.CONDITIONS else v for v in d.MODEL_VARIABLES}


def _cubes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add up (n, y) once for each exposure: by its value, sex, age and months, exposure 0 being none.

    An exposure's cells are at most two values by sexes, ages and days, however many people there are;
    the joint table of all exposures would have nearly a cell per person.
    """
    cell = ["gender", "age", "months"]
    own = range(1, len(variable_columns()) + 1)
    sums = [F.sum("n").alias("n"), F.sum("y").alias("y"), F.expr("bit_or(mask) AS with"), F.expr("bit_or(~mask) AS without")]
    for i in own:
        sums += [F.expr(f"sum({x} * (shiftright(mask, {i - 1}) & 1)) AS {x}_{i}") for x in "ny"]
    forms = ["struct(0 AS v, 0 AS value, n, y)"]
    for i in own:
        bit = f"shiftright(%s, {i - 1}) & 1 = 1"
        forms.append(f"CASE WHEN {bit % 'without'} THEN struct({i} AS v, 0 AS value, n - n_{i} AS n, y - y_{i} AS y) END")
        forms.append(f"CASE WHEN {bit % 'with'} THEN struct({i} AS v, 1 AS value, n_{i} AS n, y_{i} AS y) END")
    every = F.expr(f"inline(array_compact(array({', '.join(forms)})))")
    # One row with the sums of all exposures is shuffled for a cell, not a row for each exposure and value.
    cells = rows.groupBy(*keys, *cell).agg(*sums).select(*keys, *cell, every)
    return cells.select(*keys, "v", "value", *cell, "n", "y")


def _people(pop: DataFrame, pairs: DataFrame) -> DataFrame:
    """What the models know of each person of the open pairs' study cohorts, once per slice."""
    mask = " + ".join(f"{column} * {1 << i}" for i, column in enumerate(variable_columns().values()))
    studies = F.broadcast(pairs.select("study_id").distinct())
    return pop.join(studies, "study_id", "left_semi").select(
        *PERSON_KEY,
        F.explode(slices()).alias("slice"),
        "gender",
        "age",
        F.col("months_since_start").alias("months"),
        F.expr(f"CAST({mask} AS INT) AS mask"),
    )


def exposure_cubes(pop: DataFrame, pairs: DataFrame) -> DataFrame:
    """People per study cohort and slice as if nobody had an outcome, by exposure: see ``_cubes``."""
    rows = _people(pop, pairs).withColumns({"n": F.lit(1), "y": F.lit(0)})
    return _cubes(rows, ["study_id", "slice"]).drop("y")


def outcome_changes(pop: DataFrame, facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """What each outcome changes in the cubes: people with washout leave (n = -1), cases count (y = 1)."""
    known = (
        facts.where(F.col("washout") | F.col("event_date").isNotNull())
        .join(F.broadcast(pairs.select(*PAIR)), PAIR)
        .select(*PAIR, "person_id", "washout")
        .join(_people(pop, pairs), PERSON_KEY)
    )
    gone = F.col("washout")
    moves = {"n": F.when(gone, -1).otherwise(0), "y": F.when(gone, 0).otherwise(1)}
    return _cubes(known.withColumns(moves), SLICE)


def covariate_patterns(
    cubes: DataFrame, changes: DataFrame, min_events: int = 30, min_exposed: int = 5
) -> DataFrame:
    """Counts (n, y) by covariate pattern for age and sex, and for each exposure.

    Only slices with ``min_events`` events are kept; they are at most study cohorts times outcomes times
    three.  Per exposure there is a pattern table without covariates and one by age and sex,
    if more than ``min_exposed`` people have it.  All of them are small.
    """
    names = ["age", *variable_columns()]
    pattern = ["v", "value", "gender", "age"]
    # months do not matter here, which shrinks the cubes before outcomes multiply them
    base = cubes.groupBy("study_id", "slice", *pattern).agg(F.sum("n").alias("n"))
    moved = changes.groupBy(*SLICE, *pattern).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    busy = moved.where("v = 0").groupBy(*SLICE).agg(F.sum("y").alias("events")).where(F.col("events") >= min_events)
    busy = F.broadcast(busy.select(*SLICE))
    columns = [*SLICE, *pattern, "n", "y"]
    every = base.join(busy, ["study_id", "slice"]).withColumn("y", F.lit(0).cast("long")).select(*columns)
    every = every.unionByName(moved.join(busy, SLICE).select(*columns))
    by_age_sex = every.groupBy(*SLICE, *pattern).agg(F.sum("n").alias("n"), F.sum("y").alias("y")).where("n > 0")
    exposed = F.sum(F.col("n") * F.col("value")).over(Window.partitionBy(*SLICE, "v"))  # at most values by sexes by ages
    forms = (
        "struct(0 AS form, CAST(NULL AS STRING) AS sex, CAST(NULL AS INT) AS years)",
        "struct(1 AS form, gender AS sex, age AS years)",
    )
    quoted = ", ".join(f"'{n}'" for n in names)
    return (
        by_age_sex.withColumn("exposed", exposed)
        .where((F.col("v") == 0) | (F.col("exposed") > min_exposed))
        .select(*SLICE, "v", "value", "n", "y", F.expr(f"inline(array({', '.join(forms)}))"))
        .where("v > 0 OR form = 1")
        .groupBy(*SLICE, "v", "form", "value", "sex", "years")
        .agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
        .select(
            *SLICE,
            F.expr(f"element_at(array({quoted}), v + 1) AS var"),
            F.expr(f"element_at(array('{UNADJUSTED}', '{BY_AGE_SEX}'), form + 1) AS model"),
            "value",
            F.col("sex").alias("gender"),
            F.col("years").alias("age"),
            "n",
            "y",
        )
    )


@dataclass
class _Job:
    """One model to fit: which patterns it reads and which terms it has."""

    slice: tuple
    name: str
    var: str
    model: str
    terms: list[str]
    knots: tuple[float, float, float] | None = None
    gender: str | None = None


def _job_table(spark: SparkSession, jobs: list[_Job], columns: dict[str, list], types: dict) -> DataFrame:
    """A row per model, as an Arrow table: model_id, its slice and ``columns``."""
    table = {"model_id": pa.array(range(len(jobs)), pa.int32())}
    for i, (name, kind) in enumerate(zip(SLICE, (pa.int32(), pa.int32(), pa.string()), strict=True)):
        table[name] = pa.array([j.slice[i] for j in jobs], kind)
    table |= {name: pa.array(values, types.get(name)) for name, values in columns.items()}
    return spark.createDataFrame(pa.table(table))


def _fit(patterns: DataFrame, jobs: list[_Job]) -> dict[tuple, Fit]:
    """Fit all models without calendar time in one job, from the small pattern tables."""
    if not jobs:
        return {}
    slots = [t for t in SLOTS if any(t in j.terms for j in jobs)]
    columns = {"var": [j.var for j in jobs], "model": [j.model for j in jobs], "only": [j.gender for j in jobs]}
    for i in range(3):
        columns[f"k{i + 1}"] = [float((j.knots or (0.0, 1.0, 2.0))[i]) for j in jobs]
    columns |= {f"use_{t}": [t in j.terms for j in jobs] for t in slots}
    table = _job_table(patterns.sparkSession, jobs, columns, {"only": pa.string()})
    male = "CAST(gender = 'Male' AS DOUBLE)"
    mid, old = "CAST(age BETWEEN 45 AND 64 AS DOUBLE)", "CAST(age >= 65 AS DOUBLE)"
    values = {
        "one": "1D",
        "value": "CAST(value AS DOUBLE)",
        "age": f"(age - {REFERENCE_AGE}) / 10D",
        "spline": spline_sql("age", "k1", "k2", "k3"),
        "male": male,
        "mid": mid,
        "old": old,
        "mid_male": f"{mid} * {male}",
        "old_male": f"{old} * {male}",
    }
    columns = [f"CASE WHEN use_{t} THEN {values[t]} ELSE 0D END AS x{i}" for i, t in enumerate(slots)]
    features = (
        patterns.join(F.broadcast(table), [*SLICE, "var", "model"])
        .where("only IS NULL OR only = gender")
        .selectExpr("model_id", "n", "y", *columns)
    )
    found = fit_models(features, {i: j.terms for i, j in enumerate(jobs)}, slots)
    return {(j.slice, j.name): found[i] for i, j in enumerate(jobs)}


def _fit_timed(cubes: DataFrame, changes: DataFrame, jobs: list[_Job], start: dict[tuple, Fit]) -> dict[tuple, Fit]:
    """Fit all models with calendar time in one job, from the cubes.

    A task gets the cube of one study cohort, slice and exposure, once for all outcomes, and what each
    outcome changes in it.  The changes follow the cube as signed rows; both are bounded by values, sexes, ages and days.
    """
    if not jobs:
        return {}
    numbers = {v: i + 1 for i, v in enumerate(variable_columns())}
    table = F.broadcast(_job_table(cubes.sparkSession, jobs, {"v": [numbers[j.var] for j in jobs]}, {"v": pa.int32()}))
    cell = [
        F.col("value").cast("double").alias("value"),
        (F.col("gender") == "Male").cast("double").alias("male"),
        F.col("age").cast("double").alias("age"),
        F.col("months").cast("double").alias("months"),
        F.col("n").cast("double").alias("n"),
    ]
    cube = ["study_id", "slice", "v"]
    base = cubes.join(table.select(*cube).distinct(), cube, "left_semi").select(*cube, *cell)
    keys = [F.col(c).alias(c) for c in cube]  # columns of its own, as both sides may come from one table
    moved = changes.join(table, [*SLICE, "v"]).select(*keys, "model_id", *cell, F.col("y").cast("double").alias("y"))
    wanted = []
    for j in jobs:
        known = start[(j.slice, j.name)]
        first = dict(zip((j.terms.index(t) for t in known.terms), known.beta.tolist(), strict=True))
        wanted.append((j.terms, j.knots, first if known.converged else None))

    def design(cells: pd.DataFrame, terms: list[str], knots: tuple | None) -> np.ndarray:
        age = cells["age"].to_numpy()
        values = {"one": np.ones(len(cells)), "age": (age - REFERENCE_AGE) / 10}
        values |= {name: cells[name].to_numpy() for name in ("value", "male", "months")}
        if knots:
            values["spline"] = spline_value(age, knots)
        return np.column_stack([values[t] for t in terms])

    def fit(base: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
        out, n, shared = [], base["n"].to_numpy(), (None, None)
        for m, own in moved.groupby("model_id"):
            terms, knots, first = wanted[m]
            if shared[0] != (terms, knots):  # outcomes often share their terms
                shared = (terms, knots), design(base, terms, knots)
            x = np.vstack([shared[1], design(own, terms, knots)])
            y = np.concatenate([np.zeros(len(base)), own["y"].to_numpy()])
            out.append((m, *newton(x, np.concatenate([n, own["n"].to_numpy()]), y, first)))
        return pd.DataFrame(out, columns=["model_id", "n", "status", "steps", "loglik", "beta", "cov"])

    fitted = base.groupBy(*cube).cogroup(moved.groupBy(*cube)).applyInPandas(fit, FITTED)
    found = fits_of(fitted, {i: j.terms for i, j in enumerate(jobs)})
    return {(j.slice, j.name): found[i] for i, j in enumerate(jobs)}


def _knots(patterns: DataFrame) -> dict[tuple, tuple[float, float, float]]:
    """10th, 50th and 90th percentile of age per slice, for all and by sex."""
    ages = patterns.where(F.col("var") == "age")
    both = ages.select(*SLICE, "age", "n", F.explode(F.array(F.lit("all"), F.col("gender"))).alias("who"))
    rows = (
        both.groupBy(*SLICE, "who")
        .agg(F.expr("percentile(age, array(0.1D, 0.5D, 0.9D), n)").alias("k"))
        .collect()
    )
    return {(r["study_id"], r["outcome_id"], r["slice"], r["who"]): tuple(r["k"]) for r in rows}


def _how(fit: Fit | None) -> tuple[str, int]:
    """How a model ended; one with an empty cell is separated before any fit."""
    return (fit.status, fit.steps) if fit else ("separated", 0)


def _ratio(fit: Fit | None, weights: dict[str, float]) -> tuple:
    if fit is None or not fit.converged:
        return None, None, None
    value, se = fit.contrast(weights)
    try:
        return tuple(math.exp(v) for v in (value, value - Z95 * se, value + Z95 * se))
    except OverflowError:
        return None, None, None


def odds_ratios(
    cubes: DataFrame, changes: DataFrame, patterns: DataFrame, interaction_test: str = "total"
) -> DataFrame:
    """All odds ratios of the study; cubes, changes and patterns are read often and should be kept tables.

    First the linear and spline age models and the age group by sex model of every
    slice are fitted together; they decide the form of age and whether age is reported
    by sex.  Then everything else is fitted together, and last the models with calendar
    time, which start from the ones without.  ``interaction_test``: Wald test
    on all five coefficients ("total") or on the two interaction terms ("interaction").
    """
    heads = (
        patterns.groupBy(*SLICE, "var", "model")
        .agg(
            F.sum("n").alias("n"),
            F.sum("y").alias("y"),
            F.sum(F.col("value") * F.col("n")).alias("n1"),
            F.sum(F.col("value") * F.col("y")).alias("y1"),
        )
        .collect()
    )
    dated = {
        (r["study_id"], r["outcome_id"], r["slice"])
        for r in changes.where(F.col("months").isNotNull()).select(*SLICE).distinct().collect()
    }
    totals = {(r["study_id"], r["outcome_id"], r["slice"]): (r["n"], r["y"]) for r in heads if r["var"] == "age"}
    knots = _knots(patterns)

    def usable_knots(where: tuple, who: str = "all"):
        k = knots.get((*where, who))
        return k if k and k[0] < k[1] < k[2] else None

    jobs = []
    crossed = ["mid", "old", "male", "mid_male", "old_male"]
    for s in totals:
        jobs.append(_Job(s, "linear", "age", BY_AGE_SEX, ["one", "age"]))
        if usable_knots(s):
            jobs.append(_Job(s, "spline", "age", BY_AGE_SEX, ["one", "age", "spline"], usable_knots(s)))
        jobs.append(_Job(s, "crossed", "age", BY_AGE_SEX, ["one", *crossed]))
    first = _fit(patterns, jobs)

    curved, by_sex = {}, {}
    for s in totals:
        line, curve, cross = (first.get((s, n)) for n in ("linear", "spline", "crossed"))
        # without both fits there is nothing to compare: age stays linear, and the status says why
        curved[s] = bool(curve and curve.converged and line.converged and curve.bic() < line.bic())
        by_sex[s] = False
        if cross.converged:
            tested = crossed if interaction_test == "total" else crossed[3:]
            by_sex[s] = chi2_tail(cross.wald(tested), len(tested)) < 0.05

    def age_terms(s: tuple) -> list[str]:
        return ["age", "spline"] if curved[s] else ["age"]

    jobs = []
    for s in totals:
        k = usable_knots(s) if curved[s] else None
        if by_sex[s]:
            for sex in ("Male", "Female"):
                own = usable_knots(s, sex) if curved[s] else None
                terms = ["one", "age", "spline"] if own else ["one", "age"]
                jobs.append(_Job(s, f"age {sex}", "age", BY_AGE_SEX, terms, own, sex))
        jobs.append(_Job(s, "sex", "age", BY_AGE_SEX, ["one", "male"]))
        jobs.append(_Job(s, "sex by age", "age", BY_AGE_SEX, ["one", "male", *age_terms(s)], k))
    exposures, hopeless = [], []
    for r in heads:
        s = (r["study_id"], r["outcome_id"], r["slice"])
        if r["var"] == "age" or s not in totals:
            continue
        k = usable_knots(s) if curved[s] else None
        forms = {r["model"]: ["one", "value"]}
        if r["model"] == BY_AGE_SEX:
            forms = {BY_AGE_SEX: ["one", "value", *age_terms(s), "male"]}
            if s in dated:
                forms[BY_TIME] = [*forms[BY_AGE_SEX], "months"]
        # With an empty cell the estimate is infinite; there is nothing to fit.
        finite = 0 < r["y1"] < r["n1"] and r["y1"] < r["y"] and r["n1"] - r["y1"] < r["n"] - r["y"]
        for model, terms in forms.items():
            job = _Job(s, f"{r['var']}|{model}", r["var"], model, terms, k)
            (exposures if finite else hopeless).append(job)
    jobs += [j for j in exposures if j.model != BY_TIME]
    second = _fit(patterns, jobs)
    timed = [j for j in exposures if j.model == BY_TIME]
    known = {(j.slice, j.name): second[(j.slice, f"{j.var}|{BY_AGE_SEX}")] for j in timed}
    second |= _fit_timed(cubes, changes, timed, known)

    rows = []
    for s, (n, y) in totals.items():
        for sex in ("Male", "Female"):
            if by_sex[s]:
                fit, k = second[(s, f"age {sex}")], usable_knots(s, sex)
            else:
                fit, k = first[(s, "spline" if curved[s] else "linear")], usable_knots(s)
            for age in AGES:
                weights = {"age": (age - REFERENCE_AGE) / 10}
                if "spline" in fit.terms:
                    weights["spline"] = spline_value(age, k) - spline_value(REFERENCE_AGE, k)
                ratio = _ratio(fit, weights)
                rows.append((*s, "Age", None, sex, n, y, *ratio, REFERENCE_AGE, age, "overall", *_how(fit)))
        for name, label in (("sex", UNADJUSTED), ("sex by age", BY_AGE)):
            ratio = _ratio(second[(s, name)], {"male": 1.0})
            how = _how(second[(s, name)])
            rows.append((*s, "Sex (Male:Female)", label, None, n, y, *ratio, None, None, "overall", *how))
    for j in exposures + hopeless:
        fit = second.get((j.slice, j.name))
        ratio = _ratio(fit, {"value": 1.0})
        rows.append((*j.slice, j.var, j.model, None, None, None, *ratio, None, None, "overall", *_how(fit)))
    return patterns.sparkSession.createDataFrame(rows, RESULT)


def unadjusted_ratios(patterns: DataFrame) -> DataFrame:
    """Unadjusted odds ratios in closed form from the four counts; NULL when one is zero."""
    tables = patterns.where(F.col("model") == UNADJUSTED).select(
        *SLICE, "var", F.col("value").alias("exposed"), "n", "y"
    )
    by_sex = patterns.where(F.col("var") == "age").select(
        *SLICE,
        F.lit("Sex (Male:Female)").alias("var"),
        (F.col("gender") == "Male").cast("int").alias("exposed"),
        "n",
        "y",
    )

    def total(value, exposed: int):
        return F.sum(F.when(F.col("exposed") == exposed, value).otherwise(0)).cast("double")

    events, others = F.col("y"), F.col("n") - F.col("y")
    counts = (
        tables.unionByName(by_sex)
        .groupBy(*SLICE, "var")
        .agg(
            total(events, 1).alias("a"),
            total(others, 1).alias("b"),
            total(events, 0).alias("c"),
            total(others, 0).alias("d"),
        )
    )
    full = (F.col("a") > 0) & (F.col("b") > 0) & (F.col("c") > 0) & (F.col("d") > 0)
    log_or = F.when(full, F.log(F.expr("try_divide(a * d, b * c)")))
    se = F.sqrt(sum((F.try_divide(F.lit(1.0), F.col(x)) for x in "bcd"), F.try_divide(F.lit(1.0), F.col("a"))))
    return counts.select(
        *SLICE,
        "var",
        F.exp(log_or).alias("or"),
        F.exp(log_or - Z95 * se).alias("or_low"),
        F.exp(log_or + Z95 * se).alias("or_high"),
    )
