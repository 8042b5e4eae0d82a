from __future__ import annotations

import dataclasses
import datetime as dt
import random
import re

import pytest
from table_rows import day, rows
from pyspark.sql import functions as F

from cohortide.operators import eras, events
from cohortide.plans.definitions import PLATELET_UNITS
from cohortide.plans.specs import Criterion
from cohortide.sources.literals import literal_table


def brute_force_eras(spans, pad):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1] + dt.timedelta(pad):
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def spans_df(spark, data):
    return literal_table(spark, data, "person_id long, start_date date, end_date date")


@pytest.mark.parametrize("pad", [0, 30, 180])
def test_collapse_equals_brute_force(spark, pad):
    rnd = random.Random(pad)
    data = []
    for _ in range(400):
        s = dt.date(2020, 1, 1) + dt.timedelta(rnd.randrange(900))
        data.append((rnd.randrange(30), s, s + dt.timedelta(rnd.randrange(40))))
    want = [
        (p, s, e)
        for p in range(30)
        for s, e in brute_force_eras([(a, b) for q, a, b in data if q == p], pad)
    ]
    assert rows(eras.collapse(spans_df(spark, data), ["person_id"], pad)) == sorted(want)


def test_collapse_edges(spark):
    data = [
        (1, day("2020-01-01"), day("2020-01-10")),
        (1, day("2020-01-10"), day("2020-01-12")),  # touches
        (2, day("2020-01-01"), day("2020-01-31")),
        (2, day("2020-01-05"), day("2020-01-06")),  # nested
        (3, day("2020-01-01"), day("2020-01-02")),
        (3, day("2020-02-01"), day("2020-02-02")),  # gap of 30
        (4, day("2020-01-01"), day("2020-01-02")),
        (4, day("2020-02-02"), day("2020-02-03")),  # gap of 31
    ]
    got = rows(eras.collapse(spans_df(spark, data), ["person_id"], 30))
    assert got == [
        (1, day("2020-01-01"), day("2020-01-12")),
        (2, day("2020-01-01"), day("2020-01-31")),
        (3, day("2020-01-01"), day("2020-02-02")),
        (4, day("2020-01-01"), day("2020-01-02")),
        (4, day("2020-02-02"), day("2020-02-03")),
    ]


def test_collapse_pad_by_row(spark):
    data = [(p, day("2020-01-01"), day("2020-01-02")) for p in (1, 2)]
    data += [(p, day("2020-01-20"), day("2020-01-21")) for p in (1, 2)]
    spans = spans_df(spark, data).withColumn("pad", F.when(F.col("person_id") == 1, 0).otherwise(30))
    assert len(rows(eras.collapse(spans, ["person_id"], F.col("pad")))) == 3


def test_drug_end_fallbacks(spark, cdm_of, codes_of):
    cdm = cdm_of(
        drug_exposure=[
            (1, 1, 10, None, "2021-01-01", "2021-01-05", 3),
            (2, 2, 10, None, "2021-01-01", None, 3),
            (3, 3, 10, None, "2021-01-01", None, None),
            (4, 4, 99, 10, "2021-01-01", None, None),
        ]
    )
    codes = codes_of(a=[10])
    got = rows(events.extract_events(cdm, codes, [Criterion("drug_exposure", "a")]).drop("criterion_id"))
    assert got == [
        (1, day("2021-01-01"), day("2021-01-05")),
        (2, day("2021-01-01"), day("2021-01-04")),
        (3, day("2021-01-01"), day("2021-01-02")),
    ]
    both = [Criterion("drug_exposure", "a"), Criterion("drug_exposure", "a", "source")]
    by = rows(events.extract_events(cdm, codes, both).groupBy("criterion_id").count())
    assert by == [(0, 3), (1, 1)]


def test_measurement_bounds_and_units(cdm_of, codes_of):
    values = [10.0, 150.0, 9.9, 150.1, 100.0, 100.0]
    units = [8848, 8961, 8848, 8848, None, 8647]
    cdm = cdm_of(
        measurement=[(i, i, 5, "2021-01-01", v, u) for i, (v, u) in enumerate(zip(values, units))]
    )
    codes = codes_of(p=[5])
    with_units = Criterion("measurement", "p", value_min=10.0, value_max=150.0, units=PLATELET_UNITS)
    any_unit = Criterion("measurement", "p", value_min=10.0, value_max=150.0)
    got = events.extract_events(cdm, codes, [with_units, any_unit])
    assert rows(got.select("criterion_id", "person_id")) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 4), (1, 5)]


def test_date_bounds(cdm_of, codes_of):
    cdm = cdm_of(
        condition_occurrence=[(i, i, 7, f"2020-12-0{i}", None) for i in (1, 2)],
        observation=[(1, 1, 7, None, "2020-12-01", 4), (2, 2, 7, None, "2020-12-01", 5)],
    )
    codes = codes_of(c=[7])
    after = Criterion("condition_occurrence", "c", after=day("2020-12-01"))
    from_ = Criterion("condition_occurrence", "c", not_before=day("2020-12-01"))
    coded = Criterion("observation", "c", value_concepts=(4,))
    got = events.extract_events(cdm, codes, [after, from_, coded])
    assert rows(got.select("criterion_id", "person_id")) == [(0, 2), (1, 1), (1, 2), (2, 1)]


def test_compact_by_day_bounds_rows_per_person(spark):
    """A person with most of the raw rows keeps one row per day and the exact count."""
    raw = spark.range(30_000).selectExpr(
        "0 AS criterion_id",
        "CASE WHEN id % 3 = 0 THEN 1L ELSE id + 1 END AS person_id",
        "date_add(DATE'2020-01-01', CAST(id % 50 AS INT)) AS start_date",
        "date_add(DATE'2020-01-02', CAST(id % 70 AS INT)) AS end_date",
    )
    days = events.compact_by_day(raw, "criterion_id").where("person_id = 1")
    got = days.agg(F.count("*"), F.sum("n")).first()
    assert tuple(got) == (50, 10_000)


@pytest.mark.parametrize("most", [1000, 2])
def test_membership_and_bounds_reach_the_reader(spark, tmp_path, cdm_of, codes_of, monkeypatch, most):
    """Codes far apart, each with its own bound: rows of codes between them, or before their own bound, stop at the scan."""
    drugs = [(code, start) for code in (5, 500, 90_000_000) for start in ("2019-06-01", "2020-06-01", "2021-06-01")] * 3
    made = cdm_of(drug_exposure=[])
    names = made.drug_exposure.columns
    rows_ = [{n: None for n in names} | {"person_id": p % 7, "drug_concept_id": code, "drug_exposure_start_date": day(start)} for p, (code, start) in enumerate(drugs)]
    table = literal_table(spark, [tuple(r[n] for n in names) for r in rows_], made.drug_exposure.schema)
    table.write.parquet(f"{tmp_path}/drug")
    made = dataclasses.replace(made, drug_exposure=spark.read.parquet(f"{tmp_path}/drug"))
    codes = codes_of(near=[5, 6], far=[90_000_000])
    criteria = [Criterion("drug_exposure", "near", after=day("2020-01-01")), Criterion("drug_exposure", "far", not_before=day("2021-01-01"))]
    monkeypatch.setattr(events._wanted_codes, "__defaults__", (most, events.TILES))
    found = events.extract_events(made, codes, criteria)
    assert rows(found.groupBy("criterion_id").count()) == [(0, 6), (1, 3)]
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")  # else filters are cut in the text of the plan
    plan = events.extract_events(made, codes, criteria)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan)
    assert any("90000000" in p and "2021-01-01" in p and "2020-01-01" in p for p in pushed)
    wanted = events._wanted_codes(codes.select(F.lit("drug_exposure").alias("domain"), F.lit("standard").alias("concept"), F.lit(None).cast("date").alias("bound"), "concept_id"), most)
    assert [(r["lo"], r["hi"]) for r in sorted(wanted, key=lambda r: r["lo"])] == [(5, 5), (6, 6), (90_000_000, 90_000_000)]
    assert all((r["codes"] is None) == (most == 2) for r in wanted)
    passing = events._domain_rows(made, "drug_exposure").where(events._reader_test(wanted, "drug_exposure"))
    assert passing.count() == 18  # none of code 500, though it lies between


def test_many_codes_are_covered_by_few_ranges(spark):
    codes = spark.range(5000).select(F.lit("d").alias("domain"), F.lit("standard").alias("concept"), F.lit(None).cast("date").alias("bound"), (F.col("id") * F.when(F.col("id") < 2500, 1).otherwise(1000)).alias("concept_id"))
    wanted = events._wanted_codes(codes)
    assert len(wanted) <= events.TILES and all(r["codes"] is None for r in wanted)
    spans = sorted((r["lo"], r["hi"]) for r in wanted)
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert codes.withColumn("standard", F.col("concept_id")).where(events._reader_test(wanted, "d")).count() == 5000


def test_a_code_is_tested_once_for_all_bounds(spark):
    """A code that some criterion wants from any date on needs no test of a later bound."""
    codes = literal_table(spark, [(5, None), (5, day("2020-01-01")), (6, day("2021-01-01")), (6, day("2020-01-01"))], "concept_id long, bound date")
    lookup = codes.select(F.lit("d").alias("domain"), F.lit("standard").alias("concept"), "bound", "concept_id")
    assert sorted((r["codes"], str(r["bound"])) for r in events._wanted_codes(lookup)) == [([5], "None"), ([6], "2020-01-01")]


def test_days_are_shuffled_once_for_all_criteria_of_a_row(spark, cdm_of, codes_of):
    sets = {f"set{i}": [10] for i in range(70)}  # more than a mask holds
    criteria = [Criterion("drug_exposure", name, kind) for name in sets for kind in ("standard", "source")]
    criteria.append(Criterion("drug_exposure", "set0", after=day("2021-06-01")))
    made = cdm_of(drug_exposure=[(i, i % 5, 10, 10 if i % 2 else 9, f"2021-0{1 + i % 9}-01") for i in range(400)])
    codes = codes_of(**sets)
    (days,) = events.extract_days(made, codes, criteria)
    old = events.compact_by_day(events.extract_events(made, codes, criteria), "criterion_id")
    assert rows(days.select(*old.columns)) == rows(old)
    assert old.agg(F.sum("n")).first()[0] == 70 * 400 + 70 * 200 + sum(1 + i % 9 > 6 for i in range(400))
    text = days._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(mask_0#\S+, mask_1#\S+, mask_2#\S+, person_id", text)  # combined before criteria get rows


def test_eras_shuffle_exposures_once(spark):
    used = spark.range(20).selectExpr(
        "id % 3 AS person_id", "id % 2 AS drug_concept_id", "date_add(DATE'2021-01-01', CAST(id AS INT)) AS drug_exposure_start_date",
        "CAST(NULL AS DATE) AS drug_exposure_end_date", "5 AS days_supply")
    found = eras.drug_eras(used)
    assert len(re.findall("Exchange hashpartitioning", found._jdf.queryExecution().executedPlan().toString())) == 1
    assert found.count() == 6
