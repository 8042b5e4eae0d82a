"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from checks import compare, registry

SF = "/root/testdata/sf0.001"
#: Results that must not be empty even with so few people.
FILLED = {"study_population", "survival_by_strata", "characteristics", "population_sample", "replaced_cohorts", "result_labels"}
QUERIES = {name: query for name, query in entry_points.queries().items() if name in registry.QUERIES}
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, problems = compare.differences(QUERIES[name](spark, SF), con, SQL[name])
    assert not problems
    if name in FILLED:
        assert rows > 0


def test_every_query_has_sql():
    assert not set(QUERIES) - set(SQL)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "surv" in df.columns
