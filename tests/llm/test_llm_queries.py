"""The registered queries on the smallest tables: against their SQL, or for what they must hold."""

from __future__ import annotations

import pytest

from checks import compare
from cohortide.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    _, problems = compare.differences(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])
    assert not problems


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"op13_spelling"}))
def test_query_returns_every_row(spark, name):
    table = "pages" if name == "op4_html_extract" else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    got = registry.QUERIES[name](spark, SF).select(key)
    want = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
