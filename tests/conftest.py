from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from checks import registry  # noqa: E402
from cohortide import schemas  # noqa: E402
from cohortide.operators.eras import drug_eras  # noqa: E402
from cohortide.sources.cdm import Cdm  # noqa: E402
from cohortide.sources.literals import literal_table  # noqa: E402
from table_rows import day  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    registry.prepare(session)
    yield session
    session.stop()


def _date(v):
    return day(v) if isinstance(v, str) and len(v) == 10 and v[4] == "-" else v


@pytest.fixture(scope="session")
def cdm_of(spark):
    """Build clinical tables from rows of (possibly short) tuples; dates as text."""

    def build(**tables) -> Cdm:
        frames = {}
        for name, schema in schemas.CLINICAL_TABLES.items():
            rows = [tuple(map(_date, r)) + (None,) * (len(schema) - len(r)) for r in tables.get(name, [])]
            frames[name] = literal_table(spark, rows, schema)
        if "drug_era" not in tables:
            frames["drug_era"] = drug_eras(frames["drug_exposure"])
        return Cdm(spark=spark, **frames)

    return build


@pytest.fixture(scope="session")
def codes_of(spark):
    def build(**sets):
        rows = [(n, c) for n, codes in sets.items() for c in codes]
        return literal_table(spark, rows, "codeset string, concept_id long")

    return build
