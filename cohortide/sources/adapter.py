"""Clinical tables derived from the TPC-H style test tables.

Customers become people, orders become conditions and observation periods, line items
become drug exposures and logged events become measurements and observations.  Plain
arithmetic only, so another engine can derive the same rows.  Dates keep the range of
the source tables, hence the shifted ``CALENDAR``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortide.operators.concepts import concept_set_table
from cohortide.operators.eras import drug_eras
from cohortide.plans.definitions import CONDITIONS, DRUGS, Calendar
from cohortide.sources.literals import literal_table
from cohortide.sources.cdm import Cdm

CALENDAR = Calendar(
    vaccines_after=dt.date(1998, 1, 1),
    observed_since=dt.date(1997, 1, 1),
    general_population=dt.date(1997, 1, 1),
    drug_eras_from=dt.date(1997, 6, 1),
    drug_template_from=dt.date(1996, 1, 1),
    covid_from_year=1997,
)

# Concept sets in terms of the derived codes: name -> (codes, include descendants).
CODESETS = {
    "vaccine_AZ": ([300000, 310000, 320000, 330000], False),
    "vaccine_pfizer": ([300001, 310001, 320001, 330001], False),
    "vaccine_moderna": ([300002, 310002, 320002, 330002], False),
    "vaccine_janssen": ([300003, 310003, 320003, 330003], False),
    "vaccine_any": ([base + i for base in (300000, 310000, 320000, 330000) for i in range(4)], False),
    "vaccine_mrna": ([base + i for base in (300000, 310000, 320000, 330000) for i in (1, 2)], False),
    "cvst": (list(range(500032, 500035)), False),
    "dvt": (list(range(500000, 500014)), False),
    "pe": (list(range(500014, 500022)), False),
    "isc_stroke": (list(range(500018, 500028)), False),
    "mi": (list(range(500022, 500032)), False),
    "svt": (list(range(500035, 500037)), False),
    "ate": (list(range(500018, 500034)), False),
    "thrombocytopenia": (list(range(500037, 500040)), False),
    "platelets": ([720000], True),
    "platelets_any_unit": ([600001], False),
    "covid_diagnosis": (list(range(500004, 500008)) + [650005], False),
    "covid_test": ([600002], False),
    "smoking_observation": ([650002], False),
    "smoking_question": ([650003], False),
    "smoking_answer": ([650004], False),
    "smoking_condition": ([500039], False),
    "drug_class": ([700002], True),
    "condition_class": ([710003], True),
}
CONDITION_TOPS = {name: 710000 + i for i, name in enumerate(CONDITIONS)}
DRUG_TOPS = {name: 700000 + i for i, name in enumerate(DRUGS)}

# Codes that exist besides the parts: first code and how many.
_CODE_RANGES = (
    (300000, 4),
    (310000, 4),
    (320000, 4),
    (330000, 4),
    (500000, 40),
    (600000, 4),
    (650000, 6),
    (700000, 10),
    (710000, 13),
    (720000, 1),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def person(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey AS person_id",
        "CAST(CASE WHEN c_custkey % 97 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN 8507 ELSE 8532 END AS INT)"
        " AS gender_concept_id",
        "CAST(1910 + c_custkey % 75 AS INT) AS year_of_birth",
        "CAST(1 + c_custkey % 12 AS INT) AS month_of_birth",
        "CAST(1 + c_custkey % 28 AS INT) AS day_of_birth",
    )


def observation_period(orders: DataFrame) -> DataFrame:
    """First to last order; every 53rd person has a second, later period."""
    span = orders.groupBy(F.col("o_custkey").alias("person_id")).agg(
        F.min("o_orderdate").cast("date").alias("first_day"),
        F.max("o_orderdate").cast("date").alias("last_day"),
    )
    periods = F.expr(
        "CASE WHEN person_id % 53 = 0 THEN array(struct(0L AS k, first_day AS s, last_day AS e), "
        "struct(1L AS k, date_add(last_day, 30) AS s, date_add(last_day, 400) AS e)) "
        "ELSE array(struct(0L AS k, first_day AS s, last_day AS e)) END"
    )
    return span.select("person_id", F.inline(periods)).selectExpr(
        "person_id * 2 + k AS observation_period_id",
        "person_id",
        "s AS observation_period_start_date",
        "e AS observation_period_end_date",
    )


def drug_exposure(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Shipments to the ordering customer.

    The exposure id is not unique, as line numbers repeat within an order.
    """
    shipped = lineitem.withColumn("ship", F.col("l_shipdate").cast("date")).selectExpr(
        "l_orderkey",
        "l_orderkey * 10 + l_linenumber AS drug_exposure_id",
        "ship AS drug_exposure_start_date",
        "CASE WHEN l_linenumber % 3 <> 0 THEN date_add(ship, CAST(l_quantity AS INT)) END"
        " AS drug_exposure_end_date",
        "CASE WHEN l_suppkey % 2 <> 0 THEN CAST(l_quantity AS INT) END AS days_supply",
        # rows of their own, so that tests of a code read a column and don't repeat the expression
        "inline(array(struct("
        "CASE WHEN l_partkey % 40 <= 3 AND ship > DATE'1998-01-01' THEN 300000 + l_partkey % 40"
        " ELSE l_partkey END AS drug_concept_id, "
        "CASE WHEN l_linenumber = 7 AND l_suppkey % 50 <= 3 AND ship > DATE'1998-01-01'"
        " THEN 310000 + l_suppkey % 50 ELSE 100000 + l_suppkey END AS drug_source_concept_id)))",
    )
    buyers = orders.select("o_orderkey", F.col("o_custkey").alias("person_id"))
    return shipped.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "drug_exposure_id",
        "person_id",
        "drug_concept_id",
        "drug_source_concept_id",
        "drug_exposure_start_date",
        "drug_exposure_end_date",
        "days_supply",
        "CAST(NULL AS BIGINT) AS visit_occurrence_id",
    )


def condition_occurrence(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS condition_occurrence_id",
        "o_custkey AS person_id",
        "500000 + o_orderkey % 40 AS condition_concept_id",
        "CAST(o_orderdate AS DATE) AS condition_start_date",
        "CASE WHEN o_orderstatus <> 'P' THEN date_add(CAST(o_orderdate AS DATE), 3) END AS condition_end_date",
        "CAST(NULL AS BIGINT) AS visit_occurrence_id",
    )


def measurement(events: DataFrame) -> DataFrame:
    return events.where("event_type <> 'signup'").selectExpr(
        "event_id AS measurement_id",
        "user_id AS person_id",
        "CASE event_type WHEN 'click' THEN 600000L WHEN 'error' THEN 600001L WHEN 'purchase' THEN 600002L"
        " ELSE 600003L END AS measurement_concept_id",
        "date_add(DATE'1998-01-01', CAST(event_id % 1000 AS INT)) AS measurement_date",
        "CASE WHEN event_id % 3 = 1 THEN value * 1000 ELSE value END AS value_as_number",
        "CASE event_id % 3 WHEN 0 THEN 8848 WHEN 1 THEN 8647 END AS unit_concept_id",
        "CASE WHEN event_id % 7 = 0 THEN 9191 END AS value_as_concept_id",
        "CAST(NULL AS BIGINT) AS visit_occurrence_id",
    )


def observation(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'signup'").selectExpr(
        "event_id AS observation_id",
        "user_id AS person_id",
        "CASE WHEN event_id % 40 = 0 THEN 320000 + (event_id DIV 40) % 4 ELSE 650000 + event_id % 6 END"
        " AS observation_concept_id",
        "CASE WHEN event_id % 41 = 0 THEN 330000 + (event_id DIV 41) % 4 WHEN event_id % 2 = 0 THEN 650001L END"
        " AS observation_source_concept_id",
        "date_add(DATE'1998-01-01', CAST(event_id % 1000 AS INT)) AS observation_date",
        "CASE event_id % 5 WHEN 0 THEN 4034855 WHEN 1 THEN 45884037 END AS value_as_concept_id",
        "CAST(NULL AS BIGINT) AS visit_occurrence_id",
    )


def _other_codes(spark: SparkSession) -> DataFrame:
    rows = [(first + i,) for first, count in _CODE_RANGES for i in range(count)]
    return literal_table(spark, rows, "concept_id long")


def concept(spark: SparkSession, part: DataFrame) -> DataFrame:
    """Part keys are drug codes; the largest parts are withdrawn codes."""
    drugs = part.selectExpr("p_partkey AS concept_id", "CASE WHEN p_size = 50 THEN 'D' END AS invalid_reason")
    others = _other_codes(spark).withColumn("invalid_reason", F.lit(None).cast("string"))
    return drugs.unionByName(others)


def concept_ancestor(spark: SparkSession, part: DataFrame) -> DataFrame:
    """Ten drug classes, thirteen condition groups, one measurement group, and self rows."""
    others = _other_codes(spark)
    drugs = part.selectExpr("700000 + p_partkey % 10 AS ancestor_concept_id", "p_partkey AS descendant_concept_id")
    groups = others.where("concept_id BETWEEN 500000 AND 500039").selectExpr(
        "710000 + (concept_id - 500000) % 13 AS ancestor_concept_id", "concept_id AS descendant_concept_id"
    )
    labs = others.where("concept_id BETWEEN 600000 AND 600003").selectExpr(
        "720000L AS ancestor_concept_id", "concept_id AS descendant_concept_id"
    )
    selves = others.selectExpr("concept_id AS ancestor_concept_id", "concept_id AS descendant_concept_id")
    own = part.selectExpr("p_partkey AS ancestor_concept_id", "p_partkey AS descendant_concept_id")
    return drugs.unionByName(groups).unionByName(labs).unionByName(selves).unionByName(own)


def open_test_tables(spark: SparkSession, sf_dir: str) -> Cdm:
    orders = _table(spark, sf_dir, "orders")
    part = _table(spark, sf_dir, "part")
    logged = _table(spark, sf_dir, "events")
    exposure = drug_exposure(_table(spark, sf_dir, "lineitem"), orders)
    return Cdm(
        spark=spark,
        person=person(_table(spark, sf_dir, "customer")),
        observation_period=observation_period(orders),
        condition_occurrence=condition_occurrence(orders),
        drug_exposure=exposure,
        drug_era=drug_eras(exposure),
        measurement=measurement(logged),
        observation=observation(logged),
        concept=concept(spark, part),
        concept_ancestor=concept_ancestor(spark, part),
    )


def concept_set_definitions(spark: SparkSession) -> DataFrame:
    return concept_set_table(spark, CODESETS)
