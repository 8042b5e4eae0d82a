"""Column layouts of the clinical tables, the cohort tables and the results."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


PERSON = _struct(
    ("person_id", T.LongType()),
    ("gender_concept_id", T.IntegerType()),
    ("year_of_birth", T.IntegerType()),
    ("month_of_birth", T.IntegerType()),
    ("day_of_birth", T.IntegerType()),
)
OBSERVATION_PERIOD = _struct(
    ("observation_period_id", T.LongType()),
    ("person_id", T.LongType()),
    ("observation_period_start_date", T.DateType()),
    ("observation_period_end_date", T.DateType()),
)
CONDITION_OCCURRENCE = _struct(
    ("condition_occurrence_id", T.LongType()),
    ("person_id", T.LongType()),
    ("condition_concept_id", T.LongType()),
    ("condition_start_date", T.DateType()),
    ("condition_end_date", T.DateType()),
    ("visit_occurrence_id", T.LongType()),
)
DRUG_EXPOSURE = _struct(
    ("drug_exposure_id", T.LongType()),
    ("person_id", T.LongType()),
    ("drug_concept_id", T.LongType()),
    ("drug_source_concept_id", T.LongType()),
    ("drug_exposure_start_date", T.DateType()),
    ("drug_exposure_end_date", T.DateType()),
    ("days_supply", T.IntegerType()),
    ("visit_occurrence_id", T.LongType()),
)
DRUG_ERA = _struct(
    ("person_id", T.LongType()),
    ("drug_concept_id", T.LongType()),
    ("drug_era_start_date", T.DateType()),
    ("drug_era_end_date", T.DateType()),
)
MEASUREMENT = _struct(
    ("measurement_id", T.LongType()),
    ("person_id", T.LongType()),
    ("measurement_concept_id", T.LongType()),
    ("measurement_date", T.DateType()),
    ("value_as_number", T.DoubleType()),
    ("unit_concept_id", T.IntegerType()),
    ("value_as_concept_id", T.IntegerType()),
    ("visit_occurrence_id", T.LongType()),
)
OBSERVATION = _struct(
    ("observation_id", T.LongType()),
    ("person_id", T.LongType()),
    ("observation_concept_id", T.LongType()),
    ("observation_source_concept_id", T.LongType()),
    ("observation_date", T.DateType()),
    ("value_as_concept_id", T.IntegerType()),
    ("visit_occurrence_id", T.LongType()),
)
CONCEPT = _struct(("concept_id", T.LongType()), ("invalid_reason", T.StringType()))
CONCEPT_ANCESTOR = _struct(
    ("ancestor_concept_id", T.LongType()),
    ("descendant_concept_id", T.LongType()),
)

CLINICAL_TABLES = {
    "person": PERSON,
    "observation_period": OBSERVATION_PERIOD,
    "condition_occurrence": CONDITION_OCCURRENCE,
    "drug_exposure": DRUG_EXPOSURE,
    "drug_era": DRUG_ERA,
    "measurement": MEASUREMENT,
    "observation": OBSERVATION,
    "concept": CONCEPT,
    "concept_ancestor": CONCEPT_ANCESTOR,
}

# One line of a concept set: a code, and whether everything below it counts too.
CONCEPT_SET = _struct(
    ("codeset", T.StringType()),
    ("concept_id", T.LongType()),
    ("include_descendants", T.BooleanType()),
)

COHORT = _struct(
    ("cohort_definition_id", T.LongType()),
    ("subject_id", T.LongType()),
    ("cohort_start_date", T.DateType()),
    ("cohort_end_date", T.DateType()),
)
MANIFEST = _struct(
    ("atlasId", T.IntegerType()),
    ("atlasName", T.StringType()),
    ("cohortId", T.IntegerType()),
    ("name", T.StringType()),
)
