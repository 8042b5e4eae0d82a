"""Every registered query: a function of the study on the test tables, and its SQL.

Queries share one ``Study`` per session and data folder, so the clinical tables are
scanned once and later queries start from the kept tables.
"""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import cohort_sql, model_sql, study_sql
from checks.clinical_sql import packed, with_tables
from cohortide.functions import dates, numbers
from cohortide.operators import attrition, cohort, concepts, covariates, eras, events, models, population, summaries
from cohortide.operators import followup
from cohortide import schemas
from cohortide.plans import definitions as d, manifest
from cohortide.plans.specs import CohortSpec, Criterion
from cohortide.plans.study import Study
from cohortide.sources import adapter, tables
from cohortide.sources.literals import literal_table
from cohortide.sources.workspace import BUCKETS

CAL = adapter.CALENDAR
TEMPLATES = [
    d.smoking_spec(3),
    d.condition_template(4, "condition_history", "condition_class"),
    d.drug_template(5, "medication_use", "drug_class", CAL),
]
SPECS = d.exposure_specs(CAL) + d.outcome_specs() + d.covid_specs() + TEMPLATES
RULED = [s for s in SPECS if s.rules]

_studies: dict[tuple[str, str], Study] = {}


#: MB of the clinical tables for a person bucket: what a task sorts then stays in its memory.
BUCKET_MB = 8


def _table_mb(spark: SparkSession, sf_dir: str) -> float:
    where = [spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in ("customer", "orders", "lineitem", "events")]
    files = where[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(files.getContentSummary(w).getLength() for w in where) / 1e6


def prepare(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Settings of a cluster that a bare local session lacks: shared folder and number of buckets, more of them for large tables."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="cohortide-"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(width, spark.sparkContext.defaultParallelism)
    if sf_dir:
        buckets = max(buckets, math.ceil(_table_mb(spark, sf_dir) / BUCKET_MB))
        # small partitions of other shuffles are put together again
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(width, buckets)))
    spark.conf.set(BUCKETS, str(buckets))


def new_study(spark: SparkSession, sf_dir: str, **options) -> Study:
    prepare(spark, sf_dir)
    return Study(
        adapter.open_test_tables(spark, sf_dir),
        adapter.concept_set_definitions(spark),
        CAL,
        adapter.CONDITION_TOPS,
        adapter.DRUG_TOPS,
        extra_specs=TEMPLATES,
        **options,
    )


def study_for(spark: SparkSession, sf_dir: str) -> Study:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _studies:
        _studies[key] = new_study(spark, sf_dir, min_events=study_sql.MODEL_EVENTS)
    return _studies[key]


Query = Callable[[Study], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = (query, sql)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _curve_rounded(df: DataFrame) -> DataFrame:
    """Products of logarithms end on either side of a tie at the seventh decimal; both engines step past it."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(1e-9), 6) for c in ("surv", "lower", "upper")})


# ---- tables and vocabulary -----------------------------------------------------------

# table -> (its CTE, key, date column and its name in the CTE)
_SCANS = {
    "condition_occurrence": ("cond", "person_id", "condition_start_date", "s"),
    "drug_exposure": ("drug", "person_id", "drug_exposure_start_date", "s"),
    "measurement": ("meas", "person_id", "measurement_date", "s"),
    "observation": ("obs", "person_id", "observation_date", "s"),
    "observation_period": ("op", "person_id", "observation_period_start_date", "op_start"),
    "drug_era": ("drug_era", "person_id", "drug_era_start_date", "s"),
    "person": ("person", "person_id", None, None),
    "concept": ("concept", "concept_id", None, None),
    "concept_ancestor": ("(SELECT below AS descendant_concept_id FROM ancestor)", "descendant_concept_id", None, None),
}
_NO_DAY = "CAST(NULL AS DATE)"


def _table_scans(s: Study) -> DataFrame:
    parts = [
        getattr(s.cdm, t)
        .agg(
            F.count("*").alias("n"),
            F.count_distinct(key).alias("people"),
            F.expr(f"min({day or _NO_DAY})").alias("first_day"),
            F.expr(f"max({day or _NO_DAY})").alias("last_day"),
        )
        .withColumn("source", F.lit(t))
        for t, (_, key, day, _) in _SCANS.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_add(
    "table_scans",
    _table_scans,
    with_tables(
        study_sql.DRUG_ERA,
        " UNION ALL ".join(
            f"SELECT '{t}' AS source, count(*) AS n, count(DISTINCT {key}) AS people, "
            f"min({day or _NO_DAY}) AS first_day, max({day or _NO_DAY}) AS last_day FROM {c}"
            for t, (c, key, _, day) in _SCANS.items()
        ),
        (*cohort_sql.CLINICAL, "person", "concept", "ancestor"),
    ),
)
_add(
    "concept_set_literal",
    lambda s: concepts.literal_concepts(s.definitions, s.cdm.concept),
    with_tables(
        [],
        "SELECT DISTINCT codeset, CAST(concept_id AS BIGINT) AS concept_id FROM code_lines "
        "WHERE concept_id IN (SELECT concept_id FROM concept)",
        ("code_lines", "concept"),
    ),
)
_add(
    "concept_set_descendants",
    lambda s: concepts.descendant_concepts(s.definitions, s.cdm.concept, s.cdm.concept_ancestor),
    with_tables(
        [],
        "SELECT DISTINCT l.codeset, CAST(a.below AS BIGINT) AS concept_id FROM code_lines l "
        "JOIN ancestor a ON a.top = l.concept_id JOIN concept c ON c.concept_id = a.below "
        "WHERE l.deep AND c.invalid_reason IS NULL",
        ("code_lines", "concept", "ancestor"),
    ),
)
_add(
    "concept_sets",
    lambda s: s.codesets,
    with_tables([], "SELECT codeset, CAST(concept_id AS BIGINT) AS concept_id FROM codes", ("codes",)),
)
_TOPS = adapter.CONDITION_TOPS | adapter.DRUG_TOPS
_add(
    "ancestor_members",
    lambda s: concepts.ancestor_members(s.spark, _TOPS, s.cdm.concept_ancestor),
    with_tables(
        [],
        "SELECT DISTINCT CAST(top AS BIGINT) AS code, CAST(below AS BIGINT) AS concept_id FROM ancestor "
        f"WHERE top IN ({', '.join(map(str, _TOPS.values()))})",
        ("ancestor",),
    ),
)

# ---- events --------------------------------------------------------------------------

_CRITERIA = {
    "drug_exposure_events": Criterion("drug_exposure", "vaccine_AZ", after=CAL.vaccines_after),
    "drug_exposure_events_from": Criterion("drug_exposure", "drug_class", not_before=CAL.drug_template_from),
    "drug_source_events": Criterion("drug_exposure", "vaccine_any", "source"),
    "observation_events": Criterion("observation", "vaccine_any"),
    "observation_source_events": Criterion("observation", "vaccine_any", "source"),
    "observation_value_events": Criterion("observation", "smoking_question", value_concepts=(4034855,)),
    "condition_events": Criterion("condition_occurrence", "cvst"),
    "measurement_range_events": Criterion("measurement", "platelets_any_unit", value_min=10.0, value_max=150.0),
    "measurement_unit_events": d.low_platelets()[0],
    "measurement_thousands_events": d.low_platelets()[1],
    "measurement_coded_events": Criterion("measurement", "covid_test", value_concepts=d.POSITIVE_RESULTS),
}


def _events_of(c: Criterion) -> Query:
    return lambda s: events.extract_events(s.cdm, s.codesets, [c]).drop("criterion_id")


for _name, _c in _CRITERIA.items():
    _add(
        _name,
        _events_of(_c),
        with_tables(
            [("hit", cohort_sql.criterion(_c))],
            "SELECT person_id, s AS start_date, e AS end_date FROM hit",
            cohort_sql.CLINICAL,
        ),
    )

_LOW = " UNION ALL ".join(
    f"SELECT {i} AS criterion_id, * FROM ({cohort_sql.criterion(c)})" for i, c in enumerate(d.low_platelets())
)


def _low_platelet_events(s: Study) -> DataFrame:
    return events.extract_events(s.cdm, s.codesets, list(d.low_platelets()))


_add(
    "union_of_criteria",
    _low_platelet_events,
    with_tables(
        [("hit", _LOW)],
        "SELECT criterion_id, person_id, s AS start_date, e AS end_date FROM hit",
        cohort_sql.CLINICAL,
    ),
)
_add(
    "person_days",
    lambda s: events.compact_by_day(_low_platelet_events(s), "criterion_id"),
    with_tables(
        [("hit", _LOW)],
        "SELECT criterion_id, person_id, s AS start_date, count(*) AS n, min(e) AS min_end, max(e) AS max_end "
        "FROM hit GROUP BY 1, 2, 3",
        cohort_sql.CLINICAL,
    ),
)
_add(
    "long_observation_periods",
    lambda s: events.long_periods(s.periods, CAL.observed_since).drop("n_op"),
    with_tables(
        [],
        f"SELECT DISTINCT person_id, op_start, op_end FROM op WHERE op_start < DATE '{CAL.observed_since}' "
        "AND op_end - op_start >= 365",
        ("op",),
    ),
)
_add(
    "condition_code_list_events",
    lambda s: events.code_list_events(
        s.cdm.condition_occurrence,
        "condition_concept_id",
        "condition_start_date",
        concepts.ancestor_members(s.spark, adapter.CONDITION_TOPS, s.cdm.concept_ancestor),
    ),
    with_tables(
        [],
        "SELECT DISTINCT CAST(a.top AS BIGINT) AS code, c.person_id, c.s AS event_date FROM cond c "
        "JOIN ancestor a ON a.below = c.standard WHERE a.top BETWEEN 710000 AND 710012",
        ("cond", "ancestor"),
    ),
)

# ---- intervals -----------------------------------------------------------------------


def _condition_eras(s: Study) -> DataFrame:
    spans = events.extract_events(s.cdm, s.codesets, [Criterion("condition_occurrence", "ate")])
    parts = [
        eras.collapse(spans, ["person_id"], pad).withColumn("pad", F.lit(pad)) for pad in (0, 30, 180)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_add(
    "condition_eras",
    _condition_eras,
    with_tables(
        [("hit", cohort_sql.criterion(Criterion("condition_occurrence", "ate")))],
        " UNION ALL ".join(
            f"SELECT {pad} AS pad, person_id, s AS start_date, e AS end_date FROM ({packed('hit', ['person_id'], pad)})"
            for pad in (0, 30, 180)
        ),
        cohort_sql.CLINICAL,
    ),
)
_add(
    "drug_eras",
    lambda s: s.cdm.drug_era,
    with_tables(
        study_sql.DRUG_ERA,
        "SELECT person_id, standard AS drug_concept_id, s AS drug_era_start_date, e AS drug_era_end_date "
        "FROM drug_era",
        ("drug",),
    ),
)

# ---- cohort steps --------------------------------------------------------------------

_add(
    "numbered_events",
    lambda s: cohort.numbered_events(_low_platelet_events(s), s.periods),
    with_tables(
        [
            ("hit", _LOW),
            (
                "numbered",
                "SELECT h.person_id, h.s, h.e, op_start, op_end, row_number() OVER "
                "(PARTITION BY h.person_id ORDER BY h.s, h.e, op_start, op_end) AS k FROM hit h "
                "JOIN op ON op.person_id = h.person_id AND h.s BETWEEN op_start AND op_end",
            ),
        ],
        "SELECT person_id, s AS start_date, e AS end_date, op_start, op_end, count(*) AS n, min(k) AS event_id "
        "FROM numbered GROUP BY 1, 2, 3, 4, 5",
        cohort_sql.CLINICAL,
    ),
)


def _stage(specs: list[CohortSpec], select: str, needs=cohort_sql.CLINICAL) -> str:
    """UNION ALL of a SELECT over the CTEs of each spec; {p} is the CTE prefix, {id} the cohort."""
    ctes = [part for s in specs for part in cohort_sql.parts(s)]
    return with_tables(ctes, " UNION ALL ".join(select.format(p=f"p{s.id}", id=s.id) for s in specs), needs)


_add(
    "qualified_events",
    lambda s: cohort.qualified_events(s.cdm, s.days, s.periods, s.specs).select(
        "cohort_id", "person_id", "start_date", "op_start", "op_end", "n", "min_end", "max_end"
    ),
    _stage(
        SPECS,
        "SELECT CAST({id} AS BIGINT) AS cohort_id, person_id, s AS start_date, op_start, op_end, count(*) AS n, "
        "min(e) AS min_end, max(e) AS max_end FROM {p}_q GROUP BY 2, 3, 4, 5",
    ),
)


def _nearby_sql() -> str:
    ctes = [part for s in RULED for part in cohort_sql.parts(s)]
    selects = []
    for s in RULED:
        for r, rule in enumerate(s.rules):
            for k, near in enumerate(rule.nearby):
                cond = "a.person_id = q.person_id"
                if near.inside_period:
                    cond += " AND a.s BETWEEN q.op_start AND q.op_end"
                if near.first is not None:
                    cond += f" AND a.s >= q.s + ({near.first})"
                if near.last is not None:
                    cond += f" AND a.s <= q.s + ({near.last})"
                selects.append(
                    f"SELECT CAST({s.id} AS BIGINT) AS cohort_id, q.person_id, q.s AS start_date, q.op_start, q.op_end, "
                    f"{r} AS rule_id, {k} AS part, count(a.person_id) AS n_events "
                    f"FROM (SELECT DISTINCT person_id, s, op_start, op_end FROM p{s.id}_q) q "
                    f"LEFT JOIN ({cohort_sql.criterion(near.criterion)}) a ON {cond} GROUP BY 1, 2, 3, 4, 5, 6, 7"
                )
    return with_tables(ctes, " UNION ALL ".join(selects), cohort_sql.CLINICAL)


def _nearby_counts(s: Study) -> DataFrame:
    ids = {c: i for i, c in enumerate(cohort.criteria_of(s.specs))}
    rules = cohort._window_rules(s.spark, s.specs, ids)
    return cohort.count_nearby(s.masked, rules, s.days, s.periods).drop("at_least", "exactly", "match_any")


_add("nearby_event_counts", _nearby_counts, _nearby_sql())
_add(
    "inclusion_rules_met",
    lambda s: cohort.inclusion_hits(s.cdm, s.masked, s.days, s.periods, s.specs),
    with_tables(
        [part for s in RULED for part in cohort_sql.parts(s)],
        " UNION ALL ".join(
            f"SELECT DISTINCT CAST({s.id} AS BIGINT) AS cohort_id, q.person_id, q.s AS start_date, q.op_start, "
            f"q.op_end, {r} AS rule_id FROM p{s.id}_q q JOIN p{s.id}_r{r} USING (person_id, event_id)"
            for s in RULED
            for r in range(len(s.rules))
        ),
        cohort_sql.CLINICAL,
    ),
)
_add(
    "inclusion_masks",
    lambda s: s.masked.select("cohort_id", "person_id", "start_date", "op_start", "op_end", "mask", "n"),
    _stage(
        SPECS,
        "SELECT CAST({id} AS BIGINT) AS cohort_id, person_id, s AS start_date, op_start, op_end, mask, "
        "count(*) AS n FROM {p}_m GROUP BY 2, 3, 4, 5, 6",
    ),
)
_add(
    "included_events",
    lambda s: cohort.included_events(s.masked, s.specs).select(
        "cohort_id", "person_id", "start_date", "op_start", "op_end", "n"
    ),
    _stage(
        SPECS,
        "SELECT CAST({id} AS BIGINT) AS cohort_id, person_id, s AS start_date, op_start, op_end, count(*) AS n "
        "FROM {p}_i GROUP BY 2, 3, 4, 5",
    ),
)
_BEST = (
    "SELECT CAST({id} AS BIGINT) AS cohort_id, person_id, s AS start_date, op_start, op_end, mask FROM {p}_m "
    "QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY bit_count(mask) DESC, "
    "CASE WHEN mask = 0 THEN 0 ELSE instr(reverse(bin(mask)), '1') - 1 END, s, e, op_start, op_end) = 1"
)
_add(
    "best_events",
    lambda s: attrition.best_events(s.masked).select(
        "cohort_id", "person_id", "start_date", "op_start", "op_end", "mask"
    ),
    "SELECT * FROM (" + _stage(SPECS, "(" + _BEST + ")") + ")",
)


def _mask_ctes(specs: list[CohortSpec]) -> list[tuple[str, str]]:
    ctes = [part for s in specs for part in cohort_sql.parts(s)]
    every = " UNION ALL ".join(
        f"SELECT CAST({s.id} AS BIGINT) AS cohort_id, {len(s.rules)} AS rules, mask, 0 AS mode_id FROM p{s.id}_m"
        for s in specs
    )
    best = " UNION ALL ".join(
        f"SELECT cohort_id, {len(s.rules)}, mask, 1 FROM ({_BEST.format(p=f'p{s.id}', id=s.id)})" for s in specs
    )
    return [*ctes, ("masks", f"{every} UNION ALL {best}")]


_add(
    "inclusion_mask_counts",
    lambda s: attrition.mask_counts(s.masked),
    with_tables(
        _mask_ctes(SPECS),
        "SELECT cohort_id AS cohort_definition_id, mask AS inclusion_rule_mask, mode_id, count(*) AS person_count "
        "FROM masks GROUP BY 1, 2, 3",
        cohort_sql.CLINICAL,
    ),
)
_add(
    "inclusion_rule_statistics",
    lambda s: attrition.rule_statistics(attrition.mask_counts(s.masked), s.specs),
    with_tables(
        [
            *_mask_ctes(RULED),
            ("rule", "SELECT * FROM (VALUES " + ", ".join(
                f"({s.id}::BIGINT, {r}, '{rule.name.replace(chr(39), chr(39) * 2)}', {len(s.rules)}, {mode})"
                for s in RULED
                for r, rule in enumerate(s.rules)
                for mode in (0, 1)
            ) + ") v(id, r, name, n_rules, mode)"),
        ],
        "SELECT id AS cohort_definition_id, r AS rule_sequence, name, mode AS mode_id, "
        "count(*) FILTER ((mask >> r) & 1 = 1) AS person_count, "
        "count(*) FILTER ((mask >> r) & 1 = 0 AND bit_count(mask) = n_rules - 1) AS gain_count, "
        "count(mask) AS person_total FROM rule LEFT JOIN masks ON cohort_id = id AND mode_id = mode GROUP BY 1, 2, 3, 4",
        cohort_sql.CLINICAL,
    ),
)
_add(
    "inclusion_summary",
    lambda s: attrition.summary_statistics(attrition.mask_counts(s.masked), s.specs),
    with_tables(
        _mask_ctes(SPECS),
        "SELECT cohort_id AS cohort_definition_id, mode_id, count(*) AS base_count, "
        "count(*) FILTER (bit_count(mask) = rules) AS final_count FROM masks GROUP BY 1, 2",
        cohort_sql.CLINICAL,
    ),
)
_add(
    "cohort_intervals",
    lambda s: cohort.cohort_intervals(s.cdm, cohort.included_events(s.masked, s.specs), s.days, s.specs)
    .groupBy("cohort_id", "person_id", "start_date")
    .agg(F.max("end_date").alias("end_date")),
    _stage(
        SPECS,
        "SELECT CAST({id} AS BIGINT) AS cohort_id, person_id, s AS start_date, max(e) AS end_date "
        "FROM {p}_rows GROUP BY 2, 3",
    ),
)

# ---- cohorts -------------------------------------------------------------------------


def _cohort_query(id: int) -> Query:
    return lambda s: s.cohorts.where(F.col("cohort_definition_id") == id)


for _spec in SPECS:
    _add(
        "cohort_" + re.sub(r"\W+", "_", _spec.name).lower(), _cohort_query(_spec.id), cohort_sql.cohort(_spec)
    )


def _stored_cohorts(s: Study) -> DataFrame:
    path = f"{s.work.root}/stored_cohorts"
    tables.write_cohorts(s.exposures, path)
    return tables.read_cohorts(s.spark, path)


_EXPOSURE_PARTS = cohort_sql.all_rows(d.exposure_specs(CAL), "exposure")
_add(
    "stored_exposure_cohorts",
    _stored_cohorts,
    with_tables(
        _EXPOSURE_PARTS,
        "SELECT id AS cohort_definition_id, person_id AS subject_id, s AS cohort_start_date, "
        "e AS cohort_end_date FROM exposure",
        cohort_sql.CLINICAL,
    ),
)
_add(
    "cohort_counts",
    lambda s: cohort.enough_rows(s.cohorts),
    with_tables(
        cohort_sql.all_rows(SPECS, "everything"),
        "SELECT CAST(id AS BIGINT) AS cohort_definition_id, count(*) AS n FROM everything GROUP BY 1 "
        "HAVING count(*) > 5",
        cohort_sql.CLINICAL,
    ),
)
_add(
    "study_window",
    lambda s: s.exposures.where(F.col("cohort_definition_id") != 301)
    .agg(F.min("cohort_start_date").alias("first_vaccine"))
    .select(
        "first_vaccine", s.periods.select(F.max("op_end").alias("last_day")).scalar().alias("last_day")
    ),
    with_tables(
        _EXPOSURE_PARTS,
        "SELECT min(s) AS first_vaccine, (SELECT max(op_end) FROM op) AS last_day FROM exposure WHERE id <> 301",
        cohort_sql.CLINICAL,
    ),
)

# ---- populations and covariates --------------------------------------------------------

_add(
    "study_entries",
    lambda s: population.study_entries(s._large_enough(d.EXPOSURES), population.membership_table(s.spark)),
    study_sql.entries(),
)
_add(
    "study_population",
    lambda s: s.population_plain.drop("months_since_start", "year_of_birth"),
    study_sql.plain_population(),
)
_add(
    "months_since_start",
    lambda s: _rounded(s.population_plain, "months_since_start").select(
        "study_id", "person_id", "months_since_start"
    ),
    study_sql.months(),
)


def _band_counts(s: Study) -> DataFrame:
    bands = F.array(
        *(F.struct(F.lit(b).alias("band"), F.col(b).alias("level")) for b in ("age_gr", "age_gr2", "age_gr3"))
    )
    return (
        s.population.select("study_id", "gender", F.inline(bands))
        .groupBy("study_id", "band", "level", "gender")
        .agg(F.count("*").alias("n"))
    )


_add("age_band_counts", _band_counts, study_sql.band_counts())
_add("comorbidity_cohorts", lambda s: s.comorbidities, study_sql.comorbidities())
_add("medication_cohorts", lambda s: s.medications, study_sql.medications())


def _flag_query(columns: list[str]) -> Query:
    return lambda s: s.population.select("study_id", "person_id", *columns)


_COND_FLAGS = [f"{c}_all_history" for c in d.CONDITIONS]
_RECENT = [*d.DRUGS, covariates.COVID_FLAG]
_COMPOSITE = ["cond_comp", "drug_comp", "cond_drug_comp"]
for _name, _columns in (
    ("condition_history", _COND_FLAGS),
    ("recent_medication_and_infection", _RECENT),
    ("composite_flags", _COMPOSITE),
):
    _add(_name, _flag_query(_columns), study_sql.flags(_columns))
_add(
    "population_sample",
    lambda s: population.sample(s.population, 500, seed=7, edge_rows=20).select("study_id", "person_id", "index_date"),
    study_sql.sampled(500, 7),
)

# ---- follow-up and results -------------------------------------------------------------

_add("outcome_facts", lambda s: s.facts, study_sql.facts())
_add("open_pairs", lambda s: s.pairs, study_sql.pairs())
_add(
    "time_at_risk",
    lambda s: s.time_at_risk.select(
        "study_id", "outcome_id", "person_id", "event_date", "history_outcome", "f_u_outcome", "f_u_outcome_days"
    ),
    study_sql.time_at_risk(),
)


def _time_at_risk_earliest(s: Study) -> DataFrame:
    """Days at risk by the earliest end, and whether that is before the usual one."""
    key, days = ["study_id", "outcome_id", "person_id"], F.col("f_u_outcome_days")
    first = followup.time_at_risk(s.population, s.facts, s.pairs, earliest=True)
    usual = s.time_at_risk.select(*key, days.alias("usual"))
    rows = first.select(*key, "f_u_outcome", days).join(usual, key)
    return rows.select(*key, "f_u_outcome", days, (days < F.col("usual")).alias("shorter"))


_add("time_at_risk_earliest", _time_at_risk_earliest, study_sql.time_at_risk_earliest())


def _slice_counts(s: Study) -> DataFrame:
    from cohortide.operators.survival import slices

    cells = followup.count_cells(
        s.population, s.facts, s.pairs, {covariates.COVID_FLAG: F.col(covariates.COVID_FLAG)}
    )
    return (
        cells.withColumn("slice", F.explode(slices()))
        .groupBy("study_id", "outcome_id", "slice")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("event")).alias("n_event"))
    )


_add("slice_counts", _slice_counts, study_sql.slice_counts())


def _overall_curves(s: Study) -> DataFrame:
    return _curve_rounded(s.survival.where("strata = 'overall'"))


def _all_curves(s: Study) -> DataFrame:
    """Every day of every curve."""
    return _curve_rounded(s.survival)


_add("survival_overall", _overall_curves, study_sql.curves("strata = 'overall'"))
_add("survival_by_strata", _all_curves, study_sql.curves("true"))
_add(
    "model_patterns",
    lambda s: s.patterns.where((F.col("model") == models.BY_AGE_SEX) & (F.col("var") != "age")).drop(
        "model"
    ),
    study_sql.patterns(),
)
_add("model_patterns_all_forms", lambda s: s.patterns, study_sql.all_patterns())
_add(
    "unadjusted_odds_ratios",
    lambda s: _rounded(models.unadjusted_ratios(s.patterns), "or", "or_low", "or_high"),
    study_sql.unadjusted(),
)


def _fitted_unadjusted(s: Study) -> DataFrame:
    rows = s.odds_ratios.where(F.col("model") == models.UNADJUSTED)
    return _rounded(rows, "or", "or_low", "or_high").select(
        "study_id", "outcome_id", "slice", "var", "or", "or_low", "or_high"
    )


_add("fitted_unadjusted_odds_ratios", _fitted_unadjusted, study_sql.unadjusted())


def _odds_ratios(s: Study) -> DataFrame:
    """Every odds ratio with its interval, as logarithms, to five decimals."""
    logs = {f"log_{n}": F.round(F.log(c), 5) + F.lit(0.0) for n, c in (("or", "or"), ("low", "or_low"), ("high", "or_high"))}
    return s.odds_ratios.withColumns(logs).select(
        "study_id", "outcome_id", "slice", "var", "model", "gender", "n_tot", "n_w_outcome", *logs, "ref_age", "rel_age"
    )


_add("odds_ratios", _odds_ratios, model_sql.odds_ratios())
_add(
    "characteristics",
    lambda s: _rounded(s.characteristics, "low", "mid", "high").drop("label"),
    study_sql.characteristics(),
)
_add(
    "characteristics_wide",
    lambda s: summaries.wide_characteristics(s.characteristics),
    study_sql.wide_characteristics(),
)


def _labels(s: Study) -> DataFrame:
    """Label columns of the four result tables, with their row counts."""
    names = ["pop", "pop_type", "prior_obs_required", "outcome_name"]
    parts = [
        df.groupBy(*names).agg(F.count("*").alias("n")).withColumn("result", F.lit(name))
        for name, df in s.results().items()
        if name in ("survival_summary", "cohort_age_plot_data")
    ]
    return parts[0].unionByName(parts[1])


_add("result_labels", _labels, study_sql.labels())


def _listed(s: Study) -> DataFrame:
    """Cohorts of a run from a CSV list that gives each exposure another number."""
    path, given = f"{s.work.root}/manifest", {id: id + 1000 for id in d.EXPOSURES}
    lines = [(None, spec.name, given[spec.id], spec.name) for spec in s.specs if spec.id in given]
    literal_table(s.spark, lines, schemas.MANIFEST).write.mode("overwrite").csv(path, header=True)
    cohorts = manifest.renumbered(s.cohorts, manifest.resolve(tables.read_manifest(s.spark, path), s.specs))
    tables.write_cohorts(cohorts, f"{s.work.root}/listed")
    return tables.read_cohorts(s.spark, f"{s.work.root}/listed")


_add(
    "cohorts_from_manifest",
    _listed,
    with_tables(
        _EXPOSURE_PARTS,
        "SELECT id + 1000 AS cohort_definition_id, person_id AS subject_id, s AS cohort_start_date, "
        "e AS cohort_end_date FROM exposure",
        cohort_sql.CLINICAL,
    ),
)


def _two_databases(s: Study) -> DataFrame:
    """Counts of slices, written for two databases, one of them twice, and read back."""
    path = f"{s.work.root}/by_database"
    for name in ("north 1", "007", "north 1"):
        tables.write_results({"slice_counts": _slice_counts(s)}, path, name)
    return tables.read_results(s.spark, path, "slice_counts")


_add(
    "results_of_two_databases",
    _two_databases,
    f"SELECT s.*, db FROM ({study_sql.slice_counts()}) s, (VALUES ('north 1'), ('007')) v(db)",
)


def _emptied(s: Study) -> DataFrame:
    """A cohort table that was dropped and made again, then filled with two cohorts."""
    path = f"{s.work.root}/emptied"
    tables.write_cohorts(s.exposures, path)
    tables.empty_cohort_table(s.spark, path)
    tables.write_cohorts(s.exposures.where("cohort_definition_id in (101, 102)"), path)
    return tables.read_cohorts(s.spark, path)


_add(
    "emptied_cohort_table",
    _emptied,
    with_tables(
        _EXPOSURE_PARTS,
        "SELECT id AS cohort_definition_id, person_id AS subject_id, s AS cohort_start_date, "
        "e AS cohort_end_date FROM exposure WHERE id IN (101, 102)",
        cohort_sql.CLINICAL,
    ),
)


def _restored(s: Study) -> DataFrame:
    """The population of a second study that starts from the first one's written cohorts."""
    root = f"{s.work.root}/restored"
    tables.write_cohorts(s.cohorts, f"{root}/cohorts")
    tables.write_cohorts(s.comorbidities, f"{root}/comorbidities")
    tables.write_cohorts(s.medications, f"{root}/medications")
    stored = {n: tables.read_cohorts(s.spark, f"{root}/{n}") for n in ("cohorts", "comorbidities", "medications")}
    again = Study(
        s.cdm, s.definitions, s.calendar, s.condition_tops, s.drug_tops, extra_specs=TEMPLATES, stored=stored
    )
    return again.population.select("study_id", "person_id", *_COND_FLAGS, *_RECENT, *_COMPOSITE)


_add("population_from_stored_cohorts", _restored, study_sql.flags([*_COND_FLAGS, *_RECENT, *_COMPOSITE]))


def _replaced(s: Study) -> DataFrame:
    """A cohort table after one cohort was rebuilt to no rows and another to its own."""
    path = f"{s.work.root}/replaced"
    tables.write_cohorts(s.exposures, path)
    tables.write_cohorts(s.exposures.where("cohort_definition_id = 102"), path, ids=[101, 102])
    return tables.read_cohorts(s.spark, path)


_add(
    "replaced_cohorts",
    _replaced,
    with_tables(
        _EXPOSURE_PARTS,
        "SELECT id AS cohort_definition_id, person_id AS subject_id, s AS cohort_start_date, "
        "e AS cohort_end_date FROM exposure WHERE id <> 101",
        cohort_sql.CLINICAL,
    ),
)
_add("age_histogram", lambda s: _rounded(s.histograms, "density"), study_sql.histogram())

# ---- scalar functions ------------------------------------------------------------------


def _date_arithmetic(s: Study) -> DataFrame:
    return s.cdm.person.join(s.periods, "person_id").select(
        "person_id",
        "op_start",
        dates.birth_date(F.col("year_of_birth"), F.col("month_of_birth"), F.col("day_of_birth")).alias("born"),
        F.date_add("op_start", 28).alias("plus_28"),
        F.date_diff("op_end", "op_start").alias("days"),
        F.year("op_end").alias("last_year"),
        F.add_months("op_end", -12).alias("year_before"),
        F.round(dates.months_between_calendar(F.col("op_start"), F.col("op_end")), 6).alias("months"),
    )


_SPAN = (
    "12 * (year(op_end) - year(op_start)) + month(op_end) - month(op_start) "
    "- CASE WHEN day(op_end) < day(op_start) THEN 1 ELSE 0 END"
)
_add(
    "date_arithmetic",
    _date_arithmetic,
    with_tables(
        [],
        "SELECT person_id, op_start, make_date(year_of_birth, month_of_birth, day_of_birth) AS born, "
        "op_start + 28 AS plus_28, CAST(op_end - op_start AS INTEGER) AS days, "
        "CAST(year(op_end) AS INTEGER) AS last_year, CAST(op_end - INTERVAL 1 YEAR AS DATE) AS year_before, "
        f"round({_SPAN} + (op_end - CAST(op_start + to_months(CAST({_SPAN} AS INTEGER)) AS DATE)) / 30.4375, 6) "
        "AS months FROM person JOIN op USING (person_id)",
        ("person", "op"),
    ),
)


def _text_formats(s: Study) -> DataFrame:
    n, total = F.col("n"), F.lit(30_000)
    return (
        s.cdm.condition_occurrence.groupBy(F.year("condition_start_date").alias("year"))
        .agg(F.count("*").alias("n"))
        .select(
            "year",
            numbers.count_text(n * 1000).alias("thousands"),
            numbers.decimal_text(n / 7, 2).alias("two_decimals"),
            numbers.count_percent_text(n, total).alias("share"),
            numbers.sentence_case(F.concat(F.lit("sEEN IN "), F.col("year").cast("string"))).alias("label"),
        )
    )


_add(
    "text_formats",
    _text_formats,
    with_tables(
        [("c", "SELECT CAST(year(s) AS INTEGER) AS year, count(*) AS n FROM cond GROUP BY 1")],
        "SELECT year, format('{:,}', n * 1000) AS thousands, format('{:,.2f}', round(CAST(n / 7 AS DECIMAL(30, 15)), 2)::DOUBLE) AS two_decimals, "
        "format('{:,}', n) || ' (' || format('{:,.1f}', round(CAST(100 * (n / 30000) AS DECIMAL(30, 15)), 1)::DOUBLE) || '%)' AS share, "
        "'Seen in ' || year AS label FROM c",
        ("cond",),
    ),
)
