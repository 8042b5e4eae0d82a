"""Populations, covariates, follow-up, survival and summaries as SQL, person by person."""

from __future__ import annotations

from checks import cohort_sql
from checks.clinical_sql import packed, with_tables
from cohortide.operators.models import variable_columns
from cohortide.operators.population import STUDY_IDS, person_hash
from cohortide.plans import definitions as d
from cohortide.sources import adapter

CAL = adapter.CALENDAR
NEEDS = ("person", "op", "cond", "drug", "meas", "obs", "codes", "ancestor")
GENERAL = STUDY_IDS[d.GENERAL_POPULATION]
_IDS = {name: id for id, name in d.EXPOSURES.items()}


def _members() -> str:
    rows = [
        f"({STUDY_IDS[study]}, {_IDS[name]}, '{role}')"
        for role, table in (("entry", d.study_members()), ("next", d.study_censors()))
        for study, names in table.items()
        for name in names
    ]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v(study_id, id, role)"


ENTRIES = [
    *cohort_sql.all_rows(d.exposure_specs(CAL), "exposure"),
    ("big_exposure", "SELECT * FROM exposure WHERE id IN (SELECT id FROM exposure GROUP BY id HAVING count(*) > 5)"),
    ("member", _members()),
    (
        "indexed",
        "SELECT m.study_id, c.person_id, min(c.s) AS index_date FROM big_exposure c "
        "JOIN member m ON m.id = c.id AND m.role = 'entry' GROUP BY 1, 2",
    ),
    (
        "next_vax",
        "SELECT m.study_id, c.person_id, min(c.s) AS next_vax_date FROM big_exposure c "
        "JOIN member m ON m.id = c.id AND m.role = 'next' GROUP BY 1, 2",
    ),
    (
        "entry",
        "SELECT DISTINCT i.study_id, i.person_id, i.index_date, n.next_vax_date, c.id FROM indexed i "
        "JOIN member m ON m.study_id = i.study_id AND m.role = 'entry' "
        "JOIN big_exposure c ON c.id = m.id AND c.person_id = i.person_id AND c.s = i.index_date "
        "LEFT JOIN next_vax n ON n.study_id = i.study_id AND n.person_id = i.person_id",
    ),
]


def _band(edges: list[tuple[int, str]], last: str) -> str:
    return "CASE " + " ".join(f"WHEN age < {e} THEN '{t}'" for e, t in edges) + f" ELSE '{last}' END"


BANDS = {
    "age_gr": _band(
        [(20, "<20"), (45, "20-44"), (55, "45-54"), (65, "55-64"), (75, "65-74"), (85, "75-84")], ">=85"
    ),
    "age_gr2": _band([(45, "<=44"), (65, "45-64")], ">=65"),
    "age_gr3": _band(
        [
            (20, "<20"),
            (30, "20-29"),
            (40, "30-39"),
            (50, "40-49"),
            (60, "50-59"),
            (70, "60-69"),
            (80, "70-79"),
        ],
        ">=80",
    ),
}

_MONTHS = (
    "12 * (year(index_date) - year(f)) + month(index_date) - month(f) "
    "- CASE WHEN day(index_date) < day(f) THEN 1 ELSE 0 END"
)

POPULATION = [
    *ENTRIES,
    (
        "joined",
        "SELECT n.*, p.* EXCLUDE (person_id), o.op_start, o.op_end, "
        "count(*) OVER (PARTITION BY n.study_id, n.person_id) AS copies FROM entry n "
        "JOIN person p ON p.person_id = n.person_id "
        "LEFT JOIN (SELECT DISTINCT * FROM op) o ON o.person_id = n.person_id",
    ),
    (
        "single",
        "SELECT *, bool_and(month_of_birth IS NOT NULL AND day_of_birth IS NOT NULL) "
        "OVER (PARTITION BY study_id) AS complete FROM joined "
        "WHERE copies = 1 AND index_date < (SELECT max(op_end) FROM op) - 7",
    ),
    (
        "aged",
        "SELECT *, CAST(CASE WHEN complete THEN floor((index_date - make_date(year_of_birth, month_of_birth, "
        "day_of_birth)) / 365.25) ELSE year(index_date) - year_of_birth END AS INTEGER) AS age, "
        "CASE gender_concept_id WHEN 8507 THEN 'Male' WHEN 8532 THEN 'Female' END AS gender, "
        "index_date - op_start AS prior_obs_days FROM single",
    ),
    ("start_of_study", f"SELECT min(s) AS f FROM exposure WHERE id <> {GENERAL}"),
    (
        "pop0",
        "SELECT study_id, person_id, index_date, next_vax_date, id AS cohort_definition_id, op_start, op_end, "
        "year_of_birth, age, gender, CAST(prior_obs_days AS INTEGER) AS prior_obs_days, "
        + ", ".join(f"{sql} AS {name}" for name, sql in BANDS.items())
        + f", CASE WHEN study_id <> {GENERAL} THEN {_MONTHS} + (index_date - "
        f"CAST(f + to_months(CAST({_MONTHS} AS INTEGER)) AS DATE)) / 30.4375 END AS months_since_start "
        "FROM aged, start_of_study WHERE age BETWEEN 18 AND 110 AND gender IS NOT NULL "
        "AND op_end IS NOT NULL AND prior_obs_days / 365.25 >= 1",
    ),
]


def _codes(tops: dict[str, int]) -> str:
    return ", ".join(map(str, tops.values()))


COMORBIDITY = [
    ("exposed", "SELECT DISTINCT person_id FROM exposure"),
    (
        "comorbidity",
        "SELECT a.top AS code, c.person_id, min(c.s) AS s FROM cond c JOIN ancestor a ON a.below = c.standard "
        f"WHERE a.top IN ({_codes(adapter.CONDITION_TOPS)}) AND c.person_id IN (SELECT person_id FROM exposed) "
        "GROUP BY 1, 2",
    ),
]
DRUG_ERA = [
    ("drug_rows", "SELECT person_id, standard, s, e FROM drug"),
    ("drug_era", packed("drug_rows", ["person_id", "standard"], 30)),
]
MEDICATION = [
    *DRUG_ERA,
    (
        "medication",
        "SELECT DISTINCT a.top AS code, r.person_id, r.s FROM drug_era r JOIN ancestor a ON a.below = r.standard "
        f"WHERE a.top IN ({_codes(adapter.DRUG_TOPS)}) AND r.e >= DATE '{CAL.drug_eras_from}' "
        "AND r.person_id IN (SELECT person_id FROM exposed)",
    ),
]

_CONDITIONS = [f"{c}_all_history" for c in d.CONDITIONS]
_COND = " + ".join(f"{c}_all_history" for c in d.CONDITIONS_OF_INTEREST)
_DRUG = " + ".join(d.DRUGS_OF_INTEREST)


def _any(columns: dict[str, str], table: str, where: str) -> str:
    """Per study and person: 1 for each column whose condition holds on some history row."""
    flags = ", ".join(f"max(CASE WHEN {sql} THEN 1 ELSE 0 END) AS {name}" for name, sql in columns.items())
    return (
        f"SELECT p.study_id, p.person_id, {flags} FROM pop0 p JOIN {table} h ON h.person_id = p.person_id "
        f"WHERE {where} GROUP BY 1, 2"
    )


FULL_POPULATION = [
    *POPULATION,
    *COMORBIDITY,
    *MEDICATION,
    *cohort_sql.all_rows(d.covid_specs(), "covid"),
    (
        "condition_flag",
        _any(
            {f"{n}_all_history": f"h.code = {c}" for n, c in adapter.CONDITION_TOPS.items()},
            "comorbidity",
            "h.s < p.index_date",
        ),
    ),
    (
        "drug_flag",
        _any(
            {n: f"h.code = {c}" for n, c in adapter.DRUG_TOPS.items()},
            "medication",
            "h.s BETWEEN p.index_date - 183 AND p.index_date - 4",
        ),
    ),
    (
        "covid_flag",
        _any(
            {"covid_year_prior": "true"},
            "covid",
            f"year(h.s) >= {CAL.covid_from_year} AND h.s <= p.index_date "
            "AND h.s >= CAST(p.index_date - INTERVAL 1 YEAR AS DATE)",
        ),
    ),
    (
        "flagged",
        "SELECT p.*, "
        + ", ".join(f"coalesce({f}, 0) AS {f}" for f in [*_CONDITIONS, *d.DRUGS, "covid_year_prior"])
        + " FROM pop0 p LEFT JOIN condition_flag USING (study_id, person_id) "
        "LEFT JOIN drug_flag USING (study_id, person_id) LEFT JOIN covid_flag USING (study_id, person_id)",
    ),
    (
        "pop",
        f"SELECT *, CASE WHEN {_COND} > 0 THEN 1 ELSE 0 END AS cond_comp, "
        f"CASE WHEN {_DRUG} > 0 THEN 1 ELSE 0 END AS drug_comp, "
        f"CASE WHEN {_COND} + {_DRUG} > 0 THEN 1 ELSE 0 END AS cond_drug_comp FROM flagged",
    ),
]

#: Events from which a slice is modelled here: fewer than in the study, so that vaccine cohorts are.
MODEL_EVENTS = 10

_HORIZON = (
    f"CASE WHEN p.study_id = {GENERAL} THEN CAST(p.index_date + INTERVAL 2 YEAR AS DATE) "
    "ELSE p.index_date + 28 END"
)
FOLLOW_UP = [
    *[(n, f"{sql}") for n, sql in FULL_POPULATION],
    *cohort_sql.all_rows(d.outcome_specs(), "outcome"),
    (
        "hit",
        "SELECT p.study_id, o.id AS outcome_id, p.person_id, p.index_date, "
        "CASE WHEN p.next_vax_date < p.index_date THEN NULL ELSE p.next_vax_date END AS next_vax_date, o.s, "
        f"{_HORIZON} AS horizon FROM pop p JOIN outcome o ON o.person_id = p.person_id "
        "WHERE o.id IN (SELECT id FROM outcome GROUP BY id HAVING count(*) > 5)",
    ),
    (
        "washed",
        "SELECT DISTINCT study_id, outcome_id, person_id FROM hit "
        "WHERE s >= CAST(index_date - INTERVAL 1 YEAR AS DATE) AND s < index_date",
    ),
    (
        "before",
        "SELECT DISTINCT study_id, outcome_id, person_id FROM hit "
        "WHERE s < CAST(index_date - INTERVAL 1 YEAR AS DATE)",
    ),
    (
        "followed",
        "SELECT h.* FROM hit h ANTI JOIN washed w ON w.study_id = h.study_id AND w.outcome_id = h.outcome_id "
        "AND w.person_id = h.person_id WHERE h.s >= h.index_date AND h.s <= h.horizon "
        f"AND (h.study_id = {GENERAL} OR h.next_vax_date IS NULL OR h.s < h.next_vax_date)",
    ),
    (
        "pairs",
        "SELECT a.study_id, a.outcome_id, a.n_rows, b.followup_rows FROM "
        "(SELECT study_id, outcome_id, count(*) AS n_rows FROM hit GROUP BY 1, 2) a JOIN "
        "(SELECT study_id, outcome_id, count(*) AS followup_rows FROM followed GROUP BY 1, 2) b "
        "USING (study_id, outcome_id) WHERE n_rows >= 5 AND followup_rows >= 5",
    ),
    (
        "first_event",
        "SELECT study_id, outcome_id, person_id, min(s) AS event_date FROM followed GROUP BY 1, 2, 3",
    ),
    (
        "risk",
        "SELECT p.*, x.outcome_id, f.event_date, CASE WHEN b.person_id IS NULL THEN 0 ELSE 1 END AS history_outcome, "
        "CASE WHEN f.event_date IS NULL THEN 0 ELSE 1 END AS ev, "
        f"{_HORIZON} AS horizon FROM pop p JOIN pairs x ON x.study_id = p.study_id "
        "ANTI JOIN washed w ON w.study_id = p.study_id AND w.outcome_id = x.outcome_id AND w.person_id = p.person_id "
        "LEFT JOIN before b ON b.study_id = p.study_id AND b.outcome_id = x.outcome_id AND b.person_id = p.person_id "
        "LEFT JOIN first_event f ON f.study_id = p.study_id AND f.outcome_id = x.outcome_id "
        "AND f.person_id = p.person_id",
    ),
    (
        "tar",
        "SELECT *, CAST(CASE WHEN ev = 1 THEN event_date "
        f"WHEN study_id <> {GENERAL} AND next_vax_date >= index_date AND next_vax_date < horizon THEN next_vax_date "
        "WHEN op_end < horizon THEN op_end ELSE horizon END - index_date AS INTEGER) AS days FROM risk",
    ),
]

_SLICES = (
    "SELECT t.*, v.slice FROM tar t JOIN (VALUES ('All', -1), ('No covid', 0), ('Covid', 1)) v(slice, flag) "
    "ON v.flag = -1 OR v.flag = t.covid_year_prior"
)


def _strata() -> str:
    groups = {
        "overall": "'overall'",
        "gender": "'gender=' || gender",
        **{f: f"'{f}=' || {f}" for f in ("cond_comp", "drug_comp", "cond_drug_comp")},
        **{f"{b}_gender": f"'{b}=' || {b} || ', gender=' || gender" for b in BANDS},
        **{b: f"'{b}=' || {b}" for b in BANDS},
    }
    return " UNION ALL ".join(
        f"SELECT study_id, outcome_id, slice, '{s}' AS strata, {g} AS grp, days, ev FROM sliced"
        for s, g in groups.items()
    )


_KEYS = "study_id, outcome_id, slice, strata, grp"
CURVES = [
    *FOLLOW_UP,
    ("sliced", _SLICES),
    ("spread", _strata()),
    (
        "slice_size",
        "SELECT study_id, outcome_id, slice, count(*) AS n, sum(count(*)) FILTER (slice = 'All') "
        "OVER (PARTITION BY study_id, outcome_id) AS n_all FROM sliced GROUP BY 1, 2, 3",
    ),
    (
        "flag_size",
        "SELECT study_id, outcome_id, slice, strata, count(*) AS n FROM spread "
        "WHERE strata IN ('cond_comp', 'drug_comp', 'cond_drug_comp') AND grp = strata || '=1' GROUP BY 1, 2, 3, 4",
    ),
    (
        "shown",
        "SELECT s.* FROM spread s JOIN slice_size z USING (study_id, outcome_id, slice) "
        "LEFT JOIN flag_size f ON f.study_id = s.study_id AND f.outcome_id = s.outcome_id AND f.slice = s.slice "
        "AND f.strata = s.strata WHERE z.n >= 5 AND z.n_all > 5 "
        "AND (s.strata NOT IN ('cond_comp', 'drug_comp', 'cond_drug_comp') OR f.n > 5)",
    ),
    (
        "grid",
        f"SELECT {_KEYS}, CAST(unnest(range(0, max(days) + 1)) AS INTEGER) AS time FROM shown GROUP BY {_KEYS}",
    ),
    (
        "tally",
        f"SELECT {_KEYS}, days AS time, count(*) AS n, sum(ev) AS d FROM shown GROUP BY {_KEYS}, days",
    ),
    (
        "daily",
        f"SELECT g.*, coalesce(t.n, 0) AS n, coalesce(t.d, 0) AS d FROM grid g LEFT JOIN tally t "
        f"USING ({_KEYS}, time)",
    ),
    (
        "risked",
        f"SELECT *, sum(n) OVER (PARTITION BY {_KEYS}) "
        f"- coalesce(sum(n) OVER (PARTITION BY {_KEYS} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND 1 PRECEDING), 0) AS r FROM daily",
    ),
    (
        "curve",
        f"SELECT {_KEYS}, time, CAST(r AS BIGINT) AS n_risk, CAST(d AS BIGINT) AS n_event, "
        "CAST(sum(d) OVER w AS BIGINT) AS cum_n_event, "
        "CASE WHEN max(CASE WHEN r = d THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0 "
        "ELSE exp(sum(CASE WHEN r > d THEN ln((r - d)::DOUBLE / r) ELSE 0 END) OVER w) END AS surv, "
        "sqrt(sum(CASE WHEN r > d THEN d::DOUBLE / (r::DOUBLE * (r - d)) ELSE 0 END) OVER w) AS g FROM risked "
        f"WINDOW w AS (PARTITION BY {_KEYS} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    ),
]
_Z = "1.959963984540054"
_CURVE_COLUMNS = (
    f"{_KEYS}, time, n_risk, n_event, cum_n_event, round(surv + 1e-9, 6) AS surv, "
    f"round(CASE WHEN surv > 0 THEN surv * exp(-{_Z} * g) END + 1e-9, 6) AS lower, "
    f"round(CASE WHEN surv > 0 THEN least(1.0, surv * exp({_Z} * g)) END + 1e-9, 6) AS upper"
)


def study(parts: list[tuple[str, str]], final: str) -> str:
    return with_tables([(n, s) for n, s in parts], final, NEEDS)


def entries() -> str:
    return study(
        ENTRIES,
        "SELECT study_id, person_id, index_date, next_vax_date, CAST(min(id) AS BIGINT) AS cohort_definition_id, "
        "count(*) AS n_entries FROM entry GROUP BY 1, 2, 3, 4",
    )


PLAIN_COLUMNS = (
    "study_id, person_id, index_date, next_vax_date, CAST(cohort_definition_id AS BIGINT) AS cohort_definition_id, "
    "op_start, op_end, age, gender, prior_obs_days, age_gr, age_gr2, age_gr3"
)


def plain_population() -> str:
    return study(POPULATION, f"SELECT {PLAIN_COLUMNS} FROM pop0")


def months() -> str:
    return study(
        POPULATION, "SELECT study_id, person_id, round(months_since_start, 6) AS months_since_start FROM pop0"
    )


def band_counts() -> str:
    sql = " UNION ALL ".join(
        f"SELECT study_id, '{b}' AS band, {b} AS level, gender, count(*) AS n FROM pop0 GROUP BY 1, 3, 4"
        for b in BANDS
    )
    return study(POPULATION, sql)


def comorbidities() -> str:
    return study(
        [*ENTRIES, *COMORBIDITY],
        "SELECT CAST(code AS BIGINT) AS cohort_definition_id, person_id AS subject_id, s AS cohort_start_date, "
        "s AS cohort_end_date FROM comorbidity",
    )


def medications() -> str:
    return study(
        [*ENTRIES, COMORBIDITY[0], *MEDICATION],
        "SELECT CAST(code AS BIGINT) AS cohort_definition_id, person_id AS subject_id, s AS cohort_start_date, "
        "s AS cohort_end_date FROM medication",
    )


def flags(columns: list[str]) -> str:
    return study(FULL_POPULATION, f"SELECT study_id, person_id, {', '.join(columns)} FROM pop")


def pairs() -> str:
    return study(FOLLOW_UP, "SELECT * FROM pairs")


def facts() -> str:
    return study(
        FOLLOW_UP,
        "SELECT h.study_id, h.outcome_id, h.person_id, count(*) AS n_rows, "
        "bool_or(h.s >= CAST(h.index_date - INTERVAL 1 YEAR AS DATE) AND h.s < h.index_date) AS washout, "
        "bool_or(h.s < CAST(h.index_date - INTERVAL 1 YEAR AS DATE)) AS history, "
        f"count(*) FILTER (h.s BETWEEN h.index_date AND h.horizon AND (h.study_id = {GENERAL} OR "
        "h.next_vax_date IS NULL OR h.s < h.next_vax_date)) AS followup_rows, "
        f"min(h.s) FILTER (h.s BETWEEN h.index_date AND h.horizon AND (h.study_id = {GENERAL} OR "
        "h.next_vax_date IS NULL OR h.s < h.next_vax_date)) AS event_date FROM hit h GROUP BY 1, 2, 3",
    )


def sampled(rows: int, seed: int) -> str:
    return study(
        FULL_POPULATION,
        f"SELECT study_id, person_id, index_date FROM pop QUALIFY row_number() OVER (ORDER BY {person_hash(seed)}, "
        f"person_id, study_id) <= {rows}",
    )


def labels() -> str:
    """Names of study cohorts and outcomes next to the rows of curves and histograms."""
    studies = ", ".join(f"({i}, '{n}')" for n, i in STUDY_IDS.items())
    outcomes = ", ".join(f"({i}, '{n}')" for i, n in d.OUTCOMES.items())
    return (
        "WITH studies AS (SELECT * FROM (VALUES " + studies + ") v(study_id, pop)), "
        "outcomes AS (SELECT * FROM (VALUES " + outcomes + ") v(outcome_id, outcome_name)) "
        "SELECT 'survival_summary' AS result, pop, slice AS pop_type, 'Yes' AS prior_obs_required, outcome_name, count(*) AS n "
        f"FROM ({curves('true')}) JOIN studies USING (study_id) LEFT JOIN outcomes USING (outcome_id) GROUP BY ALL UNION ALL "
        "SELECT 'cohort_age_plot_data', pop, 'All', prior_obs_required, outcome_name, count(*) "
        f"FROM ({histogram()}) JOIN studies USING (study_id) LEFT JOIN outcomes USING (outcome_id) GROUP BY ALL"
    )


def time_at_risk() -> str:
    return study(
        FOLLOW_UP,
        "SELECT study_id, outcome_id, person_id, event_date, history_outcome, ev AS f_u_outcome, "
        "days AS f_u_outcome_days FROM tar",
    )


def time_at_risk_earliest() -> str:
    first = (
        "SELECT *, CAST(CASE WHEN ev = 1 THEN event_date ELSE least(horizon, op_end, "
        f"CASE WHEN study_id <> {GENERAL} AND next_vax_date >= index_date THEN next_vax_date END) END - index_date AS INTEGER) "
        "AS days FROM risk"
    )
    return study(
        [*FOLLOW_UP, ("first", first)],
        "SELECT study_id, outcome_id, person_id, f_u_outcome, f_u_outcome_days, "
        "f_u_outcome_days < usual AS shorter FROM (SELECT study_id, outcome_id, person_id, ev AS f_u_outcome, "
        "days AS f_u_outcome_days FROM first) JOIN (SELECT study_id, outcome_id, person_id, days AS usual FROM tar) "
        "USING (study_id, outcome_id, person_id)",
    )


def slice_counts() -> str:
    return study(
        [*FOLLOW_UP, ("sliced", _SLICES)],
        "SELECT study_id, outcome_id, slice, count(*) AS n, CAST(sum(ev) AS BIGINT) AS n_event FROM sliced "
        "GROUP BY 1, 2, 3",
    )


def curves(where: str) -> str:
    return study(CURVES, f"SELECT {_CURVE_COLUMNS} FROM curve WHERE {where}")


def _tables(parts: str) -> str:
    return (
        "SELECT study_id, outcome_id, slice, var, "
        "count(*) FILTER (x = 1 AND ev = 1)::DOUBLE AS a, count(*) FILTER (x = 1 AND ev = 0)::DOUBLE AS b, "
        "count(*) FILTER (x = 0 AND ev = 1)::DOUBLE AS c, count(*) FILTER (x = 0 AND ev = 0)::DOUBLE AS d, "
        f"count(*) FILTER (x = 1) AS exposed FROM ({parts}) GROUP BY 1, 2, 3, 4"
    )


def unadjusted() -> str:
    parts = " UNION ALL ".join(
        f"SELECT study_id, outcome_id, slice, '{var}' AS var, {column} AS x, ev FROM sliced"
        for var, column in variable_columns().items()
    )
    parts += (
        " UNION ALL SELECT study_id, outcome_id, slice, 'Sex (Male:Female)', "
        "CASE gender WHEN 'Male' THEN 1 ELSE 0 END, ev FROM sliced"
    )
    log_or = "ln(a * d / (b * c))"
    se = "sqrt(1 / a + 1 / b + 1 / c + 1 / d)"
    full = "a > 0 AND b > 0 AND c > 0 AND d > 0"
    return study(
        [*FOLLOW_UP, ("sliced", _SLICES), ("four", _tables(parts))],
        "SELECT study_id, outcome_id, slice, var, "
        f"round(CASE WHEN {full} THEN exp({log_or}) END, 6) AS \"or\", "
        f"round(CASE WHEN {full} THEN exp({log_or} - {_Z} * {se}) END, 6) AS or_low, "
        f"round(CASE WHEN {full} THEN exp({log_or} + {_Z} * {se}) END, 6) AS or_high "
        f"FROM four WHERE a + c >= {MODEL_EVENTS} AND (var = 'Sex (Male:Female)' OR exposed > 5)",
    )


def patterns() -> str:
    """Counts by exposure, age and sex for every variable."""
    parts = " UNION ALL ".join(
        f"SELECT study_id, outcome_id, slice, '{var}' AS var, {column} AS value, gender, age, ev FROM sliced"
        for var, column in variable_columns().items()
    )
    return study(
        [*FOLLOW_UP, ("sliced", _SLICES), ("long", parts)],
        "SELECT study_id, outcome_id, slice, var, value, gender, age, count(*) AS n, CAST(sum(ev) AS BIGINT) AS y "
        "FROM long GROUP BY 1, 2, 3, 4, 5, 6, 7 "
        f"QUALIFY sum(sum(ev)) OVER (PARTITION BY study_id, outcome_id, slice, var) >= {MODEL_EVENTS} "
        "AND sum(count(*)) FILTER (value = 1) OVER (PARTITION BY study_id, outcome_id, slice, var) > 5",
    )


def all_patterns() -> str:
    """Counts of every pattern table: age and sex alone, and each exposure by age and sex and without covariates."""
    parts = ["SELECT study_id, outcome_id, slice, 'age' AS var, 0 AS value, gender, age, ev FROM sliced"]
    parts += [
        f"SELECT study_id, outcome_id, slice, '{var}' AS var, {column} AS value, gender, age, ev FROM sliced"
        for var, column in variable_columns().items()
    ]
    return study(
        [*FOLLOW_UP, ("sliced", _SLICES), ("long", " UNION ALL ".join(parts))],
        f"SELECT study_id, outcome_id, slice, var, CASE WHEN grouping(gender) = 1 THEN 'Unadjusted' ELSE 'Adjusted for age and sex' END AS model, "
        "value, gender, age, count(*) AS n, CAST(sum(ev) AS BIGINT) AS y FROM long "
        "GROUP BY GROUPING SETS ((study_id, outcome_id, slice, var, value, gender, age), (study_id, outcome_id, slice, var, value)) "
        f"QUALIFY sum(sum(ev)) OVER (PARTITION BY study_id, outcome_id, slice, var, grouping(gender)) >= {MODEL_EVENTS} "
        "AND (var = 'age' AND grouping(gender) = 0 OR var <> 'age' "
        "AND sum(count(*)) FILTER (value = 1) OVER (PARTITION BY study_id, outcome_id, slice, var, grouping(gender)) > 5)",
    )


def _counted() -> dict[str, str]:
    brands = {"index_az": "AZ", "index_jnj": "janssen", "index_pfizer": "pfizer", "index_mrna": "moderna"}
    names = ", ".join(f"({i}, '{n}')" for i, n in d.EXPOSURES.items())
    out = {
        v: f"(SELECT contains(n, '{b}') FROM (VALUES {names}) v(i, n) WHERE i = cohort_definition_id)"
        for v, b in brands.items()
    }
    ages = ("<20", "20-29", "30-39", "40-49", "50-59", "60-69", "70-79", ">=80")
    labels = ("under_20", "20_29", "30_39", "40_49", "50_59", "60_69", "70_79", "80u")
    out |= {f"age_{label}": f"age_gr3 = '{band}'" for band, label in zip(ages, labels)}
    out["sex_male"] = "gender = 'Male'"
    for f in ["covid_year_prior", *_CONDITIONS, *d.DRUGS, "cond_comp", "drug_comp", "cond_drug_comp"]:
        out[f] = f"{f} = 1"
    return out


def characteristics() -> str:
    counted = _counted()
    agg = ", ".join(f"count(*) FILTER ({sql}) AS {v}" for v, sql in counted.items())
    total = "SELECT study_id, {o} AS outcome_id, count(*) AS total, min(index_date) AS a, max(index_date) AS z, "
    quart = "".join(
        f"quantile_cont(age, {q}) AS age{i}, quantile_cont(prior_obs_days, {q}) / 365.25 AS obs{i}, "
        for i, q in enumerate((0.25, 0.5, 0.75))
    )
    base = (
        total.format(o="CAST(NULL AS INTEGER)") + quart + agg + " FROM pop GROUP BY study_id UNION ALL "
        + total.format(o="outcome_id") + quart + agg + " FROM tar WHERE ev = 1 GROUP BY study_id, outcome_id"
    )
    none = "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
    rows = [
        f"SELECT study_id, outcome_id, total, 'n' AS var, total AS n, NULL::DOUBLE AS low, NULL::DOUBLE AS mid, "
        "NULL::DOUBLE AS high, NULL::DATE AS day FROM wide",
        f"SELECT study_id, outcome_id, total, 'min_index_date', NULL, {none}, a FROM wide",
        f"SELECT study_id, outcome_id, total, 'max_index_date', NULL, {none}, z FROM wide",
        "SELECT study_id, outcome_id, total, 'age', NULL, age0, age1, age2, NULL FROM wide",
        "SELECT study_id, outcome_id, total, 'prior_obs_years', NULL, obs0, obs1, obs2, NULL FROM wide",
    ]
    rows += [f"SELECT study_id, outcome_id, total, '{v}', {v}, {none}, NULL FROM wide" for v in counted]
    text = (
        "CASE WHEN n BETWEEN 1 AND 4 THEN '<5' WHEN var = 'n' THEN format('{:,}', n) "
        "WHEN n IS NOT NULL THEN format('{:,}', n) || ' (' || format('{:,.1f}', round(CAST(100 * (n::DOUBLE / total) AS DECIMAL(30, 15)), 1)::DOUBLE) "
        "|| '%)' WHEN day IS NOT NULL THEN day::VARCHAR "
        "WHEN var = 'age' THEN format('{:,.0f} [{:,.0f} to {:,.0f}]', round_even(mid, 0), round_even(low, 0), "
        "round_even(high, 0)) "
        "ELSE format('{:,.1f} [{:,.1f} to {:,.1f}]', round(CAST(mid AS DECIMAL(30, 15)), 1)::DOUBLE, "
        "round(CAST(low AS DECIMAL(30, 15)), 1)::DOUBLE, round(CAST(high AS DECIMAL(30, 15)), 1)::DOUBLE) END"
    )
    return study(
        [*FOLLOW_UP, ("wide", base), ("long", " UNION ALL ".join(rows))],
        "SELECT study_id, outcome_id, var, n, total, round(low, 6) AS low, round(mid, 6) AS mid, "
        f"round(high, 6) AS high, day, {text} AS value FROM long",
    )


def histogram() -> str:
    def bins(rows: str, keys: str) -> str:
        return (
            f"SELECT {keys}, CAST(ceil((age - 1.5) / 3) AS INTEGER) AS k, count(*) AS n FROM {rows} GROUP BY ALL"
        )

    many = (
        "SELECT * FROM tar WHERE ev = 1 QUALIFY count(*) OVER (PARTITION BY study_id, outcome_id) > 30"
    )
    return study(
        [
            *FOLLOW_UP,
            ("many", many),
            (
                "bins",
                bins("pop", "study_id, CAST(NULL AS INTEGER) AS outcome_id")
                + " UNION ALL "
                + bins("many", "study_id, outcome_id"),
            ),
            (
                "ends",
                "SELECT study_id, outcome_id, min(k) AS lo, max(k) AS hi, sum(n) AS total FROM bins GROUP BY 1, 2",
            ),
            ("slots", "SELECT study_id, outcome_id, total, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS k FROM ends"),
        ],
        "SELECT s.study_id, s.outcome_id, v.prior_obs_required, 3.0::DOUBLE * s.k AS x, 3.0::DOUBLE * s.k - 1.5 AS xmin, "
        "3.0::DOUBLE * s.k + 1.5 AS xmax, coalesce(b.n, 0) AS count, "
        "round(coalesce(b.n, 0)::DOUBLE / (s.total * 3), 6) AS density FROM slots s "
        "LEFT JOIN bins b ON b.study_id = s.study_id AND b.outcome_id IS NOT DISTINCT FROM s.outcome_id AND b.k = s.k "
        "CROSS JOIN (VALUES ('No'), ('Yes')) v(prior_obs_required)",
    )


def wide_characteristics() -> str:
    renamed = {
        "sex_male": "Sex: Male",
        "prior_obs_years": "Years of prior observation time",
        "cond_comp": "One or more condition of interest",
        "drug_comp": "One or more medication of interest",
        "cond_drug_comp": "One or more condition/ medication of interest",
    }
    cases = " ".join(f"WHEN '{v}' THEN '{text}'" for v, text in renamed.items())
    label = f"CASE var {cases} ELSE replace(upper(left(var, 1)) || lower(substr(var, 2)), '_', ' ') END"
    columns = ", ".join(
        f"max(CASE WHEN outcome_id = {i} THEN value END) AS \"{name}\"" for i, name in d.OUTCOMES.items()
    )
    return (
        f"SELECT study_id, {label} AS label, max(CASE WHEN outcome_id IS NULL THEN value END) AS \"Overall\", "
        f"{columns} FROM ({characteristics()}) GROUP BY 1, 2"
    )
