"""A cohort definition as row-level SQL: every event and rule spelled out with joins."""

from __future__ import annotations

from checks.clinical_sql import packed, with_tables
from cohortide.plans.specs import CohortSpec, Criterion

_TABLE = {
    "condition_occurrence": "cond",
    "drug_exposure": "drug",
    "measurement": "meas",
    "observation": "obs",
}
CLINICAL = ("person", "op", "cond", "drug", "meas", "obs", "codes")


def criterion(c: Criterion) -> str:
    """(person_id, s, e) of the rows matching a criterion."""
    sql = (
        f"SELECT t.person_id, t.s, t.e FROM {_TABLE[c.domain]} t JOIN codes k "
        f"ON k.codeset = '{c.codeset}' AND k.concept_id = t.{c.concept} WHERE true"
    )
    if c.after:
        sql += f" AND t.s > DATE '{c.after}'"
    if c.not_before:
        sql += f" AND t.s >= DATE '{c.not_before}'"
    if c.value_min is not None:
        sql += f" AND t.value >= {c.value_min}"
    if c.value_max is not None:
        sql += f" AND t.value <= {c.value_max}"
    if c.units:
        sql += f" AND t.unit IN ({', '.join(map(str, c.units))})"
    if c.value_concepts:
        sql += f" AND t.value_concept IN ({', '.join(map(str, c.value_concepts))})"
    return sql


def parts(spec: CohortSpec) -> list[tuple[str, str]]:
    """CTEs p<id>_q (qualified events) .. p<id> (cohort rows person_id, s, e)."""
    p = f"p{spec.id}"
    out: list[tuple[str, str]] = []
    if spec.covering:
        on = f"DATE '{spec.covering}'"
        entry = f"SELECT person_id, {on} AS s, {on} AS e FROM op WHERE op_start <= {on} AND op_end >= {on}"
    else:
        entry = " UNION ALL ".join(criterion(c) for c in spec.entry)
    out.append((f"{p}_ev", entry))
    first = "WHERE event_id = 1" if spec.first_primary or spec.first_qualified else ""
    out.append(
        (
            f"{p}_q",
            f"SELECT * FROM (SELECT v.person_id, v.s, v.e, op.op_start, op.op_end, row_number() OVER "
            f"(PARTITION BY v.person_id ORDER BY v.s, v.e, op.op_start, op.op_end) AS event_id "
            f"FROM {p}_ev v JOIN op ON op.person_id = v.person_id AND v.s BETWEEN op.op_start AND op.op_end "
            f"WHERE op.op_start + {spec.prior_days} <= v.s AND v.s + {spec.post_days} <= op.op_end) {first}",
        )
    )
    for r, rule in enumerate(spec.rules):
        if rule.min_age is not None:
            sql = (
                f"SELECT q.person_id, q.event_id FROM {p}_q q JOIN person USING (person_id) "
                f"WHERE year(q.s) - year_of_birth >= {rule.min_age}"
            )
        elif rule.observed_since:
            n = rule.observed_days
            sql = (
                f"SELECT DISTINCT q.person_id, q.event_id FROM {p}_q q JOIN op a ON a.person_id = q.person_id "
                f"WHERE a.op_start < DATE '{rule.observed_since}' AND a.op_end - a.op_start >= {n} "
                f"AND a.op_start >= q.op_start AND a.op_start <= q.op_end AND a.op_start <= q.s - {n} "
                f"AND a.op_end >= q.s AND a.op_end <= q.op_end"
            )
        else:
            tests = []
            for near in rule.nearby:
                cond = "a.person_id = q.person_id"
                if near.inside_period:
                    cond += " AND a.s >= q.op_start AND a.s <= q.op_end"
                if near.first is not None:
                    cond += f" AND a.s >= q.s + ({near.first})"
                if near.last is not None:
                    cond += f" AND a.s <= q.s + ({near.last})"
                need = f"= {near.exactly}" if near.exactly is not None else f">= {near.at_least}"
                tests.append(
                    f"(SELECT q.person_id, q.event_id FROM {p}_q q LEFT JOIN ({criterion(near.criterion)}) a "
                    f"ON {cond} GROUP BY 1, 2 HAVING count(a.person_id) {need})"
                )
            sql = (" INTERSECT " if rule.match == "all" else " UNION ").join(tests)
        out.append((f"{p}_r{r}", sql))
    mask = " + ".join(
        f"CASE WHEN r{r}.person_id IS NULL THEN 0 ELSE {1 << r} END" for r in range(len(spec.rules))
    )
    joins = " ".join(
        f"LEFT JOIN {p}_r{r} r{r} ON r{r}.person_id = q.person_id AND r{r}.event_id = q.event_id"
        for r in range(len(spec.rules))
    )
    out.append((f"{p}_m", f"SELECT q.*, CAST({mask or '0'} AS BIGINT) AS mask FROM {p}_q q {joins}"))
    one = "WHERE rn = 1" if spec.first_included else ""
    out.append(
        (
            f"{p}_i",
            f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY s, e, op_start, op_end) "
            f"AS rn FROM {p}_m WHERE mask = {(1 << len(spec.rules)) - 1}) {one}",
        )
    )
    ex = spec.exit
    if ex.kind in ("start", "end"):
        moved = f"{'s' if ex.kind == 'start' else 'e'} + {ex.days}"
        end = f"least({moved}, op_end)" if ex.bound == "period" else f"greatest({moved}, s)"
    else:
        end = "op_end"
    ends = [f"SELECT person_id, event_id, s, {end} AS e FROM {p}_i"]
    if ex.kind == "era":
        used = " UNION ALL ".join(
            criterion(Criterion("drug_exposure", ex.era_codeset, c)) for c in ("standard", "source")
        )
        out.append((f"{p}_used", used))
        out.append((f"{p}_eras", packed(f"{p}_used", ["person_id"], ex.era_gap)))
        ends.append(
            f"SELECT i.person_id, i.event_id, i.s, x.e FROM {p}_i i JOIN {p}_eras x "
            f"ON x.person_id = i.person_id AND i.s BETWEEN x.s AND x.e"
        )
    for c in spec.censor:
        ends.append(
            f"SELECT i.person_id, i.event_id, i.s, min(a.s) FROM {p}_i i JOIN ({criterion(c)}) a "
            f"ON a.person_id = i.person_id AND a.s > i.s AND a.s <= i.op_end GROUP BY 1, 2, 3"
        )
    out.append((f"{p}_ends", " UNION ALL ".join(ends)))
    out.append(
        (f"{p}_rows", f"SELECT person_id, event_id, s, min(e) AS e FROM {p}_ends WHERE e >= s GROUP BY 1, 2, 3")
    )
    out.append((p, packed(f"{p}_rows", ["person_id"], spec.pad)))
    return out


def cohort(spec: CohortSpec) -> str:
    final = (
        f"SELECT CAST({spec.id} AS BIGINT) AS cohort_definition_id, person_id AS subject_id, "
        f"s AS cohort_start_date, e AS cohort_end_date FROM p{spec.id}"
    )
    return with_tables(parts(spec), final, CLINICAL)


def all_rows(specs: list[CohortSpec], name: str) -> list[tuple[str, str]]:
    """CTEs of several cohorts and one that unions their rows (id, person_id, s, e)."""
    out = [part for spec in specs for part in parts(spec)]
    union = " UNION ALL ".join(f"SELECT {s.id} AS id, person_id, s, e FROM p{s.id}" for s in specs)
    return out + [(name, union)]
