"""The clinical tables and concept sets as SQL over the test tables."""

from __future__ import annotations

from cohortide.plans.definitions import derived_codesets
from cohortide.sources.adapter import _CODE_RANGES, CODESETS

_RANGES = " UNION ALL ".join(f"SELECT {first} + i AS id FROM range({count}) t(i)" for first, count in _CODE_RANGES)


def _codeset_rows() -> str:
    return ", ".join(
        f"('{name}', {code}, {str(deep).lower()})" for name, (codes, deep) in CODESETS.items() for code in codes
    )


def _derived() -> str:
    parts = []
    for name, plus, minus in derived_codesets():
        added = " UNION ".join(f"SELECT concept_id FROM plain_codes WHERE codeset = '{m}'" for m in plus)
        sql = f"SELECT '{name}' AS codeset, concept_id FROM ({added}) WHERE true"
        for m in minus:
            sql += f" AND concept_id NOT IN (SELECT concept_id FROM plain_codes WHERE codeset = '{m}')"
        parts.append(sql)
    return " UNION ALL ".join(parts)


# name -> (tables it needs, SQL)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "person": (
        (),
        """SELECT c_custkey AS person_id,
        CASE WHEN c_custkey % 97 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN 8507 ELSE 8532 END AS gender_concept_id,
        CAST(1910 + c_custkey % 75 AS INTEGER) AS year_of_birth,
        CAST(1 + c_custkey % 12 AS INTEGER) AS month_of_birth,
        CAST(1 + c_custkey % 28 AS INTEGER) AS day_of_birth FROM customer""",
    ),
    "op": (
        (),
        """SELECT person_id, s AS op_start, e AS op_end FROM (
        SELECT o_custkey AS person_id, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e
        FROM orders GROUP BY 1)
        UNION ALL
        SELECT o_custkey, CAST(max(o_orderdate) AS DATE) + 30, CAST(max(o_orderdate) AS DATE) + 400
        FROM orders WHERE o_custkey % 53 = 0 GROUP BY 1""",
    ),
    "drug": (
        (),
        """SELECT o_custkey AS person_id,
        CASE WHEN l_partkey % 40 <= 3 AND l_shipdate::DATE > DATE '1998-01-01' THEN 300000 + l_partkey % 40
             ELSE l_partkey END AS standard,
        CASE WHEN l_linenumber = 7 AND l_suppkey % 50 <= 3 AND l_shipdate::DATE > DATE '1998-01-01'
             THEN 310000 + l_suppkey % 50 ELSE 100000 + l_suppkey END AS source,
        l_shipdate::DATE AS s,
        CASE WHEN l_linenumber % 3 = 0
             THEN CASE WHEN l_suppkey % 2 = 0 THEN l_shipdate::DATE + 1 ELSE l_shipdate::DATE + l_quantity::INTEGER END
             ELSE l_shipdate::DATE + l_quantity::INTEGER END AS e
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "cond": (
        (),
        """SELECT o_custkey AS person_id, 500000 + o_orderkey % 40 AS standard, o_orderdate::DATE AS s,
        CASE WHEN o_orderstatus = 'P' THEN o_orderdate::DATE + 1 ELSE o_orderdate::DATE + 3 END AS e FROM orders""",
    ),
    "meas": (
        (),
        """SELECT user_id AS person_id,
        CASE event_type WHEN 'click' THEN 600000 WHEN 'error' THEN 600001 WHEN 'purchase' THEN 600002
             ELSE 600003 END AS standard,
        DATE '1998-01-01' + (event_id % 1000)::INTEGER AS s, DATE '1998-01-01' + (event_id % 1000)::INTEGER + 1 AS e,
        CASE WHEN event_id % 3 = 1 THEN value * 1000 ELSE value END AS value,
        CASE event_id % 3 WHEN 0 THEN 8848 WHEN 1 THEN 8647 END AS unit,
        CASE WHEN event_id % 7 = 0 THEN 9191 END AS value_concept
        FROM events WHERE event_type <> 'signup'""",
    ),
    "obs": (
        (),
        """SELECT user_id AS person_id,
        CASE WHEN event_id % 40 = 0 THEN 320000 + (event_id // 40) % 4 ELSE 650000 + event_id % 6 END AS standard,
        CASE WHEN event_id % 41 = 0 THEN 330000 + (event_id // 41) % 4
             WHEN event_id % 2 = 0 THEN 650001 END AS source,
        DATE '1998-01-01' + (event_id % 1000)::INTEGER AS s, DATE '1998-01-01' + (event_id % 1000)::INTEGER + 1 AS e,
        CASE event_id % 5 WHEN 0 THEN 4034855 WHEN 1 THEN 45884037 END AS value_concept
        FROM events WHERE event_type = 'signup'""",
    ),
    "concept": (
        (),
        f"""SELECT p_partkey AS concept_id, CASE WHEN p_size = 50 THEN 'D' END AS invalid_reason FROM part
        UNION ALL SELECT id, NULL FROM ({_RANGES})""",
    ),
    "ancestor": (
        ("concept",),
        """SELECT 700000 + p_partkey % 10 AS top, p_partkey AS below FROM part
        UNION ALL SELECT 710000 + i % 13, 500000 + i FROM range(40) t(i)
        UNION ALL SELECT 720000, 600000 + i FROM range(4) t(i)
        UNION ALL SELECT concept_id, concept_id FROM concept""",
    ),
    "code_lines": ((), f"SELECT * FROM (VALUES {_codeset_rows()}) v(codeset, concept_id, deep)"),
    "plain_codes": (
        ("code_lines", "concept", "ancestor"),
        """SELECT codeset, concept_id FROM code_lines WHERE concept_id IN (SELECT concept_id FROM concept)
        UNION
        SELECT l.codeset, a.below FROM code_lines l JOIN ancestor a ON l.deep AND a.top = l.concept_id
        JOIN concept c ON c.concept_id = a.below AND c.invalid_reason IS NULL""",
    ),
    "codes": (("plain_codes",), f"SELECT * FROM plain_codes UNION ALL {_derived()}"),
}


# Later steps read these more than once.
HEAVY = ("exposure", "outcome", "covid", "pop0", "pop", "drug_era", "hit", "followed", "tar", "sliced", "shown")


def with_tables(parts: list[tuple[str, str]], final: str, needs: tuple[str, ...]) -> str:
    """One statement: the needed clinical tables, then ``parts`` in order, then ``final``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in TABLES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    ctes = [f"{n} AS MATERIALIZED ({TABLES[n][1]})" for n in order]
    ctes += [f"{n} AS {'MATERIALIZED ' if n in HEAVY else ''}({sql})" for n, sql in parts]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + final


def packed(rows: str, keys: list[str], pad: int) -> str:
    """Merge intervals (keys, s, e) by era edges.

    A start opens an era when no earlier interval reaches it; an end closes one when
    no interval near enough goes further.  Each opening start pairs with the first
    closing end after it.
    """
    same = " AND ".join(f"o.{k} = r.{k}" for k in keys)
    pair = " AND ".join(f"z.{k} = a.{k}" for k in keys)
    cols, acols = ", ".join(f"r.{k}" for k in keys), ", ".join(f"a.{k}" for k in keys)
    return (
        f"SELECT {acols}, a.s AS s, min(z.e) AS e FROM "
        f"(SELECT DISTINCT {cols}, r.s FROM {rows} r WHERE NOT EXISTS "
        f"(SELECT 1 FROM {rows} o WHERE {same} AND o.s < r.s AND o.e + {pad} >= r.s)) a JOIN "
        f"(SELECT DISTINCT {cols}, r.e FROM {rows} r WHERE NOT EXISTS "
        f"(SELECT 1 FROM {rows} o WHERE {same} AND o.s <= r.e + {pad} AND o.e > r.e)) z "
        f"ON {pair} AND z.e >= a.s GROUP BY {acols}, a.s"
    )
