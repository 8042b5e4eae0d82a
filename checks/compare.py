"""Run a Spark query and its SQL in DuckDB and compare all rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, dt.datetime) and v.time() == dt.time(0):
        return v.date()
    return v


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> tuple[int, list[str]]:
    """(row count, problems); no problems means the results are the same bag of rows."""
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want = _rows(want_names, cur.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    n = sum(got.values())
    if sorted(want_names) != sorted(df.columns):
        return n, [f"columns {sorted(df.columns)} vs {sorted(want_names)}"]
    missing, extra = want - got, got - want
    problems = []
    if missing or extra:
        problems.append(f"{n} vs {sum(want.values())} rows; missing {sum(missing.values())}: "
                        f"{list(missing)[:3]}; extra {sum(extra.values())}: {list(extra)[:3]}")
    return n, problems
