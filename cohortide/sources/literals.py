"""Small lookup tables written into the query plan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dt.date):
        return f"DATE'{value.isoformat()}'"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(_sql, value))})"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def literal_table(spark: SparkSession, rows: Sequence[Sequence], schema: str | T.StructType) -> DataFrame:
    """A DataFrame over constant rows.

    The rows travel inside the plan, so Spark knows the size, folds filters on them and
    starts no job to read them.  Meant for declarations: specs, code lists, mappings.
    """
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    if not rows:
        return spark.createDataFrame([], schema)
    values = ", ".join(f"({', '.join(map(_sql, row))})" for row in rows)
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    columns = ", ".join(f"CAST(c{i} AS {f.dataType.simpleString()}) AS `{f.name}`" for i, f in enumerate(fields))
    return spark.sql(f"SELECT {columns} FROM VALUES {values} AS t({names})")
