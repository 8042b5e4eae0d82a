"""Words and lower case, the same in Spark, Python and DuckDB."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of ASCII letters and digits and of everything beyond ASCII; capitals are lowered first.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs without ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """Lower A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def words_sql(text: str) -> str:
    low = f"translate(coalesce({text}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"regexp_extract_all({low}, '{WORD}')"


def positions(count: Column, width: int | Column = 1) -> Column:
    """0, 1, ... for all windows of so many words; empty when there are too few."""
    last = count - width
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
