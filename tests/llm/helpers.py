"""Small tables with the cases that every operator must stand."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
LABELS = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("quality", T.IntegerType()), ("toxic", T.IntegerType()))])

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(ascii_lower(text))


def docs(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def prose(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    """Words that look random and are the same on every run."""
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"w{(x >> 8) % vocabulary}")
    return out
