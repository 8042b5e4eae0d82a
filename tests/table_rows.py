"""Dates from text and rows in a fixed order, for tests of the cohort engine."""

from __future__ import annotations

import datetime as dt


def day(text: str | None):
    return dt.date.fromisoformat(text) if text else None


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is None, v) for v in t))
