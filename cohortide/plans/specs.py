"""What a cohort is, declared as data.

A cohort is: entry events inside an observation period, optionally only the first;
inclusion rules around each event; an exit date; and merging of the resulting
intervals.  The operators read these declarations as small lookup tables, so any
number of cohorts is built in one pass over the clinical tables.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

DOMAINS = ("condition_occurrence", "drug_exposure", "measurement", "observation")


@dataclass(frozen=True)
class Criterion:
    """Rows of one clinical table whose code is in a concept set, plus value filters."""

    domain: str
    codeset: str
    concept: str = "standard"  # or "source"
    after: dt.date | None = None  # date strictly later than this
    not_before: dt.date | None = None
    value_min: float | None = None
    value_max: float | None = None
    units: tuple[int, ...] = ()
    value_concepts: tuple[int, ...] = ()

    def __post_init__(self):
        if self.domain not in DOMAINS:
            raise ValueError(f"unknown domain {self.domain}")
        if self.concept == "source" and self.domain not in ("drug_exposure", "observation"):
            raise ValueError(f"{self.domain} has no source code column here")


@dataclass(frozen=True)
class Nearby:
    """A count of events in a window of days around the index date.

    ``first`` and ``last`` are day offsets; None leaves that side open.  With
    ``inside_period`` only events within the index event's observation period count.
    """

    criterion: Criterion
    first: int | None
    last: int | None
    at_least: int = 1
    exactly: int | None = None
    inside_period: bool = True


@dataclass(frozen=True)
class Rule:
    """An inclusion rule: a group of nearby counts, a minimum age, or a long observation."""

    name: str
    nearby: tuple[Nearby, ...] = ()
    match: str = "all"  # or "any"
    min_age: int | None = None
    observed_since: dt.date | None = None  # period must start before this date
    observed_days: int = 365


@dataclass(frozen=True)
class Exit:
    """When a cohort interval ends.

    ``kind``: ``start`` / ``end`` (offset from that date of the event), ``period``
    (end of observation) or ``era`` (end of the covering drug era, at most the end of
    observation).  ``bound``: ``period`` caps at the end of observation, ``start`` only
    keeps the end from falling before the start.
    """

    kind: str = "period"
    days: int = 0
    bound: str = "period"
    era_codeset: str | None = None
    era_gap: int = 30


@dataclass(frozen=True)
class CohortSpec:
    id: int
    name: str
    entry: tuple[Criterion, ...] = ()
    covering: dt.date | None = None  # entry by an observation period covering this date
    prior_days: int = 0
    post_days: int = 0
    first_primary: bool = False
    first_qualified: bool = False
    first_included: bool = False
    rules: tuple[Rule, ...] = ()
    exit: Exit = field(default_factory=Exit)
    censor: tuple[Criterion, ...] = ()
    pad: int = 0

    def __post_init__(self):
        if bool(self.entry) == bool(self.covering):
            raise ValueError(f"{self.name}: give entry criteria or a covering date")
        if len(self.rules) > 62:
            raise ValueError(f"{self.name}: a rule mask holds 62 rules")


def criteria_of(specs: list[CohortSpec]) -> list[Criterion]:
    """The distinct criteria of all specs; the position in the list is the criterion id."""
    seen: dict[Criterion, None] = {}
    for spec in specs:
        for c in spec.entry + spec.censor:
            seen.setdefault(c)
        for rule in spec.rules:
            for n in rule.nearby:
                seen.setdefault(n.criterion)
        if spec.exit.kind == "era":
            for concept in ("standard", "source"):
                seen.setdefault(Criterion("drug_exposure", spec.exit.era_codeset, concept))
    return list(seen)
