"""The numbers of every cohort, stated once more by hand."""

from __future__ import annotations

import datetime as dt

import pytest

from cohortide.plans import definitions as d

# id: name, limits (P first primary, Q first qualified, R first included), exit, pad, rules
DOSE = ("start", 28, "period")
COHORTS = {
    101: ("dose1_AZ", "PR", DOSE, 0, ["none before", "adult", "observed"]),
    102: ("dose1_pfizer", "PR", DOSE, 0, ["none before", "adult", "observed"]),
    103: ("dose1_moderna", "PR", DOSE, 0, ["none before", "adult", "observed"]),
    104: ("dose1_janssen", "PR", DOSE, 0, ["none before", "adult", "observed"]),
    201: ("dose2_AZ", "R", DOSE, 0, ["-180..-14", "none before", "adult", "observed"]),
    202: ("dose2_pfizer", "R", DOSE, 0, ["-180..-14", "none before", "adult", "observed"]),
    203: ("dose2_moderna", "R", DOSE, 0, ["-180..-14", "none before", "adult", "observed"]),
    204: ("dose2_pfizer_any", "R", DOSE, 0, ["-180..-14", "adult", "observed"]),
    205: ("dose2_pfizer_mix", "R", DOSE, 0, ["-180..-14", "none before", "adult", "observed"]),
    206: ("dose2_moderna_any", "R", DOSE, 0, ["-180..-14", "adult", "observed"]),
    207: ("dose2_moderna_mix", "R", DOSE, 0, ["-180..-14", "none before", "adult", "observed"]),
    301: ("General population 2017", "", ("start", 364, "period"), 0, []),
    302: ("CVST", "", ("start", 0, "start"), 30, []),
    303: ("DVT narrow", "", ("end", 1, "start"), 30, []),
    305: ("isc stroke", "", ("start", 7, "start"), 180, []),
    306: ("MI isc stroke", "", ("start", 0, "start"), 0, []),
    307: ("MI", "", ("start", 7, "start"), 180, []),
    308: ("PE", "", ("end", 1, "start"), 30, []),
    309: ("SVT", "", ("period", 0, "period"), 0, []),
    310: ("thrombocyt", "", ("start", 1, "start"), 0, []),
    311: ("VTE narrow", "", ("end", 1, "start"), 30, []),
    401: ("TTS_ATE", "", ("end", 1, "period"), 30, ["-10..10"]),
    402: ("TTS_CVST", "", ("end", 1, "period"), 30, ["-10..10"]),
    403: ("TTS_DVT", "", ("end", 1, "period"), 30, ["-10..10"]),
    404: ("TTS_isc stroke", "", ("end", 1, "period"), 30, ["-10..10"]),
    405: ("TTS_MI", "", ("end", 1, "period"), 30, ["-10..10"]),
    406: ("TTS_PE", "", ("end", 1, "period"), 30, ["-365..-1 none", "-10..10"]),
    407: ("TTS_SVT", "", ("end", 1, "period"), 30, ["-10..10"]),
    408: ("TTS_VTE", "", ("end", 1, "period"), 30, ["-10..10"]),
    1: ("COVID19 diagnosis broad", "QR", ("period", 0, "period"), 0, []),
    2: ("COVID19 positive test", "QR", ("period", 0, "period"), 0, []),
}
SPECS = {s.id: s for s in d.exposure_specs() + d.outcome_specs() + d.covid_specs()}


def _kind(rule) -> str:
    if rule.min_age is not None:
        assert rule.min_age == 18
        return "adult"
    if rule.observed_since:
        assert (rule.observed_since, rule.observed_days) == (dt.date(2019, 12, 1), 365)
        return "observed"
    windows = {(n.first, n.last, n.exactly) for n in rule.nearby}
    assert len(windows) == 1
    first, last, exactly = windows.pop()
    if (first, last, exactly) == (None, -1, 0):
        assert rule.match == "all" and len(rule.nearby) == 4
        return "none before"
    assert exactly == 0 or rule.match == "any"
    return f"{first}..{last}" + (" none" if exactly == 0 else "")


def test_every_cohort_is_stated():
    assert set(SPECS) == set(COHORTS)


@pytest.mark.parametrize("id", sorted(COHORTS))
def test_numbers_of_a_cohort(id):
    spec = SPECS[id]
    name, limits, leave, pad, rules = COHORTS[id]
    flags = (("P", spec.first_primary), ("Q", spec.first_qualified), ("R", spec.first_included))
    assert spec.name == name
    assert "".join(letter for letter, on in flags if on) == limits
    assert (spec.exit.kind, spec.exit.days, spec.exit.bound) == leave
    assert spec.pad == pad
    assert [_kind(r) for r in spec.rules] == rules
    assert bool(spec.censor) == (id in (101, 102, 103, 104))


def test_calendar():
    cal = d.Calendar()
    assert cal.vaccines_after == dt.date(2020, 12, 1)
    assert cal.observed_since == dt.date(2019, 12, 1)
    assert cal.general_population == dt.date(2017, 1, 1)


def test_platelet_ranges():
    low, thousands, *_ = d.low_platelets()
    assert (low.value_min, low.value_max) == (10, 150)
    assert (thousands.value_min, thousands.value_max, tuple(thousands.units)) == (10_000, 150_000, (8647,))
