"""The study's cohorts: 12 exposures, 17 outcomes, 2 infection cohorts, 3 history templates.

Concept sets are parameters: the definitions refer to them by name and the caller
supplies a table (codeset, concept_id, include_descendants).  ``CODESETS`` lists the
names.  Sets of "other brands" follow from the brand sets and need not be supplied.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from cohortide.plans.specs import CohortSpec, Criterion, Exit, Nearby, Rule

# ---- fixed values of the study --------------------------------------------------
# Cohort numbers and names.
EXPOSURES = {
    101: "dose1_AZ",
    102: "dose1_pfizer",
    103: "dose1_moderna",
    104: "dose1_janssen",
    201: "dose2_AZ",
    202: "dose2_pfizer",
    203: "dose2_moderna",
    204: "dose2_pfizer_any",
    205: "dose2_pfizer_mix",
    206: "dose2_moderna_any",
    207: "dose2_moderna_mix",
    301: "General population 2017",
}
OUTCOMES = {
    302: "CVST",
    303: "DVT narrow",
    305: "isc stroke",
    306: "MI isc stroke",
    307: "MI",
    308: "PE",
    309: "SVT",
    310: "thrombocyt",
    311: "VTE narrow",
    401: "TTS_ATE",
    402: "TTS_CVST",
    403: "TTS_DVT",
    404: "TTS_isc stroke",
    405: "TTS_MI",
    406: "TTS_PE",
    407: "TTS_SVT",
    408: "TTS_VTE",
}
GENERAL_POPULATION = "General population 2017"
COVID = {1: "COVID19 diagnosis broad", 2: "COVID19 positive test"}
# Study cohorts made of several exposure cohorts, in report order.
COMPOSITES = (
    "Any first-dose",
    "Any full-dose",
    "Viral vector first-dose",
    "mRNA first-dose",
    "Viral vector full-dose",
    "mRNA full-dose",
    "mRNA second-dose after viral vector first-dose",
)
# Ancestor concepts of the comorbidities.
CONDITIONS = {
    "autoimmune_disease": 434621,
    "antiphospholipid_syndrome": 4098292,
    "thrombophilia": 4125650,
    "asthma": 317009,
    "atrial_fibrillation": 313217,
    "malignant_neoplastic_disease": 443392,
    "diabetes_mellitus": 201820,
    "obesity": 433736,
    "heart_disease": 321588,
    "hypertensive_disorder": 316866,
    "renal_impairment": 4030518,
    "copd": 255573,
    "dementia": 4182210,
}
# Ancestor concepts of the drug classes.
DRUGS = {
    "antiinflamatory_and_antirheumatic": 21603933,
    "coxibs": 21603991,
    "corticosteroids": 21602722,
    "antithrombotic": 21600961,
    "lipid_modifying": 21601853,
    "antineoplastic_immunomodulating": 21601386,
    "hormonal_contraceptives": 21602472,
    "tamoxifen": 21603831,
    "sex_hormones_modulators": 21602471,
    "immunoglobulins": 21601254,
}
# Members of the composite flags.
CONDITIONS_OF_INTEREST = (
    "autoimmune_disease",
    "antiphospholipid_syndrome",
    "thrombophilia",
    "atrial_fibrillation",
    "malignant_neoplastic_disease",
    "diabetes_mellitus",
    "obesity",
    "renal_impairment",
)
DRUGS_OF_INTEREST = (
    "antiinflamatory_and_antirheumatic",
    "coxibs",
    "corticosteroids",
    "hormonal_contraceptives",
    "tamoxifen",
    "sex_hormones_modulators",
)
# Variables with odds ratios.
MODEL_VARIABLES = (
    "asthma",
    "diabetes_mellitus",
    "malignant_neoplastic_disease",
    "heart_disease",
    "hypertensive_disorder",
    "obesity",
    "renal_impairment",
    "cond_comp",
    "antiinflamatory_and_antirheumatic",
    "antithrombotic",
    "corticosteroids",
    "drug_comp",
)
# Outcomes and study cohorts of the short run.
MAIN_OUTCOMES = ("CVST", "MI isc stroke", "SVT", "thrombocyt", "VTE narrow", "TTS_ATE", "TTS_VTE")
MAIN_STUDY_COHORTS = ("General population 2017", "Any first-dose", "Any full-dose")
# Platelet units: per litre style units, and the single unit counted in thousands.
PLATELET_UNITS = (8848, 8961, 8785, 8686, 9444, 9254, 8816)
PLATELET_UNITS_THOUSANDS = (8647,)
# Coded positive test results.
POSITIVE_RESULTS = (9191, 4126681, 4181412, 45879438, 45884084, 45877985)
# Coded answers that mean a smoker.
SMOKER_ANSWERS = ((4034855,), (45884037,))
MALE, FEMALE = 8507, 8532
# Study cohorts made of several exposure cohorts.
COMPOSITE_MEMBERS = {
    "Any first-dose": ("dose1_AZ", "dose1_pfizer", "dose1_moderna", "dose1_janssen"),
    "Any full-dose": ("dose1_janssen", "dose2_AZ", "dose2_moderna_any", "dose2_pfizer_any"),
    "Viral vector first-dose": ("dose1_janssen", "dose1_AZ"),
    "mRNA first-dose": ("dose1_moderna", "dose1_pfizer"),
    "Viral vector full-dose": ("dose2_AZ", "dose1_janssen"),
    "mRNA full-dose": ("dose2_moderna", "dose2_pfizer"),
    "mRNA second-dose after viral vector first-dose": ("dose2_moderna_mix", "dose2_pfizer_mix"),
}
# Study cohorts whose follow-up ends with a next vaccine: one of these, or any second dose.
CENSORED_BY_FULL_DOSE = ("dose1_AZ", "dose1_moderna", "dose1_pfizer")
FULL_DOSES = ("dose2_AZ", "dose2_moderna_any", "dose2_pfizer_any")
CENSORED_BY_SECOND_DOSE = ("Any first-dose", "Viral vector first-dose", "mRNA first-dose")

# ---- end of fixed values --------------------------------------------------------

BRANDS = ("AZ", "pfizer", "moderna", "janssen")

CODESETS = (
    *(f"vaccine_{b}" for b in BRANDS),
    "vaccine_any",
    "vaccine_mrna",
    "cvst",
    "dvt",
    "pe",
    "isc_stroke",
    "mi",
    "svt",
    "ate",
    "thrombocytopenia",
    "platelets",
    "platelets_any_unit",
    "covid_diagnosis",
    "covid_test",
    "smoking_observation",
    "smoking_question",
    "smoking_answer",
    "smoking_condition",
)


@dataclass(frozen=True)
class Calendar:
    """The dates the study hangs on."""

    vaccines_after: dt.date = dt.date(2020, 12, 1)
    observed_since: dt.date = dt.date(2019, 12, 1)
    general_population: dt.date = dt.date(2017, 1, 1)
    drug_eras_from: dt.date = dt.date(2020, 5, 1)
    drug_template_from: dt.date = dt.date(2019, 1, 1)
    covid_from_year: int = 2020


def _both_tables(codeset: str, **filters) -> tuple[Criterion, ...]:
    """A vaccine code may sit in either table and in either code column."""
    return tuple(
        Criterion(domain, codeset, concept, **filters)
        for domain in ("drug_exposure", "observation")
        for concept in ("standard", "source")
    )


def _none_before(name: str, codeset: str) -> Rule:
    """No such vaccine up to the day before.  Drug codes look past the observation period."""
    checks = tuple(
        Nearby(c, None, -1, exactly=0, inside_period=i > 0) for i, c in enumerate(_both_tables(codeset))
    )
    return Rule(name, checks, "all")


def _some_before(name: str, codeset: str) -> Rule:
    return Rule(name, tuple(Nearby(c, -180, -14) for c in _both_tables(codeset)), "any")


def exposure_specs(cal: Calendar = Calendar()) -> list[CohortSpec]:
    adult = Rule("adult", min_age=18)
    observed = Rule("long observation", observed_since=cal.observed_since)
    four_weeks = Exit("start", 28)

    def dose(id: int, brand: str, rules: tuple[Rule, ...], **more) -> CohortSpec:
        entry = _both_tables(f"vaccine_{brand}", after=cal.vaccines_after)
        return CohortSpec(
            id,
            EXPOSURES[id],
            entry,
            first_included=True,
            rules=rules + (adult, observed),
            exit=four_weeks,
            **more,
        )

    specs = [
        dose(
            id,
            brand,
            (_none_before("no earlier vaccine", "vaccine_any"),),
            first_primary=True,
            censor=_both_tables("vaccine_any"),
        )
        for id, brand in ((101, "AZ"), (102, "pfizer"), (103, "moderna"), (104, "janssen"))
    ]
    for id, brand in ((201, "AZ"), (202, "pfizer"), (203, "moderna")):
        specs.append(
            dose(
                id,
                brand,
                (
                    _some_before("same brand before", f"vaccine_{brand}"),
                    _none_before("no other brand before", f"vaccine_not_{brand}"),
                ),
            )
        )
    for id, brand in ((204, "pfizer"), (206, "moderna")):
        specs.append(dose(id, brand, (_some_before("any brand before", "vaccine_any"),)))
    for id, brand in ((205, "pfizer"), (207, "moderna")):
        specs.append(
            dose(
                id,
                brand,
                (
                    _some_before("viral vector before", "vaccine_vector"),
                    _none_before("no mRNA before", "vaccine_mrna"),
                ),
            )
        )
    specs.append(
        CohortSpec(301, EXPOSURES[301], covering=cal.general_population, exit=Exit("start", 364))
    )
    return specs


def _conditions(*codesets: str) -> tuple[Criterion, ...]:
    return tuple(Criterion("condition_occurrence", c) for c in codesets)


def low_platelets() -> tuple[Criterion, ...]:
    return (
        Criterion("measurement", "platelets", value_min=10.0, value_max=150.0, units=PLATELET_UNITS),
        Criterion(
            "measurement",
            "platelets",
            value_min=10_000.0,
            value_max=150_000.0,
            units=PLATELET_UNITS_THOUSANDS,
        ),
        Criterion("measurement", "platelets_any_unit", value_min=10.0, value_max=150.0),
        *_conditions("thrombocytopenia"),
    )


def outcome_specs() -> list[CohortSpec]:
    def plain(id: int, codesets: tuple[str, ...], exit: Exit, pad: int) -> CohortSpec:
        return CohortSpec(id, OUTCOMES[id], _conditions(*codesets), exit=exit, pad=pad)

    after_end = Exit("end", 1, "start")
    specs = [
        plain(302, ("cvst",), Exit("start", 0, "start"), 30),
        plain(303, ("dvt",), after_end, 30),
        plain(305, ("isc_stroke",), Exit("start", 7, "start"), 180),
        plain(306, ("mi", "isc_stroke"), Exit("start", 0, "start"), 0),
        plain(307, ("mi",), Exit("start", 7, "start"), 180),
        plain(308, ("pe",), after_end, 30),
        plain(309, ("svt",), Exit("period"), 0),
        CohortSpec(310, OUTCOMES[310], low_platelets(), exit=Exit("start", 1, "start")),
        plain(311, ("dvt", "pe"), after_end, 30),
    ]
    low = Rule("low platelets nearby", tuple(Nearby(c, -10, 10) for c in low_platelets()), "any")
    for id, codeset in (
        (401, "ate"),
        (402, "cvst"),
        (403, "dvt"),
        (404, "isc_stroke"),
        (405, "mi"),
        (406, "pe"),
        (407, "svt"),
        (408, "vte"),
    ):
        rules = (low,)
        if id == 406:
            quiet = Nearby(Criterion("condition_occurrence", codeset), -365, -1, exactly=0)
            rules = (Rule("none in the year before", (quiet,)), low)
        specs.append(
            CohortSpec(id, OUTCOMES[id], _conditions(codeset), rules=rules, exit=Exit("end", 1), pad=30)
        )
    return specs


def covid_specs() -> list[CohortSpec]:
    first = dict(first_qualified=True, first_included=True)
    diagnosis = (
        Criterion("condition_occurrence", "covid_diagnosis"),
        Criterion("observation", "covid_diagnosis"),
    )
    test = (Criterion("measurement", "covid_test", value_concepts=POSITIVE_RESULTS),)
    return [CohortSpec(1, COVID[1], diagnosis, **first), CohortSpec(2, COVID[2], test, **first)]


def condition_template(id: int, name: str, codeset: str) -> CohortSpec:
    """All occurrences of a condition and its descendants, to the end of observation."""
    return CohortSpec(id, name, _conditions(codeset))


def drug_template(id: int, name: str, codeset: str, cal: Calendar = Calendar()) -> CohortSpec:
    """Use of a drug class, to the end of the continuous drug era."""
    entry = (Criterion("drug_exposure", codeset, not_before=cal.drug_template_from),)
    return CohortSpec(id, name, entry, exit=Exit("era", era_codeset=codeset, era_gap=30))


def smoking_spec(id: int = 3) -> CohortSpec:
    question, answer = SMOKER_ANSWERS
    entry = (
        Criterion("observation", "smoking_observation"),
        Criterion("observation", "smoking_question", value_concepts=question),
        Criterion("observation", "smoking_answer", value_concepts=answer),
        *_conditions("smoking_condition"),
    )
    return CohortSpec(id, "smoking", entry)


def derived_codesets() -> list[tuple[str, tuple[str, ...], tuple[str, ...]]]:
    """(name, union of these sets, minus these sets)."""
    return [
        *((f"vaccine_not_{b}", ("vaccine_any",), (f"vaccine_{b}",)) for b in ("AZ", "pfizer", "moderna")),
        ("vaccine_vector", ("vaccine_any",), ("vaccine_mrna",)),
        ("vte", ("dvt", "pe"), ()),
    ]


def study_members() -> dict[str, tuple[str, ...]]:
    """Study cohort -> exposure cohorts it is made of."""
    return {name: (name,) for name in EXPOSURES.values()} | COMPOSITE_MEMBERS


def study_censors() -> dict[str, tuple[str, ...]]:
    """Study cohort -> exposure cohorts that end follow-up (the next vaccine)."""
    any_second = tuple(n for n in EXPOSURES.values() if "dose2" in n)
    return dict.fromkeys(CENSORED_BY_FULL_DOSE, FULL_DOSES) | dict.fromkeys(CENSORED_BY_SECOND_DOSE, any_second)
