"""The study end to end: cohorts, populations, follow-up and the four result tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from cohortide.operators import (
    attrition,
    cohort,
    concepts,
    covariates,
    events,
    followup,
    models,
    population,
    summaries,
    survival,
)
from cohortide import schemas
from cohortide.plans import definitions as d, manifest as listing
from cohortide.plans.specs import CohortSpec
from cohortide.sources import tables
from cohortide.sources.cdm import Cdm
from cohortide.sources.literals import literal_table
from cohortide.sources.workspace import Workspace, fingerprint


class Study:
    """Lazily built tables of one study; each is derived once and kept in the workspace.

    ``studies`` and ``outcomes`` restrict the run, e.g. to ``d.MAIN_STUDY_COHORTS`` and
    ``d.MAIN_OUTCOMES``.  ``stored`` starts from cohort tables that are already there instead of building
    them: "cohorts", "comorbidities" and "medications", any of them, as ``run`` writes them.

    The gates are the study's own: a cohort counts from more than ``min_rows`` rows, a pair of study
    cohort and outcome from ``min_pair`` outcome rows, a slice is modelled from ``min_events``
    events, and an exposure from more than ``min_exposed`` exposed people.

    With ``earliest``, days at risk without the outcome end with observation where that comes before a next vaccine.

    Used as a context manager, a study drops its intermediate tables at the end.  With ``resume``, a
    study that fails leaves them, and the next one over the same files with the same settings goes on from
    there; inputs that are not files, like ``stored`` tables computed on the fly, should not be resumed.
    """

    def __init__(
        self,
        cdm: Cdm,
        concept_sets: DataFrame,
        calendar: d.Calendar = d.Calendar(),
        condition_tops: dict[str, int] = d.CONDITIONS,
        drug_tops: dict[str, int] = d.DRUGS,
        studies: tuple[str, ...] | None = None,
        outcomes: tuple[str, ...] | None = None,
        extra_specs: list[CohortSpec] = (),
        born_after: int | None = None,
        op_containing_index: bool = False,
        interaction_test: str = "total",
        stored: dict[str, DataFrame] | None = None,
        min_rows: int = 5,
        min_pair: int = 5,
        min_events: int = 30,
        min_exposed: int = 5,
        manifest: DataFrame | None = None,
        resume: bool = False,
        earliest: bool = False,
    ):
        self.cdm, self.spark = cdm, cdm.spark
        self.definitions, self.calendar = concept_sets, calendar
        self.condition_tops, self.drug_tops = condition_tops, drug_tops
        self.studies, self.outcomes = studies, outcomes
        self.extra_specs = list(extra_specs)
        self.born_after, self.op_containing_index = born_after, op_containing_index
        self.interaction_test = interaction_test
        self.stored = stored or {}
        self.min_rows, self.min_pair = min_rows, min_pair
        self.min_events, self.min_exposed = min_events, min_exposed
        self.manifest, self.earliest = manifest, earliest
        self.work = Workspace(cdm.spark, self._key() if resume else None)

    def __enter__(self) -> Study:
        return self

    def __exit__(self, failure, *_) -> None:
        self.work.close(finished=failure is None)

    def _key(self) -> str:
        """What the tables of this study depend on."""
        sets = sorted(map(tuple, self.definitions.collect()), key=repr)  # the declared code lists
        frames = [getattr(self.cdm, name) for name in schemas.CLINICAL_TABLES]
        frames += [self.stored[name] for name in sorted(self.stored)]
        return fingerprint(
            frames, sets, self.specs, self.calendar, self.condition_tops, self.drug_tops, self.studies, sorted(self.stored),
            self.born_after, self.op_containing_index, self.min_rows, self.min_pair, self.min_events, self.min_exposed,
            self.earliest,
        )

    # ---- cohorts -----------------------------------------------------------------

    @cached_property
    def specs(self) -> list[CohortSpec]:
        chosen = [s for s in d.outcome_specs() if self.outcomes is None or s.name in self.outcomes]
        return d.exposure_specs(self.calendar) + chosen + d.covid_specs() + self.extra_specs

    @cached_property
    def listed(self) -> dict[int, int]:
        """Number of each cohort to write -> its number in the cohort table; all under their own without a manifest."""
        if self.manifest is None:
            return {s.id: s.id for s in self.specs}
        return listing.resolve(self.manifest, self.specs)

    @property
    def listed_cohorts(self) -> DataFrame:
        """Cohort rows as the cohort table has them."""
        return self.cohorts if self.manifest is None else listing.renumbered(self.cohorts, self.listed)

    @cached_property
    def codesets(self) -> DataFrame:
        def build() -> DataFrame:
            sets = concepts.resolve_concept_sets(self.definitions, self.cdm.concept, self.cdm.concept_ancestor)
            return concepts.add_derived_sets(sets)

        return self.work.stage("codesets", build, None)

    @cached_property
    def periods(self) -> DataFrame:
        return self.work.stage("periods", lambda: events.compact_periods(self.cdm.observation_period))

    @cached_property
    def days(self) -> DataFrame:
        return cohort.person_days(self.cdm, self.codesets, self.specs, self.work)

    @cached_property
    def masked(self) -> DataFrame:
        """Qualified events of all cohorts with their inclusion masks."""
        def build() -> DataFrame:
            return cohort.masked_events(self.cdm, self.days, self.periods, self.specs, self.work)

        masked = self.work.stage("masked", build, placed=any(s.rules for s in self.specs))
        self.work.drop("qualified")  # the same events without their masks
        return masked

    @cached_property
    def cohorts(self) -> DataFrame:
        """Cohort rows of every definition, bucketed by person."""
        def build() -> DataFrame:
            if "cohorts" in self.stored:
                return cohort.as_stored(self.stored["cohorts"])
            included = cohort.included_events(self.masked, self.specs)
            spans = cohort.cohort_intervals(self.cdm, included, self.days, self.specs)
            return cohort.as_cohort_rows(cohort.eras.collapse(spans, cohort.KEY, F.col("pad")))

        return self.work.stage("cohorts", build, "subject_id")

    def _named(self, ids) -> DataFrame:
        return self.cohorts.where(F.col("cohort_definition_id").isin(list(ids)))

    def _large_enough(self, ids) -> DataFrame:
        """Cohorts with more than five rows; the list is bounded by the definitions."""
        rows = self._named(ids)
        keep = F.broadcast(cohort.enough_rows(rows, self.min_rows).select("cohort_definition_id"))
        return rows.join(keep, "cohort_definition_id", "left_semi")

    @cached_property
    def exposures(self) -> DataFrame:
        return self._named(d.EXPOSURES)

    @cached_property
    def covid(self) -> DataFrame:
        return self._named(d.COVID)

    @cached_property
    def outcome_rows(self) -> DataFrame:
        return self._large_enough(d.OUTCOMES)

    # ---- populations ---------------------------------------------------------------

    @cached_property
    def exposed(self) -> DataFrame:
        return self.exposures.select(F.col("subject_id").alias("person_id")).distinct()

    @cached_property
    def condition_firsts(self) -> DataFrame:
        def build() -> DataFrame:
            if "comorbidities" in self.stored:
                return covariates.firsts_from_cohorts(self.stored["comorbidities"], self.condition_tops)
            return covariates.condition_firsts(self.cdm, self.condition_tops)

        return self.work.stage("condition_firsts", build)

    @cached_property
    def medication_days(self) -> DataFrame:
        def build() -> DataFrame:
            if "medications" in self.stored:
                return covariates.days_from_cohorts(self.stored["medications"], self.drug_tops)
            return covariates.medication_days(self.cdm, self.calendar.drug_eras_from, self.drug_tops)

        return self.work.stage("medication_days", build)

    @cached_property
    def comorbidities(self) -> DataFrame:
        return covariates.comorbidity_cohorts(self.condition_firsts, self.exposed, self.condition_tops)

    @cached_property
    def medications(self) -> DataFrame:
        return covariates.medication_cohorts(self.medication_days, self.exposed, self.drug_tops)

    @cached_property
    def population_plain(self) -> DataFrame:
        pop = population.study_population(
            self.cdm,
            self._large_enough(d.EXPOSURES),
            self.periods,
            self.studies,
            self.work,
            self.born_after,
            self.op_containing_index,
        )
        return population.with_months_since_start(pop, self.exposures)

    @cached_property
    def population(self) -> DataFrame:
        def build() -> DataFrame:
            # their shuffles are over before the tables of the cohorts take room
            firsts, medications = self.condition_firsts, self.medication_days
            pop = covariates.condition_flags(self.population_plain, firsts, self.condition_tops)
            pop = covariates.recent_flags(
                pop, medications, self.covid, self.calendar.covid_from_year, self.drug_tops
            )
            return covariates.composite_flags(pop)

        return self.work.stage("population", build)

    # ---- follow-up and results -----------------------------------------------------

    @cached_property
    def facts(self) -> DataFrame:
        return self.work.stage("facts", lambda: followup.outcome_facts(self.population, self.outcome_rows))

    @cached_property
    def pairs(self) -> DataFrame:
        return self.work.stage("pairs", lambda: followup.open_pairs(self.facts, self.min_pair), None)

    @cached_property
    def time_at_risk(self) -> DataFrame:
        return followup.time_at_risk(self.population, self.facts, self.pairs, self.earliest)

    @cached_property
    def curve_counts(self) -> DataFrame:
        def build() -> DataFrame:
            return survival.stratified_counts(self.population, self.facts, self.pairs, self.earliest)

        return self.work.stage("curve_counts", build, None)

    @cached_property
    def survival(self) -> DataFrame:
        return survival.kaplan_meier(survival.reportable(self.curve_counts), survival.CURVE)

    @cached_property
    def cubes(self) -> DataFrame:
        return self.work.stage("cubes", lambda: models.exposure_cubes(self.population, self.pairs), None)

    @cached_property
    def changes(self) -> DataFrame:
        return self.work.stage("changes", lambda: models.outcome_changes(self.population, self.facts, self.pairs), None)

    @cached_property
    def patterns(self) -> DataFrame:
        def build() -> DataFrame:
            return models.covariate_patterns(self.cubes, self.changes, self.min_events, self.min_exposed)

        return self.work.stage("patterns", build, None)

    @cached_property
    def odds_ratios(self) -> DataFrame:
        return models.odds_ratios(self.cubes, self.changes, self.patterns, self.interaction_test)

    @cached_property
    def characteristics(self) -> DataFrame:
        rows = summaries.patient_characteristics(self.population, self.facts, self.pairs)
        return summaries.with_text(rows)

    @cached_property
    def histograms(self) -> DataFrame:
        return summaries.age_histograms(self.population, self.facts, self.pairs)

    def labelled(self, df: DataFrame) -> DataFrame:
        """Add the names of the study cohort and outcome, and the fixed label columns."""
        outcomes = literal_table(
            self.spark, list(d.OUTCOMES.items()), "outcome_id int, outcome_name string"
        )
        named = df.join(F.broadcast(population.study_table(self.spark)), "study_id")
        named = named.join(F.broadcast(outcomes), "outcome_id", "left")
        kind = F.col("slice") if "slice" in df.columns else F.lit("All")
        named = named.withColumns({"pop": F.col("study_cohort"), "pop_type": kind}).drop("study_cohort", "slice")
        if "prior_obs_required" not in df.columns:
            named = named.withColumn("prior_obs_required", F.lit("Yes"))
        return named

    def results(self) -> dict[str, DataFrame]:
        """The four result tables, characteristics both long and with a column per outcome."""
        wide = summaries.wide_characteristics(self.characteristics)
        return {
            "patient_characteristics": self.labelled(self.characteristics).withColumn("age_group", F.lit("All")),
            "patient_characteristics_wide": wide.join(
                F.broadcast(population.study_table(self.spark)), "study_id"
            ).withColumns({"pop": F.col("study_cohort"), "pop_type": F.lit("All"), "prior_obs_required": F.lit("Yes")}),
            "survival_summary": self.labelled(self.survival).withColumn("surv_type", F.lit("KM")),
            "model_estimates": self.labelled(self.odds_ratios),
            "cohort_age_plot_data": self.labelled(self.histograms),
        }

    def run(self, path: str, database: str) -> None:
        """Build everything and write cohorts, inclusion statistics and results under ``path``.

        Every cohort of the run is replaced in the tables under ``path``, one without rows by nothing.
        """
        root = path.rstrip("/")
        results = self.results()
        if "cohorts" not in self.stored:
            tables.write_cohorts(self.listed_cohorts, f"{root}/cohorts", self.listed.values())
            counts = self.work.stage("mask_counts", lambda: attrition.mask_counts(self.masked), None)
            results["cohort_inclusion"] = attrition.rule_statistics(counts, self.specs)
            results["cohort_summary"] = attrition.summary_statistics(counts, self.specs)
        if "comorbidities" not in self.stored:
            ids = self.condition_tops.values()
            tables.write_cohorts(self.comorbidities, f"{root}/comorbidity_cohorts", ids)
        if "medications" not in self.stored:
            tables.write_cohorts(self.medications, f"{root}/medication_cohorts", self.drug_tops.values())
        tables.write_results(results, path, database)
