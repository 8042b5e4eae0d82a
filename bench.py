"""Time the headline queries, cold, on the tables in $BENCH_SF_DIR.

Each stage is timed from the tables the stage before it kept, so the sum is one full
study.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks import registry  # noqa: E402
from cohortide.operators import cohort  # noqa: E402
from cohortide.plans import definitions as d  # noqa: E402


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cohortide-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.prepare(spark)
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = session()
    study = registry.new_study(spark, sf_dir)
    by_id = {s.id: s for s in registry.SPECS}

    def one_cohort(id: int):
        return cohort.build_cohorts(study.cdm, study.codesets, [by_id[id]], study.work, study.periods)

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    steps = {
        "concept_sets": lambda: study.codesets,
        "observation_periods": lambda: study.periods,
        "drug_eras": lambda: run(study.cdm.drug_era),
        "cohort_cvst": lambda: run(one_cohort(302)),
        "cohort_dose1_pfizer": lambda: run(one_cohort(102)),
        "cohort_tts_vte": lambda: run(one_cohort(408)),
        "all_events_by_day": lambda: study.days,
        "all_inclusion_rules": lambda: study.masked,
        "all_34_cohorts": lambda: study.cohorts,
        "study_populations": lambda: study.population,
        "outcome_facts": lambda: (study.facts, study.pairs),
        "time_at_risk": lambda: run(study.time_at_risk),
        "survival": lambda: run(study.survival),
        "characteristics": lambda: run(study.characteristics),
        "age_histogram": lambda: run(study.histograms),
        "model_patterns": lambda: study.patterns,
        "odds_ratios": lambda: run(study.odds_ratios),
    }
    times: dict[str, float] = {}
    for name, step in steps.items():
        start = time.perf_counter()
        step()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    assert len(study.specs) == len(d.EXPOSURES) + len(d.OUTCOMES) + len(d.COVID) + len(registry.TEMPLATES)
    print(
        json.dumps(
            {
                "metric": "full study, all cohorts, populations, curves and models",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
