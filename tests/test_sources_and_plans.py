from __future__ import annotations

import datetime as dt
import os
import re

import pytest
from table_rows import day, rows
from pyspark.sql import functions as F

from checks import registry
from cohortide import schemas
from cohortide.functions import dates
from cohortide.operators import cohort, concepts, covariates, events, followup, models
from cohortide.plans import manifest
from cohortide.plans.definitions import MAIN_OUTCOMES, MAIN_STUDY_COHORTS
from cohortide.plans.specs import CohortSpec, Criterion, criteria_of
from cohortide.sources import cdm as cdm_source, tables, workspace
from cohortide.sources.literals import literal_table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


def shuffles(df) -> list[str]:
    return re.findall(r"Exchange (?:hash|range)partitioning\([^)]*\)", plan(df))


@pytest.fixture(scope="module")
def study(spark):
    return registry.study_for(spark, SF)


# ---- sources ---------------------------------------------------------------------------


def test_literal_table_types(spark):
    df = literal_table(
        spark,
        [(1, "it's", 1.5, day("2020-02-29"), True, [1, 2]), (None, None, None, None, None, None)],
        "a long, b string, c double, d date, e boolean, f array<int>",
    )
    assert [tuple(r) for r in df.collect()] == [(1, "it's", 1.5, dt.date(2020, 2, 29), True, [1, 2]), (None,) * 6]
    assert literal_table(spark, [], schemas.COHORT).count() == 0


def test_cohort_table_replaces_one_cohort(spark, tmp_path):
    path = str(tmp_path / "cohorts")
    tables.empty_cohort_table(spark, path)
    assert tables.read_cohorts(spark, path).count() == 0

    def some(id, n):
        return literal_table(
            spark, [(id, p, day("2020-01-01"), day("2020-01-02")) for p in range(n)], schemas.COHORT
        )

    tables.write_cohorts(some(1, 3).unionByName(some(2, 2)), path)
    tables.write_cohorts(some(1, 5), path)
    got = tables.read_cohorts(spark, path)
    assert rows(got.groupBy("cohort_definition_id").count()) == [(1, 5), (2, 2)]
    assert dict(got.dtypes)["cohort_definition_id"] == "int"
    tables.write_cohorts(some(3, 1), path, ids=[1, 3, 9])  # 1 is rebuilt without rows
    got = tables.read_cohorts(spark, path)
    assert rows(got.groupBy("cohort_definition_id").count()) == [(2, 2), (3, 1)]
    tables.write_cohorts(some(1, 5), path, ids=[1, 3])
    got = tables.read_cohorts(spark, path)
    assert rows(got.groupBy("cohort_definition_id").count()) == [(1, 5), (2, 2)]
    copy = str(tmp_path / "copy")
    tables.delete_cohorts(spark, [1], path, copy)
    assert rows(tables.read_cohorts(spark, copy).groupBy("cohort_definition_id").count()) == [(2, 2)]


def _cohort(spark, id, n):
    return literal_table(spark, [(id, p, day("2020-01-01"), day("2020-01-02")) for p in range(n)], schemas.COHORT)


def _sizes(spark, path):
    return rows(tables.read_cohorts(spark, path).groupBy("cohort_definition_id").count())


def test_a_run_that_dies_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cohorts")
    tables.write_cohorts(_cohort(spark, 1, 3).unionByName(_cohort(spark, 2, 2)), path)
    reader = tables.read_cohorts(spark, path)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        m.setattr(tables, "_switch", die)  # after the data is written, before it counts
        tables.write_cohorts(_cohort(spark, 1, 9), path, ids=[2])
    assert _sizes(spark, path) == [(1, 3), (2, 2)]
    tables.write_cohorts(_cohort(spark, 1, 5), path, ids=[2])
    assert _sizes(spark, path) == [(1, 5)]
    assert reader.count() == 5  # who began before the switch still reads the old rows
    tables.write_cohorts(_cohort(spark, 1, 6), path)
    tables.write_cohorts(_cohort(spark, 1, 7), path)
    assert len([n for n in os.listdir(path) if n.startswith("version=")]) == 2


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    path = str(tmp_path / "cohorts")
    tables.write_cohorts(_cohort(spark, 1, 3), path)
    number, versions = tables._current(spark, path)
    tables.write_cohorts(_cohort(spark, 1, 4), path)
    with pytest.raises(RuntimeError, match="another run"):
        tables._switch(spark, path, number + 1, versions)
    assert _sizes(spark, path) == [(1, 4)]


def test_files_grow_with_rows_not_with_tasks(spark, tmp_path):
    many = spark.range(20_000).select((F.col("id") % 20).cast("int").alias("cohort_definition_id"), F.col("id").alias("subject_id"), F.lit(day("2020-01-01")).alias("cohort_start_date"), F.lit(day("2020-01-02")).alias("cohort_end_date"))
    tables.write_cohorts(many.repartition(64, "subject_id"), str(tmp_path / "t"))
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 20 * 2


def test_results_of_databases_stand_side_by_side(spark, tmp_path):
    one = spark.createDataFrame([(1, "x")], "n int, t string")
    for db, df in (("a/b", one), ("2020", one), ("a/b", one.union(one)), ("gone", one), ("gone", one.limit(0))):
        tables.write_results({"counts": df}, str(tmp_path), db)
    assert rows(tables.read_results(spark, str(tmp_path), "counts").select("n", "db")) == [(1, "2020"), (1, "a/b"), (1, "a/b")]


def test_manifest_names_the_cohorts_to_write(spark):
    specs = registry.SPECS[:3]
    listed = literal_table(spark, [(specs[0].id + 50, specs[0].name), (7, specs[2].name)], "cohort_definition_id long, name string")
    numbers = manifest.resolve(listed, specs)
    assert numbers == {specs[0].id: specs[0].id + 50, specs[2].id: 7}
    cohorts = _cohort(spark, specs[0].id, 2).unionByName(_cohort(spark, specs[1].id, 4)).unionByName(_cohort(spark, specs[2].id, 1))
    cohorts = cohorts.withColumn("cohort_definition_id", F.col("cohort_definition_id").cast("int"))
    assert rows(manifest.renumbered(cohorts, numbers).groupBy("cohort_definition_id").count()) == sorted([(specs[0].id + 50, 2), (7, 1)])
    for bad in ([(1, "unheard of")], [(1, specs[0].name), (1, specs[1].name)], [(1, specs[0].name), (2, specs[0].name)], [(None, specs[0].name)]):
        with pytest.raises(ValueError):
            manifest.resolve(literal_table(spark, bad, "cohort_definition_id long, name string"), specs)
    assert manifest.resolve(listed.limit(0), specs) == {}


def test_manifest_and_concept_set_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("atlasId,atlasName,cohortId,name\n5,x,105,dose\n")
    assert rows(tables.read_manifest(spark, str(tmp_path / "m.csv"))) == [(105, "dose")]
    (tmp_path / "c.csv").write_text("codeset,concept_id,include_descendants\na,7,true\n")
    assert rows(tables.read_concept_sets(spark, str(tmp_path / "c.csv"))) == [("a", 7, True)]


def test_read_parquet_and_catalog(spark, tmp_path, cdm_of):
    made = cdm_of(person=[(1, 8507, 1960, 1, 1)])
    for name in schemas.CLINICAL_TABLES:
        getattr(made, name).withColumn("ignored", F.lit(1)).write.parquet(f"{tmp_path}/{name}.parquet")
    opened = cdm_source.read_parquet(spark, str(tmp_path))
    assert rows(opened.person) == [(1, 8507, 1960, 1, 1)]
    spark.sql("CREATE DATABASE IF NOT EXISTS clinic")
    for name in schemas.CLINICAL_TABLES:
        spark.sql(f"CREATE TABLE IF NOT EXISTS clinic.{name} USING parquet LOCATION '{tmp_path}/{name}.parquet'")
    assert rows(cdm_source.read_catalog(spark, "clinic").person) == rows(opened.person)
    spark.sql("DROP DATABASE clinic CASCADE")
    made.person.drop("gender_concept_id").write.mode("overwrite").parquet(f"{tmp_path}/person.parquet")
    with pytest.raises(ValueError, match="gender_concept_id"):
        cdm_source.read_parquet(spark, str(tmp_path))


def test_study_writes_its_results(spark, tmp_path):
    """A short run from tables to result folders."""
    short = registry.new_study(spark, SF, studies=MAIN_STUDY_COHORTS, outcomes=MAIN_OUTCOMES)
    short.run(str(tmp_path), "test")
    for name in ("patient_characteristics", "survival_summary", "model_estimates", "cohort_age_plot_data"):
        df = spark.read.parquet(f"{tmp_path}/{name}")
        assert {"db", "pop", "pop_type", "prior_obs_required"} <= set(df.columns)
        assert df.count() > 0 or name == "model_estimates"  # no slice has 30 events at this size
    pops = {r["pop"] for r in spark.read.parquet(f"{tmp_path}/survival_summary").select("pop").distinct().collect()}
    assert pops <= set(MAIN_STUDY_COHORTS) and pops
    assert tables.read_cohorts(spark, f"{tmp_path}/cohorts").count() == short.cohorts.count()
    assert spark.read.parquet(f"{tmp_path}/cohort_inclusion").select("name").distinct().count() > 5
    assert "Overall" in spark.read.parquet(f"{tmp_path}/patient_characteristics_wide").columns
    stored = {
        "cohorts": tables.read_cohorts(spark, f"{tmp_path}/cohorts"),
        "comorbidities": tables.read_cohorts(spark, f"{tmp_path}/comorbidity_cohorts"),
        "medications": tables.read_cohorts(spark, f"{tmp_path}/medication_cohorts"),
    }
    before = spark.conf.get(workspace.COLOCATE, None)
    with registry.new_study(spark, SF, studies=MAIN_STUDY_COHORTS, outcomes=MAIN_OUTCOMES, stored=stored) as again:
        again.run(f"{tmp_path}/again", "test")
        for name in ("patient_characteristics", "survival_summary", "cohort_age_plot_data"):
            one, two = (spark.read.parquet(f"{p}/{name}") for p in (tmp_path, f"{tmp_path}/again"))
            assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
        root = again.work.root
    assert not os.path.exists(root)
    assert spark.conf.get(workspace.COLOCATE, None) == before
    short.work.close()
    assert not [t.name for t in spark.catalog.listTables() if short.work.tag in t.name]


def test_birth_date_that_does_not_exist(spark):
    got = spark.range(1).select(dates.birth_date(F.lit(2001), F.lit(2), F.lit(30))).first()[0]
    assert got is None


def test_derived_concept_sets(spark):
    sets = literal_table(
        spark,
        [("vaccine_any", 1), ("vaccine_any", 2), ("vaccine_AZ", 1), ("vaccine_mrna", 2), ("dvt", 5), ("pe", 5)],
        "codeset string, concept_id long",
    )
    got = rows(concepts.add_derived_sets(sets).exceptAll(sets))
    assert [g for g in got if g[0] in ("vaccine_not_AZ", "vaccine_vector", "vte")] == [
        ("vaccine_not_AZ", 2), ("vaccine_vector", 1), ("vte", 5)]


def test_spec_checks():
    with pytest.raises(ValueError):
        CohortSpec(1, "nothing")
    with pytest.raises(ValueError):
        Criterion("condition_occurrence", "x", "source")


# ---- plans -----------------------------------------------------------------------------


def test_broadcast_only_when_counted_small(spark):
    big = spark.range(100).withColumnRenamed("id", "k")
    hinted = big.join(workspace.broadcast_checked(big, 1000), "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = big.join(workspace.broadcast_checked(big, 10), "k")
        assert "BroadcastHashJoin" in plan(hinted) and "BroadcastHashJoin" not in plan(plain)
        assert plain.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_scan_per_clinical_table(spark, study):
    """However many criteria, each source file is read once and only the needed columns."""
    wanted = [c for c in criteria_of(registry.SPECS) if c.domain == "condition_occurrence"]
    assert len(wanted) > 5
    text = plan(events.extract_events(study.cdm, study.codesets, wanted))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*orders\.parquet", text)
    assert len(scans) == 1 and "o_totalprice" not in scans[0]
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_date_bound_reaches_the_reader(spark, tmp_path, cdm_of, codes_of):
    path = f"{tmp_path}/drug.parquet"
    made = cdm_of(drug_exposure=[(1, 1, 10, None, "2021-01-01")])
    made.drug_exposure.write.parquet(path)
    stored = type(made)(**{**made.__dict__, "drug_exposure": spark.read.parquet(path)})
    text = plan(events.extract_events(stored, codes_of(a=[10]), [Criterion("drug_exposure", "a", after=day("2020-12-01"))]))
    assert "GreaterThanOrEqual(drug_exposure_start_date,2020-12-01)" in text


def test_person_steps_do_not_shuffle_kept_tables(spark, study):
    """Tables bucketed by person: follow-up facts, case profiles and time at risk join in place."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pop, facts, pairs = study.population, study.facts, study.pairs
        assert shuffles(followup.people_with_outcome(pop, facts, pairs)) == []
        assert shuffles(followup.time_at_risk(pop, facts, pairs)) == []
        index = study.masked
        rules = cohort._window_rules(spark, study.specs, {c: i for i, c in enumerate(criteria_of(study.specs))})
        nearby = shuffles(cohort.count_nearby(index, rules, study.days))
        assert len(nearby) == 1 and "person_id" in nearby[0]
        for df in (study.survival, study.characteristics, study.time_at_risk, cohort.included_events(index, study.specs)):
            text = plan(df)
            assert "CartesianProduct" not in text and "NestedLoop" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_run_goes_on_where_it_stopped(spark, monkeypatch):
    def study(**options):
        return registry.new_study(spark, SF, resume=True, min_events=1, **options)

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as broken:
        broken.setattr(models, "covariate_patterns", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            with study() as first:
                people = rows(first.population)
                assert first.patterns.count() >= 0
    with monkeypatch.context() as finished:
        for module, name in ((cohort, "person_days"), (covariates, "recent_flags"), (followup, "outcome_facts"), (models, "exposure_cubes")):
            finished.setattr(module, name, lost)  # none of them is built again
        with study() as second, study(min_pair=6) as other:
            assert second.work.lasting == first.work.lasting != other.work.lasting
            assert rows(second.population) == people and len(people) > 0
            plan = second.population.groupBy("person_id").count()._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan  # still bucketed by person
            assert second.patterns.count() > 0 and second.facts.count() > 0
        assert not os.path.exists(second.work.lasting.removeprefix("file:"))


def test_unions_of_kept_tables_stay_in_their_buckets(spark):
    work = workspace.Workspace(spark)
    numbers = spark.range(100).selectExpr("id % 10 AS person_id", "id AS x")
    one, two = work.keep(numbers, "one"), work.keep(numbers, "two")
    both = one.select("person_id", "x", F.lit(1).alias("kind")).unionByName(two.groupBy("person_id", "x").agg(F.lit(2).alias("kind")))
    counted = workspace.place(both).groupBy("person_id", "x").agg(F.sum("kind").alias("n"))
    assert shuffles(counted) == []
    assert rows(counted) == sorted((i % 10, i, 3) for i in range(100))
    work.close()


def test_shuffle_files_go_with_the_table_they_were_for(spark):
    def left() -> int:
        return sum(f.startswith("shuffle_") for root in folders for _, _, names in os.walk(root) for f in names)

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [str(f) for f in disk.localDirsString()]
    work = workspace.Workspace(spark)
    setting = spark.conf.get(workspace.CLEAN_UP)
    before = left()
    for by in ("person_id", None):
        work.keep(spark.range(1000).selectExpr("id % 10 AS person_id", "id % 3 AS x").groupBy("person_id", "x").count(), "counts", by)
    assert left() <= before
    assert spark.conf.get(workspace.CLEAN_UP) == setting
    work.close()


def test_rules_are_decided_in_the_buckets(spark, study):
    """Streams of index days and events don't shuffle kept tables."""
    rules = cohort._window_rules(spark, study.specs, {c: i for i, c in enumerate(criteria_of(study.specs))})
    assert shuffles(cohort.rules_met(study.masked, rules, study.days)) == []
    kept = os.listdir(study.work.root.removeprefix("file:"))
    assert not [name for name in kept if name.startswith("qualified")]  # dropped once the masks are written


def test_larger_tables_get_more_buckets(spark, monkeypatch):
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        monkeypatch.setattr(registry, "_table_mb", lambda *_: 1000.0)
        registry.prepare(spark, SF)
        assert workspace.bucket_count(spark) == 1000 / registry.BUCKET_MB
    finally:
        monkeypatch.undo()
        registry.prepare(spark)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    assert workspace.bucket_count(spark) <= int(width)


def test_large_shuffles_come_one_after_another(spark):
    """Drug histories before the tables of the cohorts, and person days of one clinical table at a time."""
    with registry.new_study(spark, SF) as fresh:
        assert fresh.population.count() > 0
        names = [name.rsplit("_", 1)[0] for name in fresh.work.kept]
        assert names.index("medication_days") < names.index("days") < names.index("masked")
        assert names.count("days") == 4 and "qualified" not in names
        assert shuffles(fresh.days.groupBy("person_id").count()) == []
