"""Attrition: how many events or people meet which inclusion rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cohortide.operators.cohort import KEY
from cohortide.plans.specs import CohortSpec
from cohortide.sources.literals import literal_table


def best_events(masked: DataFrame) -> DataFrame:
    """One event per person: most rules met, then the lowest rule met, then the earliest."""
    lowest = F.expr("CASE WHEN mask = 0 THEN 0 ELSE CAST(log2(mask & -mask) AS INT) END")
    order = W.partitionBy(*KEY).orderBy(
        F.desc("rule_count"), "min_rule", "start_date", "min_end", "op_start", "op_end"
    )
    return (
        masked.withColumns({"rule_count": F.bit_count("mask"), "min_rule": lowest})
        .withColumn("__rank", F.row_number().over(order))
        .where("__rank = 1")
        .drop("__rank")
        .withColumn("n", F.lit(1).cast("long"))
    )


def mask_counts(masked: DataFrame) -> DataFrame:
    """(cohort, mask, person_count, mode): mode 0 counts events, mode 1 best events."""

    def count(rows: DataFrame, mode: int) -> DataFrame:
        return (
            rows.groupBy(F.col("cohort_id").alias("cohort_definition_id"), F.col("mask").alias("inclusion_rule_mask"))
            .agg(F.sum("n").alias("person_count"))
            .withColumn("mode_id", F.lit(mode))
        )

    return count(masked, 0).unionByName(count(best_events(masked), 1))


def _rule_table(spark, specs: list[CohortSpec]) -> DataFrame:
    rows = [(s.id, r, rule.name, len(s.rules)) for s in specs for r, rule in enumerate(s.rules)]
    return literal_table(
            spark, rows, "cohort_definition_id long, rule_sequence int, name string, total_rules int"
    )


def rule_statistics(counts: DataFrame, specs: list[CohortSpec]) -> DataFrame:
    """Per rule and mode: its name, events meeting it, events lost to it alone, and the total.

    A cohort without events has a row of zeros for each rule.  ``counts`` holds at most 2^rules rows
    per cohort, so everything here is small.
    """
    spark = counts.sparkSession
    rules = _rule_table(spark, specs)
    modes = rules.crossJoin(literal_table(spark, [(0,), (1,)], "mode_id int"))
    rows = modes.join(counts, ["cohort_definition_id", "mode_id"], "left")
    rows = rows.na.fill(0, ["inclusion_rule_mask", "person_count"])
    bit = F.expr("shiftleft(1L, rule_sequence)")
    all_but = F.expr("shiftleft(1L, total_rules) - 1 - shiftleft(1L, rule_sequence)")
    return rows.groupBy("cohort_definition_id", "rule_sequence", "name", "mode_id").agg(
        F.sum(F.when(F.col("inclusion_rule_mask").bitwiseAND(bit) != 0, F.col("person_count")).otherwise(0)).alias(
            "person_count"
        ),
        F.sum(F.when(F.col("inclusion_rule_mask") == all_but, F.col("person_count")).otherwise(0)).alias(
            "gain_count"
        ),
        F.sum("person_count").alias("person_total"),
    )


def summary_statistics(counts: DataFrame, specs: list[CohortSpec]) -> DataFrame:
    """Per cohort and mode: events before and after the inclusion rules."""
    spark = counts.sparkSession
    full = literal_table(
            spark, [(s.id, (1 << len(s.rules)) - 1) for s in specs], "cohort_definition_id long, full_mask long"
    )
    met = F.when(F.col("inclusion_rule_mask") == F.col("full_mask"), F.col("person_count")).otherwise(0)
    return (
        counts.join(F.broadcast(full), "cohort_definition_id")
        .groupBy("cohort_definition_id", "mode_id")
        .agg(F.sum("person_count").alias("base_count"), F.sum(met).alias("final_count"))
    )
