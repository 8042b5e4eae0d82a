"""Concept sets: lists of codes, optionally with everything below them in the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortide import schemas
from cohortide.plans.definitions import derived_codesets
from cohortide.sources.literals import literal_table
from cohortide.sources.workspace import broadcast_checked


def literal_concepts(definitions: DataFrame, concept: DataFrame) -> DataFrame:
    """Listed codes that exist in the vocabulary: (codeset, concept_id), distinct."""
    listed = broadcast_checked(definitions.select("codeset", "concept_id"))
    return concept.select("concept_id").join(listed, "concept_id").select("codeset", "concept_id").distinct()


def descendant_concepts(definitions: DataFrame, concept: DataFrame, ancestor: DataFrame) -> DataFrame:
    """Valid codes below the listed ones, for the lines that ask for descendants."""
    tops = definitions.where("include_descendants").select(
        "codeset", F.col("concept_id").alias("ancestor_concept_id")
    )
    below = ancestor.join(broadcast_checked(tops), "ancestor_concept_id").select(
        "codeset", F.col("descendant_concept_id").alias("concept_id")
    )
    valid = concept.where(F.col("invalid_reason").isNull()).select("concept_id")
    return below.join(valid, "concept_id").select("codeset", "concept_id").distinct()


def resolve_concept_sets(definitions: DataFrame, concept: DataFrame, ancestor: DataFrame) -> DataFrame:
    """All concept sets as (codeset, concept_id): listed codes and their valid descendants."""
    listed = literal_concepts(definitions, concept)
    return listed.unionByName(descendant_concepts(definitions, concept, ancestor)).distinct()


def add_derived_sets(codesets: DataFrame) -> DataFrame:
    """Add the sets defined from others, such as "all vaccines but this brand".

    A code belongs to a derived set when one of the sets to add holds it and none of
    the sets to subtract does, so one aggregate over the codes decides all of them.
    """
    parts = [
        (name, member, sign)
        for name, plus, minus in derived_codesets()
        for members, sign in ((plus, 1), (minus, -1))
        for member in members
    ]
    spark = codesets.sparkSession
    rules = literal_table(spark, parts, "derived string, codeset string, sign int")
    derived = (
        codesets.join(F.broadcast(rules), "codeset")
        .groupBy("derived", "concept_id")
        .agg(F.min("sign").alias("sign"))
        .where("sign > 0")
        .select(F.col("derived").alias("codeset"), "concept_id")
    )
    return codesets.unionByName(derived)


def ancestor_members(
    spark: SparkSession, tops: dict[str, int], ancestor: DataFrame
) -> DataFrame:
    """(code, concept_id) for everything below each top code.

    Trusts the closure table: validity is not checked and the top code itself is
    included only through the closure's self row.
    """
    codes = literal_table(spark, [(c,) for c in tops.values()], "ancestor_concept_id long")
    return (
        ancestor.join(F.broadcast(codes), "ancestor_concept_id")
        .select(
            F.col("ancestor_concept_id").alias("code"),
            F.col("descendant_concept_id").alias("concept_id"),
        )
        .distinct()
    )


def concept_set_table(spark: SparkSession, sets: dict[str, tuple[list[int], bool]]) -> DataFrame:
    """Concept set definitions from Python lists: {name: (codes, include descendants)}."""
    rows = [(name, int(c), deep) for name, (codes, deep) in sets.items() for c in codes]
    return literal_table(spark, rows, schemas.CONCEPT_SET)
