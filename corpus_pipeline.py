"""A training corpus from raw documents: quality, near duplicates, repeated passages, benchmark leaks, mixing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written and read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortide.llm import decontaminate, mixing, ngram_join, quality, substring_dedup
from cohortide.llm.scratch import keep


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier, fitted on rated documents among ``docs``, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels.select("doc_id", quality.rated(labels).alias("grade")))
    return quality.score_quality(docs, model).filter("accepted").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked ones: sets of five words that agree by 0.8."""
    return ngram_join.one_of_each(docs, ngram_join.ngram_join(docs, size=5, percent=80)).select(*docs.columns)


def _measured(docs: DataFrame, cut: Column) -> DataFrame:
    """``n_chars`` of texts that were cut."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages out of all texts but the first, on lines of any length."""
    cut = substring_dedup.dedup_passages(docs)
    return _measured(cut, F.col("n_removed") > 0).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words of benchmark passages out of the texts."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = decontaminate.mark_contaminated(docs, items)
    return _measured(decontaminate.remove_spans(marked), F.col("contaminated")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents with the copies to take, in words and per source."""
    return mixing.mix(docs).filter("copies > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
]

#: The first stage is a fitted model, which SQL can't express; tests hold the rest against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.split()[0])
    return docs
