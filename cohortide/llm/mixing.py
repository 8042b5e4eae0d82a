"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortide.llm.scratch import keep, partitions
from cohortide.llm.words import TOKEN


def running_total(rows: DataFrame, order: list[str], value: str, total: str, group: list[str]) -> DataFrame:
    """Add the running sum of ``value`` in global ``order``, within each ``group``.

    Rows are range-sorted into partitions of even size, whatever the groups; each partition adds up
    its own rows and starts from the sums of the partitions before it.
    """
    n = partitions(rows.sparkSession)
    part = rows.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id())
    part = keep(part, "ranges")
    sums = part.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("_part").alias("_p"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
    )
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = part.withColumn("_own", F.sum(value).over(within)).join(sums, same)
    drop = ["_part", "_p", "_own", "_before", *[f"_g{i}" for i in range(len(group))]]
    return rows.withColumn(total, F.col("_before") + F.col("_own")).drop(*drop)


def source_targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Add ``weight`` and ``target`` to (source, source_size).

    Sources in code point order, null last, take the weights in turn.  They share ``share`` of all
    sizes by weight; a target stops at ``most`` times its source's size, and what it leaves is shared
    again by weight until none is above.  Each round is one aggregate over the sources.
    """
    ranked = running_total(
        sources.withColumn("_null", F.col("source").isNull()).withColumn("_one", F.lit(1)),
        ["_null", "source"],
        "_one",
        "_rank",
        [],
    )
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.get(turn, ((F.col("_rank") - 1) % len(weights)).cast("int"))
    ranked = keep(ranked.withColumn("weight", weight).drop("_null", "_one", "_rank"), "sources")
    cap = F.col("source_size") * float(most)
    budget = float(share) * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        capped = cap <= F.col("weight") * level
        row = ranked.agg(
            F.sum(F.when(capped, cap).otherwise(0.0)).alias("taken"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(capped, 1)).alias("full"),
        ).first()
        if not row["weight"] or row["full"] == full:
            break
        full, level = row["full"], (budget - row["taken"]) / row["weight"]
    return ranked.withColumn("target", F.least(cap, F.col("weight") * level))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 17,
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target, copies and taken.

    Documents are shuffled by a hash of their id.  A copy's virtual finish time is the running total of its
    source's words, passes before it included, over the source's target; all copies, up to ``most`` of
    each document, are range-sorted by it, and the order is cut where the words reach the sum
    of all targets.  So every source ends near its target, and reruns agree.

    Null texts, empty ones and those of white space have size 0: they are listed and never taken, as
    is a source with no words, whose target is 0.  Rows without source are a source of their own.  Rows
    that share an id, and equal rows, are documents of their own.  An empty table gives no rows.
    """
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", F.lit(seed)).alias("_h"))
    rows = keep(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = keep(source_targets(sources, list(weights), share, most), "targets")
    rows = running_total(rows, ["_h", "doc_id", "size"], "size", "_sum", ["source"])
    known = targets.select(F.col("source").alias("_source"), "source_size", "target")
    rows = keep(rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "queue")

    def finish(copy: Column | int) -> Column:
        words = F.col("_sum") + F.col("source_size") * copy
        return F.when(F.col("target") > 0, words / F.col("target")).otherwise(F.lit(0.0))

    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    copies = rows.select("_h", "doc_id", "source", "size", "_sum", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("_copy"))
    copies = copies.filter("size > 0").withColumn("_finish", finish(F.col("_copy")))
    key = ["_finish", "_h", "doc_id", "source", "size", "_copy"]
    order = running_total(copies.select(*key), key, "size", "_words", [])
    last = order.filter(F.col("_words") <= budget).agg(F.max(F.struct(*key)).alias("last")).first()["last"]
    taken = F.lit(0)
    if last is not None:
        edge = F.struct(*[F.lit(last[k]).cast(order.schema[k].dataType).alias(k) for k in key])
        for copy in range(most):
            own = F.struct(finish(copy).alias("_finish"), *key[1:-1], F.lit(copy).alias("_copy"))
            taken = taken + F.when((F.col("size") > 0) & (own <= edge), 1).otherwise(0)
    return rows.withColumn("copies", taken.cast("int")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )
