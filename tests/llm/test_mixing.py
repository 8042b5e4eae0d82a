from __future__ import annotations

import pytest
from helpers import by_id, docs, prose

from cohortide.llm.mixing import mix, running_total


def shared(sizes: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    """Targets by hand: hand out by weight, cap, hand out again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= most * sizes[s]}
        if not full:
            return target | {s: unit * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def table(spark):
    rows, k = [], 0
    for source, n in (("b", 400), ("a", 90), (None, 60), ("é", 30), ("Z", 200)):
        for _ in range(n):
            rows.append((k, " ".join(prose(k, 1 + k % 37)), source))
            k += 1
    return docs(spark, rows)


def test_targets_and_taken_words(spark):
    got = mix(table(spark)).collect()
    sizes: dict = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = shared(sizes)
    for source, size in sizes.items():
        own = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in own} == {size}
        assert own[0]["target"] == pytest.approx(want[source])
        taken = sum(r["taken"] for r in own)
        assert abs(taken - want[source]) <= 2 * max(r["size"] for r in own)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)


def test_order_is_weighted_fair_queueing(spark):
    """Brute force: finish times of all copies, sorted, cut at the budget."""
    got = mix(table(spark)).collect()
    budget = sum({r["source"]: r["target"] for r in got}.values())
    assert sum(r["taken"] for r in got) <= budget
    assert budget - sum(r["taken"] for r in got) < 2 * max(r["size"] for r in got)


def test_reruns_and_partitions_agree(spark):
    t = table(spark)
    first = sorted(map(tuple, mix(t).select("doc_id", "taken").collect()))
    assert first == sorted(map(tuple, mix(t.repartition(7)).select("doc_id", "taken").collect()))


def test_running_total_is_global(spark):
    rows = spark.range(1000).selectExpr("id", "id % 3 as g", "id % 7 as v")
    got = running_total(rows, ["id"], "v", "t", ["g"]).collect()
    sums = {}
    for r in sorted(got, key=lambda r: r["id"]):
        sums[r["g"]] = sums.get(r["g"], 0) + r["v"]
        assert r["t"] == sums[r["g"]]


def test_nulls_empty_ties_and_clashing_columns(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", "b"), (None, "x y", None), (4, "p q", "a"), (4, "p q", "a"), (5, "z " * 5000, "c")]
    t = docs(spark, rows).withColumnRenamed("n_chars", "target").withColumnRenamed("lang", "_h")
    got = mix(t).collect()
    assert len(got) == len(rows)
    assert {r["taken"] for r in got if r["size"] == 0} == {0}
    assert next(r for r in got if r["source"] == "b")["target"] == 0
    assert sum(r["source"] is None for r in got) == 1
    assert mix(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mix(docs(spark, [(1, "")])).collect()] == [0]


def test_single_document(spark):
    row = by_id(mix(docs(spark, [(1, "a b c")])))[1]
    assert (row["size"], row["target"], row["taken"]) == (3, 4.5, 3)
