from __future__ import annotations

import random

from helpers import ascii_lower, docs, prose
from pyspark.sql import functions as F

from cohortide.llm.components import connected_components
from cohortide.llm.ngram_join import first_ones, list_sizes, ngram_join, one_of_each, pairs_apart, shared_lists
from cohortide.llm.scratch import keep


def shingles(text, size=3):
    w = [x for x in ascii_lower(text).translate({c: 32 for c in range(9, 14)}).split(" ") if x]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(rows):
    """component_id of each (doc_id, text), ids distinct."""
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 90 * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def near(base, changes, seed):
    rng, w = random.Random(seed), list(base)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def table():
    rows, k = [], 0
    for g in range(6):
        base = prose(g, 120 + 30 * g)
        for c in range(25):
            rows.append((k, near(base, c % 5, 100 * g + c)))
            k += 1
    passage = prose(99, 50)
    rows += [(k + i, " ".join(passage + prose(200 + i, 3 + i % 40))) for i in range(60)]
    k += 60
    rows += [(k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "one"), (k + 4, "One"), (k + 5, "one two"), (k + 6, "one\ttwo"), (k + 7, "two one"), (k + 8, "a b c"), (k + 9, "A b\x0bc")]
    rows.append((k + 10, " ".join(prose(7, 20000))))
    rows.append((k + 11, near(prose(7, 20000), 100, 5)))
    return rows


def got(spark, rows, **kw):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join(docs(spark, rows), **kw).collect()}


def test_matches_brute_force(spark):
    rows = table()
    want = brute(rows)
    assert got(spark, rows) == want
    # every list's shingles common, few centers: the rest is compared pair by pair
    assert got(spark, rows, common=0, centers=1) == want
    # lists become long ones and the short lists are chosen again
    assert got(spark, rows, common=50, long_list=20, centers=2) == want


def test_chain_of_links(spark):
    w = prose(5, 200)
    rows = []
    for i in range(40):
        rows.append((i, " ".join(w)))
        w = list(w)
        w[5 * i] = f"y{i}"
    want = brute(rows)
    assert {c for _, c in want.values()} == {0}
    assert got(spark, rows, centers=1) == want


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    base = prose(1, 100)
    rows = [(None, " ".join(base)), (5, near(base, 1, 1)), (7, " ".join(base)), (7, " ".join(base)), (None, "alone here now"), (9, "x y z")]
    t = docs(spark, rows).withColumn("node", F.lit(1)).withColumn("key", F.lit("k"))
    out = ngram_join(t)
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in out.collect()) == [(-1, -1), (-1, 5), (5, 5), (7, 5), (7, 5), (9, 9)]
    left = one_of_each(t, ngram_join(t)).collect()
    assert sorted(r["doc_id"] or -1 for r in left) == [-1, 5, 9]
    twice = docs(spark, [(1, "a b c d"), (1, "a b c d"), (2, "e f g h")])
    assert sorted(r["doc_id"] for r in one_of_each(twice, ngram_join(twice)).collect()) == [1, 2]
    empty = docs(spark, [])
    assert ngram_join(empty).count() == 0
    assert one_of_each(empty, ngram_join(empty)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_lists_without_a_possible_pair_are_dropped(spark):
    rows = [(1, 100, True), (1, 95, True), (2, 100, True), (2, 80, True), (3, 100, False), (3, 98, False), (4, 100, True), (4, 98, False)]
    rows += [(5, 100, True), (6, 100, False), (6, 99, True), (6, 10, False), (7, 9, False), (7, 10, False), (7, 9, False)]
    lists = spark.createDataFrame(rows, "token long, n long, first boolean")
    assert sorted(tuple(r) for r in list_sizes(lists, 90).collect()) == [(1, 2), (4, 2), (6, 3)]
    # no pair whose sizes fit is dropped
    for percent in (50, 80, 90, 99, 100):
        pairs = [(n, m) for n in (1, 2, 9, 10, 81, 90, 99, 100, 450, 729, 810, 900, 990, 1000, 10**6) for m in range(n * percent // 100, n + 1) if n < 1001 and 100 * m >= percent * n]
        sets = [(i, x, x == m) for i, (n, m) in enumerate(pairs) for x in (n, m)]
        assert list_sizes(spark.createDataFrame(sets, "token long, n long, first boolean"), percent).count() == len(pairs)
    sizes = spark.range(1, 3000).select("id", first_ones(F.col("id"), 90).alias("a"), first_ones(F.col("id"), 80).alias("b"), first_ones(F.col("id"), 100).alias("c"))
    for r in sizes.collect():
        n = r["id"]
        for got, percent in ((r["a"], 90), (r["b"], 80), (r["c"], 100)):
            # a partner of n shingles or more shares at least so many of them
            assert got == n + 1 - next(t for t in range(n * percent // 100, n + 1) if t * (100 + percent) >= 2 * percent * n)


def test_lists_that_are_not_shared_are_dropped_before_the_join(spark):
    classes = spark.createDataFrame([(k, [k * 1_000_003 + i for i in range(40)] + [-7, k % 50]) for k in range(500)], "node long, short array<long>")
    shared = spark.createDataFrame([(-7,), *[(k,) for k in range(50)]], "token long")
    got = [(r["node"], r["token"]) for r in shared_lists(classes, shared).collect()]
    want = {(k, -7) for k in range(500)} | {(k, k % 50) for k in range(500)}
    assert want <= set(got) and len(got) < len(want) + 200
    assert shared_lists(classes.limit(0), shared).count() == 0


def test_lists_are_shuffled_once_to_be_paired(spark):
    rows = [(token, node, 10, node, [0] * 8) for token in range(40) for node in range(token, token + 4)]
    full = keep(spark.createDataFrame(rows, "token long, node long, n long, label long, bits array<long>"), "full")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = pairs_apart(full, 90)
        got = {(r["u"], r["v"]) for r in pairs.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(a, b) for a in range(43) for b in range(a + 1, min(a + 4, 43))}
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1, plan
