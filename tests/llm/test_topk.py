from __future__ import annotations

import math

import numpy as np
from helpers import by_id  # noqa: F401
from pyspark.sql import functions as F

from cohortide.llm.topk import choose_pivots, cover_tree, dual_search, top_k


def brute(rows, every, k):
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ints = [math.floor(64 * x) for x in v]
            sound[i] = min(sound.get(i, ints), ints)
    out = []
    for q, a in sound.items():
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in sound.items() if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def rows_of(seed=3, n=900, dim=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dim))
    v = middle[rng.integers(0, 12, n)] + 0.2 * rng.normal(size=(n, dim))
    v[100:400] = v[100]  # a very common vector: ties
    return [(i, [float(x) for x in v[i]]) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, rank int"


def run(spark, rows, every=20, k=20, **blocks):
    t = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = top_k(t, t.filter(F.col("vec_id") % every == 0), k, **blocks)
    return sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()))


def test_matches_brute_force_over_blocks(spark):
    rows = rows_of()
    want = brute(rows, 20, 20)
    assert run(spark, rows) == want
    assert run(spark, rows, data_block=200, query_block=10) == want
    assert run(spark, rows, data_block=20, query_block=10, pivots=30) == want  # many cells, a hot one in parts


def test_null_vectors_lengths_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [nan, 1.0]), (80, [inf, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])]
    rows += [(3, [1.0, 2.0, 3.0]), (100, [0.5, 0.5, 0.5]), (0, [1.0, 2.0]), (120, []), (4, [-1.0, 0.01]), (140, [0.0, 0.0])]
    assert run(spark, rows) == brute(rows, 20, 20)
    assert run(spark, []) == []
    assert run(spark, [(20, [1.0])]) == []


def test_tree_covers_its_points():
    points = np.array([v for _, v in rows_of()])
    todo, leaves = [cover_tree(points)], []
    while todo:
        node = todo.pop()
        assert np.linalg.norm(points[node.rows] - node.center, axis=1).max() <= node.radius + 1e-9
        todo += node.children
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        else:
            leaves.append(node.rows)
    assert sorted(np.concatenate(leaves)) == list(range(len(points)))


def test_products_past_53_bits_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-(2**22), 2**22, 4)]) for i in range(120)]
    want = brute(rows, 20, 20)
    assert any(abs(s) > 2**53 for *_, s in want)
    assert run(spark, rows) == want
    assert run(spark, rows, data_block=30) == want


def test_cells_and_scores_from_elsewhere_spare_comparisons():
    rng = np.random.default_rng(2)
    middle = 100 * rng.normal(size=(16, 8))
    data = np.floor(middle[rng.integers(0, 16, 8000)] + rng.normal(size=(8000, 8)))
    cells = choose_pivots([(8, row) for row in data[:32].tolist()])
    number, away = cells.nearest(data)
    cells.radius = {(8, int(c)): float(away[number == c].max()) for c in np.unique(number)}
    asked = data[:200]
    exact = asked @ data.T
    kth = np.sort(exact, 1)[:, -20]
    known, bound = cells.bounds(asked)
    for c, b in zip(known, bound.T, strict=True):
        assert (exact[:, number == c].max(1) <= b).all()  # no bound is exceeded
    reached = bound >= kth[:, None]
    compared = sum(reached[:, j].sum() * (number == c).sum() for j, c in enumerate(known))
    assert compared < 0.3 * exact.size
    ids = np.arange(len(data))
    score, ident = dual_search(asked, np.full(200, -1), data, ids, 20, floor=kth)
    assert np.array_equal(score, -np.sort(-exact, 1)[:, :20]) and (ident < len(data)).all()
