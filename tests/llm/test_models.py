from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from helpers import LABELS, by_id, docs, prose, words
from pyspark.sql import functions as F

from cohortide.llm import quality as q
from cohortide.llm import toxicity as tx


def graded(spark, n=240):
    rows, labels = [], []
    for k in range(n):
        w = prose(k, 40)
        if k % 3 == 0:
            w = [x.upper() + "!!" for x in w]
        elif k % 3 == 1:
            w[k % 40] = "awful"
            w[(k + 7) % 40] = "vile"
        rows.append((k, " ".join(w)))
        if k % 5:
            labels.append((k, 0 if k % 3 == 0 else 1, 1 if k % 3 == 1 else 0))
    return docs(spark, rows), spark.createDataFrame(labels, LABELS)


def test_quality_held_out(spark):
    d, labels = graded(spark)
    model = q.fit_quality(d, labels.select("doc_id", q.rated(labels).alias("grade")))
    got = q.score_quality(d, model).collect()
    wrong = [r["doc_id"] for r in got if r["doc_id"] % 5 == 0 and r["accepted"] != (r["doc_id"] % 3 > 0)]
    assert not wrong
    grade = {g: np.mean([r["expected_grade"] for r in got if (r["doc_id"] + 2) % 3 == (g + 1) % 3]) for g in range(3)}
    assert len(grade) == 3


def test_ordinal_fit_recovers_a_known_model():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    true, cuts = np.array([1.5, -1.0]), np.array([-0.7, 1.0])
    y = (x @ true + rng.logistic(size=4000))[:, None] > cuts
    rows = [(np.array([0, 1]), v) for v in x]
    model = q.fit_ordinal(rows, y.sum(1), np.ones(4000), 3, ridge=0.0, steps=600)
    assert model.weights[:2] == pytest.approx(true, abs=0.15)
    assert model.thresholds == pytest.approx(cuts, abs=0.15)


def test_quality_edge_cases(spark):
    d, labels = graded(spark, 60)
    model = q.fit_quality(d, labels.select("doc_id", q.rated(labels).alias("grade")))
    odd = docs(spark, [(None, None), (1, ""), (1, ""), (2, "word " * 30000)]).withColumn("tail", F.lit("x"))
    assert all(0 <= r["tail"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in q.score_quality(odd, model).collect())
    assert q.score_quality(docs(spark, []), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert q.score_quality(d, q.fit_quality(d, none)).filter("not accepted").count() == 0
    one = spark.createDataFrame([(1, 0), (2, 0), (None, 1), (3, None), (4, 9)], "doc_id long, grade int")
    assert q.score_quality(d, q.fit_quality(d, one)).filter("accepted").count() == 0


def test_toxicity_held_out(spark):
    d, labels = graded(spark)
    got = tx.score_toxicity(d, tx.fit_toxicity(d, labels)).collect()
    held = [r for r in got if r["doc_id"] % 5 == 0]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 1) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def weights_by_hand(texts, labels, doc_rows):
    """Unit vectors over all terms of the labelled texts, by dictionaries."""
    counted = [Counter(w[:5] for w in words(x)) for x in texts]
    known = sorted({t for c in counted for t in c})
    every = [{w[:5] for w in words(x)} for x in doc_rows]
    n1 = sum(labels)
    n0 = len(labels) - n1
    weight = {}
    for t in known:
        idf = math.log((len(every) + 1) / (sum(t in e for e in every) + 1)) + 1e-3
        c = [sum(t in x for x, y in zip(counted, labels, strict=True) if y == k) + 0.5 for k in (0, 1)]
        m = [n0 + 1 - c[0], n1 + 1 - c[1]]
        z2 = (math.log(c[1] / m[1]) - math.log(c[0] / m[0])) ** 2 / sum(1 / x for x in c + m)
        weight[t] = idf * (tx.LEAST + (1 - tx.LEAST) * z2 / (z2 + tx.ERRORS**2))

    def unit(x):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in Counter(w[:5] for w in words(x)).items() if t in weight}
        norm = math.sqrt(sum(a * a for a in v.values()))
        return {t: a / norm for t, a in v.items()} if norm else {}

    return unit, [unit(x) for x in texts]


def nearest_by_hand(unit, vectors, ids, text, leave=None):
    v = unit(text)
    cos = [(-round(sum(a * e.get(t, 0.0) for t, a in v.items()), 9), i, n) for n, (i, e) in enumerate(zip(ids, vectors, strict=True)) if i != leave]
    return [(i, n, -c) for c, i, n in sorted(cos)[: tx.NEIGHBOURS] if c < 0]


def test_scores_are_votes_by_cosine_over_all_terms(spark, monkeypatch):
    monkeypatch.setattr(tx, "BLOCK", 4)
    monkeypatch.setattr(tx, "STEP", 8)
    d, labels = graded(spark, 200)
    marked = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    ids = sorted(marked)
    unit, vectors = weights_by_hand([texts[i] for i in ids], [marked[i] for i in ids], list(texts.values()))
    index = tx.fit_toxicity(d, labels)
    assert set(index.terms) == {w[:5] for i in ids for w in words(texts[i])}  # every term counts
    base = sum(marked.values()) / len(marked)  # all labelled rows are examples, so each stands for itself

    def vote(found):
        v = [c for _, _, c in found]
        return (sum(c * marked[i] for i, _, c in found) + tx.PRIOR * base) / (sum(v) + tx.PRIOR)

    left = [vote(nearest_by_hand(unit, vectors, ids, texts[i], leave=i)) for i in ids]
    a, b = tx._platt(np.array(left), np.array([marked[i] for i in ids], float), np.ones(len(ids)))
    assert index.scale == pytest.approx((a, b), abs=1e-4)
    for r in tx.score_toxicity(d, index).collect():
        found = nearest_by_hand(unit, vectors, ids, r["text"])
        assert r["cosines"] == pytest.approx([c for _, _, c in found], abs=1e-6)
        held = dict(zip(r["evidence"], r["cosines"], strict=True))
        assert all(i in held for i, _, c in found if c > found[-1][2] + 1e-6)
        v = vote([(i, None, c) for i, c in held.items()])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(a + b * math.log(v / (1 - v))))), abs=1e-4)


def test_block_max_search_is_exact_and_leaves_out():
    rng = np.random.default_rng(5)
    terms = {f"t{i}": i for i in range(900)}
    idf = rng.uniform(0.01, 1, 900) ** 3
    examples = []
    for i in range(700):
        at = np.unique((rng.zipf(1.3, 60) - 1) % 900)
        examples.append((1000 - i, int(rng.integers(2)), at, rng.integers(1, 9, len(at))))
    examples += [(i, 0, *examples[7][2:]) for i in range(2000, 2020)]  # ties
    examples.append((3000, 1, np.zeros(0, int), np.zeros(0, int)))
    index = tx.build_index(terms, idf, examples, {0: 500, 1: 300})
    assert 0 < len(index.full) < 900
    for n, (_, _, at, count) in enumerate(examples[:150] + examples[-3:]):
        leave = n if n % 2 else -1
        w = index.vector(at, count)
        cos = index.cosines(*w, np.arange(len(index.ids)))
        if leave >= 0:
            cos[leave] = 0
        want = [i for i in np.lexsort((index.ids, -cos)) if cos[i] > 0][:5]
        rows, got = index.nearest(*w, 5, leave)
        assert rows.tolist() == want
        assert got.tolist() == cos[want].tolist()


def test_a_search_compares_only_examples_that_share_a_term():
    examples = [(i, i % 2, [0, 1 + i % 3] if i % 100 else [0, 4], [1, 1]) for i in range(600)]
    index = tx.build_index({t: i for i, t in enumerate("abcdef")}, np.ones(6), examples, {0: 300, 1: 300})
    compared = []
    cosines = index.cosines
    index.cosines = lambda at, w, rows: compared.append(len(rows)) or cosines(at, w, rows)
    rows, cos = index.nearest(*index.vector(np.array([4]), np.array([1])), tx.NEIGHBOURS)
    assert index.ids[rows].tolist() == [0, 100, 200, 300, 400, 500] and cos == pytest.approx(math.sqrt(0.5))
    assert compared == [6]


def test_many_texts_are_cut_and_searched_like_single_ones(monkeypatch):
    odd = ["", None, "  ", "A", "aB\x00Cd9 _x", "\u00e9t\u00e9s \u00c9T\u00c9S ete\u0301", "\u00a0 no\u00a0break \u0085 \u2003x", "\U0001f600\U0001f600abcdef abcdefg abcde abcd"]
    odd += ["\ud800x y", "x" * 5000, "abcd\u00e9f abcd\u00e9 abcde\u00e9", "Zz" * 3 + "\t\n" + "zzzzz{zzzzzz}", "words, words; WORDS wordsmith"]
    texts = odd + [" ".join(prose(k, 30)) for k in range(40)] + odd
    counted = [Counter(tx.stems(t or "")) for t in texts]
    terms = {t: i for i, t in enumerate(sorted({t for c in counted[:-9] for t in c} - {"abcd", "y"}))}
    want = [sorted((terms[t], n) for t, n in c.items() if t in terms) for c in counted]
    for chunk, many in [(1, 5), (200, 5), (1 << 19, 1 << 12)]:
        monkeypatch.setattr(tx, "CHUNK", chunk)
        monkeypatch.setattr(tx, "CHUNK_TEXTS", many)
        got = list(tx.Vectors(terms)(texts))
        assert [list(zip(at.tolist(), n.tolist(), strict=True)) for at, n in got] == want
    assert [len(at) for at, _ in tx.Vectors({})(texts)] == [0] * len(texts)
    index = tx.build_index(terms, np.linspace(0.1, 1, len(terms)), [(k, k % 2, *v) for k, v in enumerate(got)], {0: 30, 1: 30})
    vectors = [index.vector(*v) for v in got]
    monkeypatch.setattr(tx, "TOGETHER", 7)
    for (rows, cos), v in zip(index.search(vectors, 5), vectors, strict=True):
        one_rows, one_cos = index.nearest(*v, 5)
        assert rows.tolist() == one_rows.tolist() and cos.tolist() == one_cos.tolist()


def test_a_rare_toxic_word_is_enough(spark):
    rows = [(k, " ".join(prose(k, 60, 3000) + (["zorgon"] if k % 100 == 1 else ["vile"] if k % 4 == 1 else []))) for k in range(1200)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 1)) for k in range(1200)], LABELS)
    index = tx.fit_toxicity(docs(spark, rows), labels)
    new = docs(spark, [(5000 + k, " ".join([*prose(5000 + k, 60, 3000), *(["zorgon"] if k < 5 else [])])) for k in range(25)])
    assert [r["predicted"] for r in tx.score_toxicity(new, index).orderBy("doc_id").collect()] == [1] * 5 + [0] * 20


def test_examples_without_words(spark):
    d = docs(spark, [(k, None if k % 2 else " .") for k in range(8)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(8)], LABELS)
    got = tx.score_toxicity(docs(spark, [(1, "some words"), (2, None)]), tx.fit_toxicity(d, labels)).collect()
    assert [(r["evidence"], r["predicted"]) for r in got] == [([], got[0]["predicted"])] * 2


def test_toxicity_edge_cases(spark):
    d, labels = graded(spark, 60)
    index = tx.fit_toxicity(d, labels)
    odd = docs(spark, [(None, None), (1, ""), (1, "vile"), (2, "vile " * 30000)]).withColumn("score", F.lit("x"))
    got = tx.score_toxicity(odd, index).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert tx.score_toxicity(docs(spark, []), index).count() == 0
    assert by_id(tx.score_toxicity(docs(spark, [(1, "x")]), tx.fit_toxicity(d, labels.limit(0))))[1]["score"] == 0.0
