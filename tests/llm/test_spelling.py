from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from helpers import ascii_lower, by_id, docs
from pyspark.sql import functions as F

from cohortide.llm import spelling
from cohortide.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def brute_counts(rows, drop=None):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", ascii_lower(text)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            out[run if not drop or h % drop else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return out


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(counts, least=3, shortest=5):
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    forms, out = {}, {}
    for w in words:
        by = sorted((-words[v], v) for v in words if near(w, v))
        form = by[0][1] if by and -by[0][0] >= 2 * words[w] else None
        forms[w], out[w] = form, (words[w], len(by), words[form] if form else None)
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, *out[w])
    return out


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def vocabulary(seed, n, letters="abé", sizes=(1, 9)):
    pick = random.Random(seed)
    return {"".join(pick.choices(letters, k=pick.randint(*sizes))): pick.randint(1, 60) for _ in range(n)}


@pytest.mark.parametrize(("part", "depth"), [(10_000, 2), (4, 1), (1, 2)])
def test_equals_brute_force(spark, part, depth):
    counts = vocabulary(1, 300) | {"a" * 40: 9, "a" * 41: 30, "a" * 20 + "b" + "a" * 20: 4, "a" * 40 + "b": 90}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("form", F.lit("x"))
    have = got(spelling.group_variants(words, 2, 3, part=part, depth=depth))
    assert have == brute(counts, 2, 3)
    assert any(v[1] != (v[0] or k) for k, v in have.items())  # chains of forms


def test_acceptor_is_minimal_and_pairs_come_once():
    words = sorted(w for w in vocabulary(3, 400))
    machine = spelling.Acceptor(words)
    pairs = [tuple(sorted(p)) for p in machine.pairs()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(u, v) for u in words for v in words if u < v and near(u, v)}
    # as many states as there are different sets of rests
    rests = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(machine.states) == len(rests)


def test_no_pairs_of_a_hot_prefix_in_one_part(spark):
    counts = {f"prefix{a}{b}{c}": 5 for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    parts = spelling.start_states(words, 20, 2, [])
    sizes = [r["k"] for p in parts for r in p.groupBy("key").agg(F.count("*").alias("k")).collect()]
    assert len(parts) > 2 and max(sizes) <= 20
    assert got(spelling.group_variants(words, part=20)) == brute(counts)


def test_words_of_texts(spark):
    rows = [(1, "Harbour HARBOR harbour"), (2, "harbour, harbor; harbors 12x"), (2, "harbour, harbor; harbors 12x"), (None, "harbour Été"), (3, None), (4, ""), (5, "naïve " * 4000 + "naive " * 9)]
    for drop in (None, 1, 2):
        have = spelling.word_counts(docs(spark, rows).withColumn("word", F.lit("x")), drop)
        assert {r["word"]: r["n"] for r in have.collect()} == {w: n for w, n in brute_counts(rows, drop).items() if w}
    assert spelling.group_variants(spelling.word_counts(docs(spark, []))).count() == 0


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(brute_counts(rows, 97))
    have = by_id(QUERIES["op13_spelling"](spark, SF), "word")
    assert {w: tuple(r[1:]) for w, r in have.items()} == want and len(want) > 100
