from __future__ import annotations

import random
import re
from collections import Counter

from helpers import ascii_lower, docs
from pyspark.sql import functions as F

from checks import compare
from cohortide.llm import phrases


def brute(rows, least, top=2000, absorb=80):
    """Rows of (lang, text)."""
    f, total = {}, Counter()
    for lang, text in rows:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", ascii_lower(text)):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            inside = max((b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))), default=0)
            if 100 * inside < absorb * a:
                score, _, left, right = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def texts(seed, n):
    pick, common = random.Random(seed), "red blue Green old new the of and tree sea".split()
    fixed = ["state of the art", "new york city", "old old old", "blue sea"]
    for _ in range(n):
        lang = pick.choice(["en", "en", "de", None])
        said = [pick.choice(fixed) if pick.random() < 0.3 else pick.choice(common) for _ in range(pick.randint(0, 60))]
        yield lang, "".join(w + pick.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for w in said)


def frame(spark, rows):
    return docs(spark, [(k, text) for k, (_, text) in enumerate(rows)]).drop("lang").join(
        spark.createDataFrame([(k, lang) for k, (lang, _) in enumerate(rows)], "doc_id long, lang string"), "doc_id"
    )


def test_equals_brute_force(spark):
    rows = [*texts(1, 150), ("en", None), ("en", ""), (None, "a"), ("fr", "é è é è. " * 40), ("en", "new york city " * 3000)]
    table = frame(spark, rows).withColumn("size", F.lit("x")).withColumn("n", F.lit("y")).repartition(5)
    for least, shards, cells in ((8, 3, 1 << 20), (30, 1, 1 << 20), (8, 4, 64)):  # few cells: nothing is pruned, nothing is lost
        have = phrases.collocations(table, least, shards=shards, cells=cells)
        assert sorted(tuple(r) for r in have.collect()) == brute(rows, least)
    assert sorted(tuple(r) for r in phrases.collocations(table, 8, top=3).collect()) == brute(rows, 8, 3)
    assert phrases.collocations(docs(spark, [])).count() == 0


def test_longer_phrases_wait_for_their_parts(spark):
    pick = random.Random(5)
    rows = [("en", " ".join(pick.choices([f"w{i}" for i in range(9000)], k=200)) + ". once upon a time") for _ in range(180)]
    log = []
    phrases.frequent_cells(frame(spark, rows).select("lang", "text"), 30, log=log)
    first = {size: min(step for step, k in log if size in k) for size in (1, 2, 3, 4)}
    assert first == {1: 1, 2: 2, 3: 3, 4: 4}
    # of 36,000 pairs only those of frequent words were ever counted
    assert max(k.get(2, 0) for _, k in log) < 3000


def test_arithmetic_is_exact(spark):
    big = 3 * 10**12 + 1
    row = spark.sql(f"select cast({big} as decimal(20, 0)) * cast(2000000 as decimal(7, 0)) div cast({2 * big - 1} as decimal(20, 0)) as s").first()
    assert row["s"] == 2000000 * big // (2 * big - 1)


def test_query_equals_its_sql_on_more_texts(spark):
    sf = "/root/testdata/sf0.01"
    from cohortide.llm.registry import ORACLES, QUERIES

    rows, problems = compare.differences(QUERIES["op12_phrases"](spark, sf), compare.duck(sf), ORACLES["op12_phrases"])
    assert not problems and rows > 200


def test_rare_phrases_do_not_pass_with_few_cells(spark):
    pick = random.Random(8)
    rows = [("en", " ".join(pick.choices([f"w{i}" for i in range(3000)], k=100)) + ". once upon a time") for _ in range(120)]
    texts = frame(spark, rows).select("lang", "text")
    f = Counter()
    for _, text in rows:
        for piece in text.split(". "):
            w = piece.split()
            f.update(" ".join(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    counts = phrases.phrase_counts(texts, phrases.frequent_cells(texts, 30, cells=64)).collect()
    have = {r["phrase"]: r["n"] for r in counts if r["size"]}
    want = {p: n for p, n in f.items() if n >= 30}
    assert want and all(have[p] == n for p, n in want.items()) and all(f[p] == n for p, n in have.items())
    assert len(have) < 0.02 * len(f)  # every table of 64 cells is full


def test_a_phrase_is_named_by_the_tasks_of_its_language(spark, monkeypatch):
    monkeypatch.setattr(phrases, "NAMED", 50)  # many stretches in a task
    said = [("en", "red sun rises. red sun sets"), ("de", "rote sonne. red sun")]
    texts = spark.createDataFrame([said[k % 2] for k in range(400)], "lang string, text string").repartition(16)
    counts = phrases.phrase_counts(texts, phrases.frequent_cells(texts, 30, cells=64))
    assert "rangepartitioning(lang" in counts._jdf.queryExecution().executedPlan().toString().lower()
    got = {(r["lang"], r["phrase"]): r["n"] for r in counts.collect()}
    assert got["en", "red sun"] == 400 and got["de", "red sun"] == got["de", "rote sonne"] == 200
    assert got["en", ""] == 1200 and got["de", ""] == 800 and got["en", "red sun sets"] == 200


def test_more_partitions_hand_over_no_more_phrases(spark):
    said = [("en", "red sun rises. red sun sets"), ("de", "rote sonne. red sun")]
    texts = spark.createDataFrame([said[k % 2] for k in range(400)], "lang string, text string").repartition(16)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    most = phrases.WAVES * spark.sparkContext.defaultParallelism
    frequent = phrases.frequent_cells(texts, 30, cells=64)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 3 * most)
        counts = phrases.phrase_counts(texts, frequent)
        tasks = int(re.search(r"rangepartitioning\(lang.*, (\d+)\), REPARTITION", counts._jdf.queryExecution().executedPlan().toString())[1])
        got = {(r["lang"], r["phrase"]): r["n"] for r in counts.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tasks == most
    assert got["en", "red sun"] == 400 and got["de", "red sun"] == 200 and got["en", ""] == 1200
