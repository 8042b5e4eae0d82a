from __future__ import annotations

from helpers import ITEMS, by_id, docs, prose, sha, words
from pyspark.sql import functions as F

from cohortide.llm import decontaminate as dc
from cohortide.llm.license_scan import BASE, TEMPLATES, rare_index, scan_licenses


def places(text, phrase):
    w, p = words(text), phrase.split()
    return [i for i in range(len(w)) if w[i : i + len(p)] == p]


TEXTS = [
    (1, "Licensed under CC-BY 4.0. All rights reserved."),
    (2, "the gnu General Public License, version 3. cc by cc by"),
    (3, None),
    (4, ""),
    (5, "general public\nlicense general public notlicense"),
    (6, "all all rights reserved rights reserved all rights"),
    (7, "cc " * 3000 + "by"),
    (8, "É cc by É"),
    (9, "by cc"),
    (2, "cc by"),
    (10, "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    (11, "GNU Lesser General Public License"),
]


def test_license_places_match_brute_force(spark):
    got = scan_licenses(docs(spark, TEXTS)).select("doc_id", "text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        found = {t.label: places(r["text"], t.text) for t in BASE}
        every = sorted(i for x in found.values() for i in x)
        assert r["n_words"] == len(words(r["text"]))
        assert r["n_base"] == len(every)
        assert (r["first_word"], r["last_word"]) == ((every[0], every[-1]) if every else (None, None))
        assert r["base_labels"] == ",".join(sorted(k for k, v in found.items() if v))
        own = {t.label for t in TEMPLATES if places(r["text"], " ".join(t.words[: t.key]))}
        assert r["labels"] == ",".join(sorted(own))
        assert (r["score"] > 0) == bool(own)


def test_index_takes_the_rarest_word_of_a_key():
    got = rare_index(BASE, {"cc": 9, "by": 2, "general": 4, "public": 4, "license": 7, "all": 5})
    assert got == [("by", 0, 1), ("general", 1, 0), ("rights", 2, 1)]


def test_license_scan_keeps_other_columns(spark):
    t = docs(spark, [(1, "cc by")]).withColumn("labels", F.lit("mine")).withColumn("score", F.lit(7))
    row = scan_licenses(t).first()
    assert (row["labels"], row["score"], row["source"]) == ("cc-by", 1.0, "s")
    assert scan_licenses(docs(spark, [])).count() == 0


def table(spark):
    a, b = prose(1, 30), prose(2, 14)
    items = [(1, " ".join(a)), (2, " ".join(b)), (3, "only four words here"), (4, None), (5, ""), (6, " ".join(a)), (10, "Only, FOUR words; here!")]
    rows = [
        (1, " ".join(prose(9, 40) + a[5:20] + prose(10, 30))),
        (2, " ".join(a).upper()),
        (3, " ".join(a[:9])),
        (4, "so, only four: words here only four words here."),
        (5, None),
        (6, ""),
        (7, " ".join(prose(11, 5000))),
        (8, " ".join(a[:12] + a[3:15] + b)),
        (8, "again"),
        (None, " ".join(b)),
    ]
    return docs(spark, rows), spark.createDataFrame(items, ITEMS)


def brute(text, items, width=10):
    w, hit, which = words(text), set(), set()
    for item, t in items:
        x = words(t)
        m = min(width, len(x))
        for win in {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if m else ():
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) == win:
                    hit |= set(range(i, i + m))
                    which.add(str(item))
    return len(w), hit, sorted(which)


def test_contamination_matches_brute_force(spark):
    d, items = table(spark)
    pairs = [(r["item_id"], r["text"]) for r in items.collect()]
    for limit in (dc.SET_LIMIT, 3):  # hash set, and join
        marked = dc.mark_contaminated(d, items, set_limit=limit)
        rows = dc.hit_items(marked, items, ["doc_id", "text", "n_words", "n_hit", "contaminated"]).collect()
        assert len(rows) == d.count()
        for r in rows:
            n, hit, which = brute(r["text"], pairs)
            assert (r["n_words"], r["n_hit"], r["contaminated"]) == (n, len(hit), bool(hit))
            assert list(r["items"]) == which
            assert sha(",".join(r["items"])) == sha(",".join(which))


def test_cut_texts_keep_the_rest(spark):
    d, items = table(spark)
    pairs = [(r["item_id"], r["text"]) for r in items.collect()]
    cut = dc.remove_spans(dc.mark_contaminated(d, items)).select("doc_id", "text", "n_words").collect()
    before = {(r["doc_id"], len(words(r["text"]))): r["text"] for r in d.collect()}
    for r in cut:
        old = before[r["doc_id"], r["n_words"]]
        _, hit, _ = brute(old, pairs)
        assert words(r["text"]) == [w for i, w in enumerate(words(old)) if i not in hit]
        if not hit:
            assert r["text"] == old
    assert next(r["text"] for r in cut if r["doc_id"] == 4) == "so."


def test_no_benchmark_and_no_documents(spark):
    d, items = table(spark)
    none = spark.createDataFrame([], ITEMS)
    assert dc.mark_contaminated(d, none).filter("contaminated").count() == 0
    assert dc.mark_contaminated(docs(spark, []), items).count() == 0
    clash = d.withColumn("hits", F.lit(1)).withColumn("n_hit", F.lit(99))
    assert by_id(dc.mark_contaminated(clash, items))[2]["n_hit"] == 30
