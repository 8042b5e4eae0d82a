from __future__ import annotations

from helpers import ITEMS, LABELS, docs, prose, words

import corpus_pipeline


def test_stages_on_a_small_corpus(spark, tmp_path):
    passage, leak = " ".join(prose(900, 60)), prose(901, 25)
    rows = []
    for k in range(120):
        body = prose(k, 80)
        text = " ".join(body)
        if k % 4 == 0:
            text = " ".join(w.upper() + "!!" for w in body)
        elif k % 10 == 1:
            text += "\n" + passage
        elif k % 10 == 3:
            text += "\n" + " ".join(leak)
        rows.append((k, text, f"s{k % 3}"))
    rows += [(500 + k, rows[2][1], "s0") for k in range(5)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(120) if k % 5], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(leak))], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = d.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path)).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert d.columns == columns
        seen[name] = d.collect()
    sound = {k for k in range(120) if k % 4} | {500 + k for k in range(5)}
    assert {r["doc_id"] for r in seen["quality classifier"]} == sound
    assert {r["doc_id"] for r in seen["n-gram Jaccard join"]} == {k for k in range(120) if k % 4}
    assert sum(passage in r["text"] for r in seen["substring dedup"]) == 1
    left = seen["benchmark decontamination"]
    assert len(left) == 90
    assert not any(" ".join(leak[:10]) in " ".join(words(r["text"])) for r in left)
    assert all(r["n_chars"] == len(r["text"]) for r in left)
    assert {r["source"] for r in seen["mixing to target weights"]} == {"s0", "s1", "s2"}
    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["taken"]) for r in seen["mixing to target weights"])


def test_near_copies_of_five_words_and_0_8(spark):
    def pair(seed, n):
        whole = [f"x{seed}y{i}" for i in range(n)]
        return " ".join(whole), " ".join([*whole[: n // 2], "changed", *whole[n // 2 + 1 :]])

    # by sets of five words 41 / 51 and 39 / 49 agree; by sets of three the first pair's 45 / 51 would be no link at 0.9
    rows = [(k, t, "s") for k, t in enumerate([*pair(1, 50), *pair(2, 48)])]
    left = corpus_pipeline.near_duplicate_stage(spark, docs(spark, rows), "")
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2, 3]
