from __future__ import annotations

from helpers import by_id, docs, prose, words
from pyspark.sql import functions as F

import corpus_pipeline
from checks import compare
from cohortide.llm.registry import QUERIES
from cohortide.llm.substring_dedup import cells_of, dedup_lines, dedup_passages, dedup_sql, in_cells


def line(seed, n=60):
    return " ".join(prose(seed, n))


def brute(rows, min_words):
    """Rows of (doc_id, text) in rank order, each once."""
    seen, out = set(), {}
    for doc, text in rows:
        kept, gone, at = [], [], 0
        for x in (text or "").split("\n"):
            w = " ".join(words(x))
            if len(words(x)) >= min_words:
                if w in seen:
                    gone.append((at, at + len(x)))
                else:
                    kept.append(x)
                seen.add(w)
            else:
                kept.append(x)
            at += len(x) + 1
        out[doc] = ("\n".join(kept) if gone else text, gone)
    return out


def test_matches_brute_force(spark):
    shared, other = line(1), line(2, 20)
    rows = [(k, "\n".join([line(100 + k), shared if k % 2 else "short line", other.upper() + "!", ""])) for k in range(40)]
    rows += [(50, shared + "\n" + shared), (51, None), (52, ""), (53, "\n\n"), (54, line(77, 20000)), (55, line(77, 20000) + "\nx"), (56, "é " + shared)]
    got = by_id(dedup_lines(docs(spark, rows)))
    want = brute(rows, 20)
    for doc, (text, gone) in want.items():
        assert got[doc]["text"] == text
        assert [tuple(s) for s in got[doc]["removed"]] == gone
        assert got[doc]["n_removed"] == len(gone)
    for doc, text in rows:  # offsets are those of the original text
        for s, e in got[doc]["removed"]:
            assert len(words(text[s:e])) >= 20


def test_hot_line_stays_once(spark):
    rows = [(k, line(1) + "\n" + line(1000 + k)) for k in range(700)]
    got = dedup_lines(docs(spark, rows).repartition(6)).collect()
    assert sum(line(1) in r["text"] for r in got) == 1
    assert next(r["doc_id"] for r in got if line(1) in r["text"]) == 0


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, line(3)), (1, line(3)), (None, line(3)), (2, line(4))]
    t = docs(spark, rows).withColumn("removed", F.lit("x")).withColumn("n_units", F.lit("y"))
    got = dedup_lines(t).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, line(3)), (1, line(3)), (0, ""), (2, line(4))])
    assert dedup_lines(docs(spark, [])).count() == 0


def verse(seed, n=6, width=10):
    w = prose(seed, n * width, 100_000)
    return [" ".join(w[k * width : (k + 1) * width]) for k in range(n)]


def test_a_passage_on_short_lines_stays_once(spark):
    poem = verse(1)  # 60 words on six lines
    rows = [(k, "\n".join([f"own {k}", *verse(100 + k, 3), *poem, *verse(200 + k, 2)])) for k in range(4)]
    rows += [(10, "\n".join(poem)), (11, "\n\n".join([poem[0].upper() + "!", *poem[1:]])), (12, poem[2]), (13, None), (14, "")]
    want = {k: "\n".join([f"own {k}", *verse(100 + k, 3), *verse(200 + k, 2)]) for k in range(1, 4)}
    want |= {0: rows[0][1], 10: "", 11: "", 12: poem[2], 13: None, 14: ""}
    got = by_id(dedup_passages(docs(spark, rows).repartition(3)))
    for doc, text in rows:
        assert got[doc]["text"] == want[doc]
        cut = [tuple(s) for s in got[doc]["removed"]]
        assert len(cut) == got[doc]["n_removed"] == (doc in (1, 2, 3, 10, 11))
        assert all(words(text[s:e]) == words(" ".join(poem)) for s, e in cut)
    staged = by_id(corpus_pipeline.substring_stage(spark, docs(spark, rows), ""))
    assert {k: r["text"] for k, r in staged.items()} == want


def test_every_line_of_a_repeated_run_goes(spark):
    for seed in range(3):  # lines of 1 to 25 words, blank ones between; neither end is a window's end by itself
        w = prose(seed, 200, 100_000)
        run, at = [], 0
        for n in (15, 10, 3, 0, 25, 1, 19, 0, 7, 2):
            run.append(" ".join(w[at : at + n]))
            at += n
        rows = [(1, "\n".join(["before this", *run, "and after"])), (2, "\n".join(["other", *run, "end"]))]
        got = by_id(dedup_passages(docs(spark, rows)))
        assert (got[1]["text"], got[2]["text"]) == (rows[0][1], "other\nend")


def test_a_run_that_overlaps_itself_stays_once(spark):
    same = " ".join(prose(5, 10))
    got = by_id(dedup_passages(docs(spark, [(1, "\n".join([same] * 9 + ["tail"])), (2, same + "\n" + same)])))
    assert (got[1]["text"], got[2]["text"]) == (f"{same}\n{same}\ntail", "")


def test_lines_equal_their_sql(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    spans = F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"]))
    have = dedup_lines(table).withColumn("removed", F.array_join(spans, ","))
    _, problems = compare.differences(have, compare.duck(sf), dedup_sql())
    assert not problems


def test_a_passage_inside_lines_stays_once(spark):
    shared = " ".join(prose(9, 70, 100_000))
    rows = [(k, " ".join(prose(100 + k, 13 + k, 100_000)) + ". " + shared + ", " + " ".join(prose(300 + k, 17, 100_000))) for k in range(12)]
    for cells in (1 << 24, 1 << 16):
        got = by_id(dedup_passages(docs(spark, rows).repartition(3), cells=cells))
        assert got[0]["text"] == rows[0][1]
        for k, text in rows[1:]:
            left = got[k]["text"]
            assert text.startswith(left[:20]) and text.endswith(left[-20:])
            assert len(set(words(left)) & set(words(shared))) <= 25  # the ends of the passage at most
            assert all(words(text[s:e]) in [words(shared)[i : i + len(words(text[s:e]))] for i in range(70)] for s, e in got[k]["removed"])


def test_query_leaves_few_long_runs_and_takes_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = by_id(QUERIES["op3_substring_dedup"](spark, sf))

    def runs(text, n):
        w = words(text)
        return {hash(tuple(w[i : i + n])) for i in range(len(w) - n + 1)}

    def later(texts, n):
        seen, out = set(), set()
        for doc in sorted(texts):
            own = runs(texts[doc], n)
            out |= {doc} if own & seen else set()
            seen |= own
        return out

    repeated = later(before, 50)
    left = later({d: r["text"] for d, r in rows.items()}, 50)
    assert len(repeated) > 100 and len(left) < 0.05 * len(before)
    assert len({d for d in repeated if rows[d]["n_removed"]}) > 0.9 * len(repeated)
    # what goes stands in an earlier place, whole
    seen = set()
    for doc in sorted(before):
        own = runs(before[doc], 20)
        for s, e in (map(int, x.split("-")) for x in rows[doc]["removed"].split(",") if x):
            assert runs(before[doc][s:e], 20) <= seen | own
        if not rows[doc]["n_removed"]:
            assert rows[doc]["text"] == before[doc]
        seen |= own
    print(len(repeated), len(left))


def test_only_texts_with_cuts_are_moved(spark):
    shared = line(1)
    rows = [(k, line(100 + k)) for k in range(300)] + [(400, shared), (401, shared + "\n" + line(2)), (402, None), (None, line(500))]
    table = docs(spark, rows)
    got = dedup_passages(table)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Join LeftOuter") == 1
    seen = {r["doc_id"]: (r["text"], r["n_removed"], len(r["removed"])) for r in got.collect()}
    assert len(seen) == len(rows)
    assert seen.pop(401) == (line(2), 1, 1)
    assert all(seen[d] == (t, 0, 0) for d, t in rows if d != 401)
    first = spark.createDataFrame([(7,), (7 + (1 << 16),), (-3,)], "h long")
    bits = spark.sparkContext.broadcast(cells_of(first, 1 << 16))
    numbers = spark.createDataFrame([(h,) for h in (7, 8, -3, (1 << 16) - 3, -4)], "h long")
    assert [r[0] for r in numbers.select(in_cells(F.col("h"), bits, 1 << 16)).collect()] == [True, False, True, True, False]


def test_every_passage_of_fifty_words_inside_lines_is_found(spark):
    def around(seed):  # sentences of 9 words, whose ends need not be those of the passage
        w = prose(seed, 63, 100_000)
        return " ".join(" ".join(w[i : i + 9]) + "." for i in range(0, 63, 9))

    rows = []
    for k in range(150):
        shared = " ".join(x + "." * (i % 12 == k % 12) for i, x in enumerate(prose(5000 + k, 52, 100_000)))
        rows += [(k, f"{around(k)} {shared} {around(1000 + k)}"), (1000 + k, f"{around(2000 + k)} {shared} {around(3000 + k)}")]
    got = by_id(dedup_passages(docs(spark, rows)))
    for doc, text in rows:
        assert (got[doc]["n_removed"] > 0) == (doc >= 1000)
        assert doc < 1000 or all(20 <= len(words(text[s:e])) <= 52 for s, e in got[doc]["removed"])


def test_marks_between_two_repeated_lines_stay(spark):
    one, two = line(1), line(2)
    rows = [(1, one), (2, two), (3, f"{one}\n---\n\n{two}"), (4, f"{line(3)}\n{one}\n***\n{line(4)}")]
    got = by_id(dedup_passages(docs(spark, rows)))
    assert [got[k]["text"] for k in (3, 4)] == ["---\n", f"{line(3)}\n***\n{line(4)}"]
