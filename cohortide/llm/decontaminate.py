"""Benchmark decontamination: hash set of test n-grams, scanned over every training window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortide.llm.scratch import keep
from cohortide.llm.words import positions, words, words_sql

#: Up to so many different windows the hash set goes to every task with the plan; beyond, Spark joins.
SET_LIMIT = 50_000
#: Words of a text before its capitals are lowered.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _hash(w: Column, start: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(w, start + j) for j in range(width)])


def _text(w: Column, start: Column, width: Column) -> Column:
    return F.array_join(F.slice(w, start + 1, width), " ")


def item_windows(items: DataFrame, width: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per different window: ``window`` (its words), ``len``, ``items`` (sorted ids as text)."""
    rows = items.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w"))
    rows = rows.withColumn("len", F.least(F.size("w"), F.lit(width))).filter("len > 0")
    rows = rows.select("item", "len", "w", F.explode(positions(F.size("w"), F.col("len"))).alias("at"))
    rows = rows.select("item", "len", _text(F.col("w"), F.col("at"), F.col("len")).alias("window"))
    return rows.groupBy("window", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _found(w: Column, n: Column, known: dict[int, list[str] | None]) -> Column:
    """Windows of a row as (pos, len, window): those in the hash set, or all of a length without a set."""

    def of(length: int, windows: list[tuple[int, str]] | None) -> Column:
        at = positions(n, length)
        if windows is not None:
            hashes, texts = [x for x, _ in windows], [x for _, x in windows]
            at = F.filter(at, lambda i: _hash(w, i, length).isin(hashes))
            at = F.filter(at, lambda i: _text(w, i, F.lit(length)).isin(texts))
        return F.transform(
            at,
            lambda i: F.struct(
                i.alias("pos"), F.lit(length).alias("len"), _text(w, i, F.lit(length)).alias("window")
            ),
        )

    parts = [F.array().cast("array<struct<pos:int,len:int,window:string>>")]
    parts += [of(length, windows) for length, windows in sorted(known.items())]
    return F.array_sort(F.concat(*parts))


def _covered(hits: Column) -> Column:
    """Words inside any hit; hits are sorted by place."""
    return F.aggregate(
        hits,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["pos"] + x["len"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(a["end"], x["pos"]))).alias("n"),
        ),
        lambda a: a["n"].cast("long"),
    )


def mark_contaminated(
    docs: DataFrame, items: DataFrame, width: int = 10, text: str = "text", set_limit: int = SET_LIMIT
) -> DataFrame:
    """Add to every row ``n_words``, ``hits`` (pos, len and words of each window found, sorted),
    ``n_hit`` (words inside any hit) and ``contaminated``.

    A window is ``width`` consecutive words of an item, or all words of a shorter one.  Every window of
    every document is looked up by hash, and hits are verified as text, inside the row: nothing is
    shuffled while the benchmark has at most ``set_limit`` different windows.  A larger benchmark
    is joined on the windows' words.  Null and empty texts, and items without words, have no
    windows; copies are marked each for itself.  Input columns of the names above are replaced.
    """
    own = ["n_words", "hits", "n_hit", "contaminated", "_w", "_row"]
    windows = item_windows(items, width)
    sizes = {r["len"]: r["n"] for r in windows.groupBy("len").agg(F.count("*").alias("n")).collect()}
    known: dict[int, list | None] = dict.fromkeys(sizes)
    if sum(sizes.values()) <= set_limit:
        for m in known:
            w = F.split("window", " ")
            rows = windows.filter(F.col("len") == m).select(_hash(w, F.lit(0), m), "window").collect()
            known[m] = [tuple(r) for r in rows]
    cols = [c for c in docs.columns if c not in own]
    rows = docs.select(*cols, words(F.col(text)).alias("_w"))
    rows = rows.withColumn("n_words", F.size("_w").cast("long"))
    found = _found(F.col("_w"), F.size("_w"), known)
    if all(k is not None for k in known.values()):
        rows = rows.withColumn("hits", found)
    else:
        rows = keep(rows.withColumn("_row", F.monotonically_increasing_id()), "windows")
        every = rows.select("_row", F.explode(found).alias("hit"))
        every = every.join(windows.select("window"), F.col("hit.window") == F.col("window"), "left_semi")
        hits = every.groupBy("_row").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
        rows = rows.join(hits, "_row", "left")
        none = F.array().cast("array<struct<pos:int,len:int,window:string>>")
        rows = rows.withColumn("hits", F.coalesce("hits", none))
    rows = rows.withColumn("n_hit", _covered(F.col("hits")))
    rows = rows.withColumn("contaminated", F.col("n_hit") > 0)
    return rows.select(*cols, "n_words", "hits", "n_hit", "contaminated")


def hit_items(marked: DataFrame, items: DataFrame, columns: list[str], width: int = 10) -> DataFrame:
    """``columns`` of every marked row, and ``items``: the sorted ids, as text, of the benchmark items
    whose windows occur in it.  Null ids are left out.  Only rows with hits are joined."""
    rows = keep(marked.select(*columns, "hits"), "marked")
    some = F.coalesce(F.size("hits") > 0, F.lit(False))
    hit = rows.filter(some).withColumn("_row", F.monotonically_increasing_id())
    found = F.array_distinct(F.transform("hits", lambda h: h["window"]))
    hit = hit.select("_row", *columns, F.explode(found).alias("_window"))
    lookup = item_windows(items, width).select(F.col("window").alias("_window"), F.col("items").alias("_items"))
    grouped = hit.join(lookup, "_window", "left").groupBy("_row", *columns)
    named = grouped.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("items")).drop("_row")
    return named.unionByName(rows.filter(~some).select(*columns, F.array().cast(named.schema["items"].dataType).alias("items")))


def remove_spans(marked: DataFrame, text: str = "text") -> DataFrame:
    """Cut the words inside hits out of ``text``, each with the gap before it; other rows stay as they are.

    The original text is taken apart into gaps and words, and what is left is put together unchanged.
    """
    pair = "array<struct<s:int,e:int>>"

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        end = x["pos"] + x["len"]
        wider = F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], end).alias("e")))
        new = F.array(F.struct(x["pos"].alias("s"), end.alias("e")))
        inside = F.coalesce(last["e"] >= x["pos"], F.lit(False))
        return F.when(inside, F.concat(F.slice(done, 1, F.size(done) - 1), wider)).otherwise(F.concat(done, new))

    cuts = F.aggregate("hits", F.array().cast(pair), add)
    rows = marked.withColumn("_cuts", cuts)
    word = F.regexp_extract_all(F.col(text), F.lit(ANY_CASE_WORD), F.lit(0))
    gap = F.split(F.col(text), ANY_CASE_WORD, -1)
    rows = rows.withColumn("_gaps", F.when(F.col("contaminated"), gap))
    rows = rows.withColumn("_parts", F.when(F.col("contaminated"), F.zip_with("_gaps", word, lambda g, w: F.concat(g, F.coalesce(w, F.lit(""))))))
    n = F.size("_parts")
    kept = F.transform(
        F.sequence(F.lit(0), F.size("_cuts")),
        lambda i: F.struct(
            F.coalesce(F.get(F.col("_cuts"), i - 1)["e"], F.lit(0)).alias("s"),
            F.coalesce(F.get(F.col("_cuts"), i)["s"], n).alias("e"),
        ),
    )
    left = F.array_join(F.transform(kept, lambda k: F.array_join(F.slice("_parts", k["s"] + 1, k["e"] - k["s"]), "")), "")
    return rows.withColumn(text, F.when(F.col("contaminated"), left).otherwise(F.col(text))).drop("_cuts", "_gaps", "_parts")


def contamination_sql(width: int = 10) -> str:
    return f"""
with d as (select doc_id, {words_sql("text")} as w from documents),
b as (select item_id, {words_sql("text")} as w from benchmark),
bw as (select item_id, least(len(w), {width}) as m, unnest(range(1, len(w) - least(len(w), {width}) + 2)) as p, w from b where len(w) > 0),
win as (select distinct item_id, m, array_to_string(w[p:p + m - 1], ' ') as win from bw),
lens as (select distinct m from win),
dw as (select doc_id, m, unnest(range(1, len(w) - m + 2)) as p, w from d, lens where len(w) >= m),
hit as (select doc_id, p, dw.m as m, item_id from (select doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') as win from dw) dw join win using (win)),
n as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(p, p + m)) as at from hit) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join i using (doc_id)
"""
