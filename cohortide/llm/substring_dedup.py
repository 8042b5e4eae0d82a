"""Substring deduplication by hashes of normalised lines."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortide.llm.scratch import bound_batches, by_value, clear, keep
from cohortide.llm.words import WORD, words_sql

by_value(__name__)

#: Lines of fewer words are too common to be worth removing: greetings, headings, list marks.
MIN_WORDS = 20
#: Bits of the table of digests that occur twice, and those that a task packs at once.
CELLS, PART = 1 << 24, 1 << 16
#: Neighbours on either side among which a piece ends after the word of least hash, and code points read at once.
REACH, BLOCK = 4, 1 << 18
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: What stands in no word.
_GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def line_units(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """Lines of at least so many words: doc_id, _text (hash of the whole text), line, start, end, digest.

    ``start`` and ``end`` count code points of the original text.  ``digest`` hashes the line's words, so
    the case of A-Z, punctuation and white space don't matter.
    """
    word = re.compile(WORD)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "_text", "line", "start", "end", "digest"]
        for pdf in batches:
            out = []
            for doc, key, whole in zip(pdf["doc_id"].astype(object), pdf["_text"], pdf["text"], strict=True):
                if len(out) >= 5000:
                    yield pd.DataFrame(out, columns=names).astype({"doc_id": object})
                    out = []
                at = 0
                for number, line in enumerate(whole.split("\n")):
                    end = at + len(line)
                    if len(line) >= 2 * min_words - 1:
                        words = word.findall(line.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
                        if len(words) >= min_words:
                            digest = hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()
                            out.append((None if pd.isna(doc) else int(doc), key, number, at, end, digest))
                    at = end + 1
            yield pd.DataFrame(out, columns=names).astype({"doc_id": object})

    rows = docs.filter(F.col(text).isNotNull()).select("doc_id", F.xxhash64(text).alias("_text"), F.col(text).alias("text"))
    return rows.mapInPandas(cut, "doc_id long, _text long, line int, start int, end int, digest binary")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Sums:
    """Polynomial hashes of stretches of numbers: the same for equal stretches, wherever they stand."""

    def __init__(self, base: int) -> None:
        self.base, self.powers = base, [np.zeros(0, np.uint64)] * 2

    def __call__(self, values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.powers[0]) <= len(values):
            n = 2 * len(values) + 1
            back = pow(self.base, -1, 1 << 64)
            self.powers = [np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (self.base, back)]
        up, down = self.powers
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return _mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))


class Passages:
    """Runs of ``min_words`` or more words, of many texts at once: from the begin of each piece on, and the shortest ones of
    whole lines from each line on and up to each line.

    A piece is a line, or a part of one that ends after a word whose hash (with the word before it) is the least
    among its ``reach`` neighbours on either side.  Where a piece ends depends on the words around it alone, so a passage
    is cut alike wherever it stands.  Any repeated run of lines with so many words is the union of runs of lines in it, so all of
    it is found; of a passage inside a line, all from the first begin of a piece to the end of the last run.
    """

    def __init__(self, min_words: int, reach: int = REACH) -> None:
        self.min_words, self.reach = min_words, reach
        self.letters, self.one, self.two = Sums(0x9E3779B97F4A7C15), Sums(0xC2B2AE3D27D4EB4F), Sums(0x165667B19E3779F9)

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and hash of each word, and the places of line ends; A-Z is lowered."""
        starts, hashes, lines, at = [], [], [], 0
        while at < len(text):
            stop = at + BLOCK
            if stop < len(text):  # no word stands in two blocks
                gap = _GAP.search(text, stop)
                stop = gap.end() if gap else len(text)
            code = np.frombuffer(text[at:stop].encode("utf-32-le", "surrogatepass"), np.uint32)
            code = code + np.where((code >= 65) & (code <= 90), np.uint32(32), np.uint32(0))
            inside = np.zeros(len(code) + 2, bool)
            inside[1:-1] = (code >= 128) | (code - np.uint32(48) < 10) | (code - np.uint32(97) < 26)
            first, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
            hashes.append(self.letters((code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25), first, end))
            starts.append(first + at)
            lines.append(np.flatnonzero(code == 10) + at)
            at = stop
        return np.concatenate(starts), np.concatenate(hashes), np.concatenate(lines)

    def ends(self, word: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Whether a piece ends after a word by its hash."""
        new = np.r_[True, text[1:] != text[:-1]]
        own = word + np.where(new, np.uint64(0), np.r_[np.uint64(0), word[:-1]]) * np.uint64(0x9E3779B97F4A7C15)
        own = own ^ (own >> np.uint64(32))
        at = np.arange(len(word)) + self.reach * (text + 1)
        padded = np.full(at[-1] + self.reach + 1, NONE, np.uint64)
        padded[at] = own
        least = np.ones(len(word), bool)
        for i in range(1, self.reach + 1):
            least &= (own < padded[at - i]) & (own <= padded[at + i])
        return least

    def __call__(self, texts: list[str]) -> pd.DataFrame:
        """text (its place in the list), line and last (words, and lines without words, before it), start and end (code points), h and g (two hashes) of every run."""
        starts, word, lines = self.words("\n".join(texts) + "\n")
        if not len(word):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("text", "line", "last", "start", "end", "h", "g")})
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        text, line = np.searchsorted(stops, starts), np.searchsorted(lines, starts)
        opens = np.r_[True, line[1:] != line[:-1]]
        closes = np.r_[opens[1:], True]
        left = np.where(opens, np.r_[0, lines + 1][line], starts)
        right = np.where(closes, lines[line], np.r_[starts[1:], 0])
        ends = closes | self.ends(word, text)
        begin = np.flatnonzero(np.r_[True, ends[:-1]])
        top, bottom = np.flatnonzero(opens), np.flatnonzero(closes)
        more = self.min_words - 1
        to = np.searchsorted(bottom, top + more)
        runs = [(x := begin[begin + more < len(word)], x + more), (top[to < len(bottom)], bottom[to[to < len(bottom)]])]
        since = np.searchsorted(top, bottom - more, "right") - 1
        runs.append((top[since[since >= 0]], bottom[since >= 0]))
        a, z = (np.concatenate(x) for x in zip(*runs, strict=True))
        a, z = np.divmod(np.unique((a * len(word) + z)[text[a] == text[z]]), len(word))
        base = np.r_[0, stops + 1][text[a]]
        place = np.arange(len(word)) + line - np.cumsum(opens)  # lines without words count as one
        first = place[np.searchsorted(text, text[a])]
        h, g = (s(word, a, z + 1).view(np.int64) for s in (self.one, self.two))
        return pd.DataFrame({"text": text[a], "line": place[a] - first, "last": place[z] - first, "start": left[a] - base, "end": right[z] - base, "h": h, "g": g})


def _together(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows whose texts are cut at once: about a block of code points."""
    block = (pdf["text"].str.len().cumsum() // BLOCK).to_numpy()
    for at in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(block)) + 1):
        if len(at):
            yield pdf.iloc[at]


def cells_of(numbers: DataFrame, cells: int) -> bytes:
    """A bit for each cell of numbers ``h``: whether some number is in it.  The table has ``cells`` bits, however many
    numbers there are; it only saves work, as what it lets through is compared whole later."""

    def bits(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(min(cells, PART), bool)
        own[pdf["cell"].to_numpy() % PART] = True
        return pd.DataFrame({"part": [int(pdf["cell"].iloc[0]) // PART], "bits": [np.packbits(own).tobytes()]})

    found = numbers.select(F.pmod("h", F.lit(cells)).cast("int").alias("cell")).distinct()
    parts = found.groupBy(F.floor(F.col("cell") / PART)).applyInPandas(bits, "part int, bits binary").collect()
    out = np.zeros(cells // 8, np.uint8)
    for r in parts:
        own = np.frombuffer(r["bits"], np.uint8)
        out[r["part"] * PART // 8 :][: len(own)] = own
    return out.tobytes()


def repeated_cells(docs: DataFrame, min_words: int, text: str, cells: int) -> bytes:
    """The cells of digests that occur twice."""

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passages = Passages(min_words)
        for pdf in batches:
            for part in _together(pdf):
                yield passages(part["text"].tolist())[["h"]]

    rows = docs.filter(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInPandas(numbers, "h long")
    return cells_of(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), cells)


def in_cells(number: Column, table: Broadcast, cells: int) -> Column:
    """Whether a number's cell is set."""

    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = np.frombuffer(table.value, np.uint8)
        for h in batches:
            cell = h.to_numpy() % cells
            yield pd.Series((bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool))

    return F.pandas_udf(look, "boolean")(number)


def passage_units(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", cells: int = CELLS) -> DataFrame:
    """Runs of every text whose digest may occur again: doc_id, _text (hash of the whole text), line, last (words), start, end, digest."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated_cells(docs, min_words, text, cells))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passages, bits = Passages(min_words), np.frombuffer(shared.value, np.uint8)
        for pdf in batches:
            for part in _together(pdf):
                runs = passages(part["text"].tolist())
                cell = runs["h"].to_numpy() % cells
                runs = runs[(bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)]
                own = part[["none", "id", "_text"]].iloc[runs["text"].to_numpy()].reset_index(drop=True)
                yield pd.concat([own, runs.drop(columns="text").reset_index(drop=True)], axis=1)

    rows = docs.filter(F.col(text).isNotNull()).select(
        F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("_text"), F.col(text).alias("text")
    )
    rows = rows.mapInPandas(cut, "none boolean, id long, _text long, line int, last int, start int, end int, h long, g long")
    return rows.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "_text", "line", "last", "start", "end", F.struct("h", "g").alias("digest"))


def repeated_units(units: DataFrame) -> DataFrame:
    """Every unit that another one with its digest comes before, in order of (doc_id, line), null ids last.

    The earliest of a digest is found with what each task has combined, and handed back by a join that Spark
    splits where a digest is frequent, so a line in every document stays spread out.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text", "line", *[c for c in ("last", "end") if "last" in units.columns])
    first = units.groupBy("digest").agg(F.min(rank).alias("_first"), F.count("*").alias("n")).filter("n > 1")
    return units.withColumn("_rank", rank).join(first.select("digest", "_first"), "digest").filter(F.col("_rank") != F.col("_first"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """Take out of ``text`` every line of ``min_words`` or more whose words stand in an earlier line.

    Adds ``n_units`` (lines that were compared), ``n_removed`` and ``removed`` (start and end of the lines taken out, in
    code points of the original text, sorted).  The earliest occurrence, by (doc_id, line), stays;
    null ids come last.  Null and empty texts stay as they are.  Rows with the same id and text are
    one document and treated alike; ones with the same id and other texts come in an arbitrary but
    fixed order.  Input columns of the names above are replaced.
    """
    docs = docs.drop("n_units", "n_removed", "removed")
    units = keep(line_units(docs, min_words, text), "units")
    counts = units.groupBy("doc_id", "_text").agg(F.countDistinct("line").cast("long").alias("n_units"))
    gone = repeated_units(units).groupBy("doc_id", "_text")
    gone = gone.agg(F.sort_array(F.collect_set(F.struct("start", "end", "line"))).alias("_gone"))
    per = counts.join(gone, counts["doc_id"].eqNullSafe(gone["doc_id"]) & (counts["_text"] == gone["_text"]), "left")
    per = per.select(counts["doc_id"].alias("_id"), counts["_text"].alias("_key"), "n_units", "_gone")
    rows = docs.withColumn("_text", F.xxhash64(text))
    rows = rows.join(per, rows["doc_id"].eqNullSafe(per["_id"]) & (rows["_text"] == per["_key"]), "left")
    lines = F.split(F.col(text), "\n", -1)
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    left = F.array_except(places, F.transform("_gone", lambda g: g["line"]))
    rebuilt = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.transform("_gone", lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end")))
    return rows.withColumns(
        {
            text: F.when(F.col("_gone").isNotNull(), rebuilt).otherwise(F.col(text)),
            "n_units": F.coalesce("n_units", F.lit(0)),
            "n_removed": F.when(F.col("_gone").isNotNull(), F.size("_gone")).otherwise(0).cast("long"),
            "removed": F.coalesce(spans, none),
        }
    ).drop("_text", "_id", "_key", "_gone")


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", cells: int = CELLS) -> DataFrame:
    """Take out of ``text`` every run of pieces (see ``Passages``) with ``min_words`` or more words that stands earlier: whole
    lines, however short, and passages inside lines.

    Adds ``n_removed`` and ``removed`` (start and end of what is taken out, in code points of the original
    text, sorted); a line that is taken out whole goes with its line end.  Order, nulls and repeated rows are as in
    ``dedup_lines``.  Of a passage that overlaps its own first occurrence only the words after that go, so
    every word taken out stands in an earlier place that stays.  Of a repeated passage, what lies before the first begin of a piece
    and after the last run stays: some words inside a line, nothing of whole lines.  Input columns of the names above are replaced.
    """
    others = F.struct(*[F.col(c) for c in docs.columns if c not in (text, "n_removed", "removed")]).alias("row")
    rows = docs.select(others, "doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("_text"))
    bound_batches(docs.sparkSession)
    units = keep(passage_units(docs, min_words, text, cells), "units", shelf := [])
    first = F.col("_first")
    within = F.col("doc_id").eqNullSafe(first["doc_id"]) & (F.col("_text") == first["_text"])
    spans = repeated_units(units).withColumns(
        {"line": F.when(within, F.greatest("line", first["last"] + 1)).otherwise(F.col("line")), "start": F.when(within, F.greatest("start", first["end"])).otherwise(F.col("start"))}
    ).filter("line <= last")
    # windows that overlap or meet become one run of pieces
    before = Window.partitionBy("doc_id", "_text").orderBy("line", "last")
    reach = F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("doc_id", "_text", "line", "last", "start", "end", (F.col("line") > F.coalesce(reach, F.lit(-2)) + 1).cast("int").alias("new"))
    spans = spans.withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "_text", "run")
    spans = spans.agg(F.min("start").alias("start"), F.max("end").alias("end"))
    gone = spans.groupBy("doc_id", "_text").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))
    gone = keep(gone.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_key"), "gone"), "gone")
    clear(docs.sparkSession, shelf)
    # texts that nothing is taken out of stay where they are; all others are moved
    moved = docs.sparkSession.sparkContext.broadcast(cells_of(gone.select(F.xxhash64("_id", "_key").alias("h")), cells))
    rows = rows.withColumn("_may", in_cells(F.xxhash64("doc_id", "_text"), moved, cells))
    whole_rows = rows.filter(~F.col("_may")).drop("_may")
    rows = rows.filter("_may").drop("_may")
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_id"]) & (rows["_text"] == gone["_key"]), "left")
    at = lambda i: F.substring("text", i + 1, F.lit(1))
    size = F.length("text")
    # what begins right after its own first occurrence begins on the next line
    cuts = F.transform("gone", lambda g: F.struct(F.when(at(g["start"]) == "\n", g["start"] + 1).otherwise(g["start"]).alias("start"), g["end"].alias("end")))
    rows = rows.withColumn("cuts", F.when(F.col("gone").isNotNull(), cuts))

    def whole(c: Column) -> Column:
        return ((c["start"] == 0) | (at(c["start"] - 1) == "\n")) & ((c["end"] == size) | (at(c["end"]) == "\n"))

    wide = F.transform(
        "cuts",
        lambda c: F.struct(
            F.when(whole(c) & (c["end"] == size) & (c["start"] > 0), c["start"] - 1).otherwise(c["start"]).alias("start"),
            F.when(whole(c) & (c["end"] < size), c["end"] + 1).otherwise(c["end"]).alias("end"),
        ),
    )
    rows = rows.withColumn("wide", wide)
    ends = F.concat(F.array(F.lit(0)), F.transform("wide", lambda c: c["end"]))
    starts = F.concat(F.transform("wide", lambda c: c["start"]), F.array(size))
    left = F.array_join(F.zip_with(ends, starts, lambda s, e: F.substring("text", s + 1, F.greatest(e - s, F.lit(0)))), "")
    none = F.array().cast("array<struct<start:int,end:int>>")
    cut = F.col("gone").isNotNull()
    rows = rows.select("row", F.when(cut, left).otherwise(F.col("text")).alias("left"), F.coalesce("cuts", none).alias("removed"))
    rows = rows.union(whole_rows.select("row", "text", none))
    columns = [F.col("left").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_removed", "removed")]
    return rows.select(*columns, F.size("removed").cast("long").alias("n_removed"), "removed")


def dedup_sql(min_words: int = MIN_WORDS) -> str:
    return f"""
with l as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
u as (select doc_id, i, lines[i] as line,
             coalesce(list_sum(list_transform(lines[1:i - 1], lambda x: length(x) + 1)), 0)::bigint as start
      from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from l)),
w as (select doc_id, i, start, start + length(line) as stop, {words_sql("line")} as w from u),
k as (select *, row_number() over (partition by array_to_string(w, ' ') order by doc_id nulls last, i) > 1 as gone
      from w where len(w) >= {min_words}),
g as (select doc_id, count(*) as n_units, count(*) filter (gone) as n_removed,
             coalesce(string_agg(start || '-' || stop, ',' order by start) filter (gone), '') as removed,
             list(i) filter (gone) as cut from k group by doc_id)
select l.doc_id, coalesce(n_units, 0)::bigint as n_units, coalesce(n_removed, 0)::bigint as n_removed,
       coalesce(removed, '') as removed,
       case when coalesce(n_removed, 0) = 0 then text
            else coalesce(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: not list_contains(cut, i)), lambda i: lines[i]), chr(10)), '') end as text
from l left join g using (doc_id)
"""
