"""Phrase collocations by dynamic itemset counting.

The texts are dealt into shards that are scanned in a circle.  Words are counted from the first shard on; a longer
phrase joins in after the scan in which both its subphrases (all words but the last, all but the first)
have reached the threshold, and is counted for exactly one full circle from there.  All lengths are counted in the same scans.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortide.llm.scratch import bound_batches, by_value, clear, keep, partitions

by_value(__name__)

#: Parts of a circle, and words of the longest phrase.
SHARDS, LONGEST = 3, 4
#: Cells of the tables that tasks get: when some phrase of the cell has reached the threshold.
CELLS = 1 << 23
#: Windows that a task counts at once, and words whose hashes it keeps at hand.
CHUNK, CACHE = 500_000, 100_000
#: Words of a language that a task counts at once by name, and phrases it holds before it hands them over.
NAMED, HELD = 500_000, 500_000
#: Tasks that name phrases, for each core.
WAVES = 2
NEVER = 255
#: Words of eight bytes that a filter of phrases has at least.
WORDS = 1 << 12
#: Ends a piece; no byte of UTF-8.
END = b"\xff"
#: Bytes of a text as they are counted: A-Z lowered, marks and line ends as ends of a piece, tabs as spaces.
_BYTES = bytes.maketrans(string.ascii_uppercase.encode() + b".,;:!?\n\x0b\x0c\r\t", string.ascii_lowercase.encode() + END * 10 + b" ")
_BY = (np.arange(1, LONGEST + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def words_of(text: str) -> list[bytes]:
    """The words of a text, with ``END`` between pieces and after the last one."""
    low = text.encode("utf-8", "surrogatepass").translate(_BYTES) + END
    return low.replace(END, b" " + END + b" ").split()


class Hashes:
    """Numbers of words, different for each language; 0 for the end of a piece."""

    def __init__(self) -> None:
        self.known: dict[str, dict[bytes, int]] = {}
        self.held = 0

    def __call__(self, lang: str, words: list[bytes]) -> np.ndarray:
        own = self.known.setdefault(lang, {END: 0})
        try:
            return np.fromiter(map(own.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if self.held > CACHE:
                self.known.clear()
                self.held, own = 0, self.known.setdefault(lang, {END: 0})
            seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
            new = {w: xxhash.xxh3_64_intdigest(w, seed) or 1 for w in set(words) if w not in own}
            own.update(new)
            self.held += len(new)
            return np.fromiter(map(own.__getitem__, words), np.uint64, len(words))


def phrase_keys(w: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the phrases of so many words that begin at places ``at``; a word is its own."""
    if size == 1:
        return w[at]
    h = np.full(len(at), size, np.uint64)
    for i in range(size):
        h += w[at + i] * _BY[i]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _cell(keys: np.ndarray, cells: int) -> np.ndarray:
    """The leading bits, so that the keys of a bucket have cells of their own."""
    return (keys >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def _windows(w: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, int]]:
    """Stretches of words to count at once, with the number of places where phrases begin."""
    for at in range(0, len(w), CHUNK):
        yield w[at : at + CHUNK + longest - 1], min(CHUNK, len(w) - at)


def _pack(keys: np.ndarray, n: np.ndarray, since: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted keys as differences, byte by byte: what is zero compresses away."""
    planes = lambda x: x.view(np.uint8).reshape(-1, 8).T.tobytes()
    return planes(np.diff(keys, prepend=np.uint64(0))), planes(n.astype(np.uint64)), since.astype(np.uint8).tobytes()


def _unpack(keys: bytes, n: bytes, since: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole = lambda x: np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(whole(keys)), whole(n).astype(np.int64), np.frombuffer(since, np.uint8)


def active_phrases(w: np.ndarray, n: int, step: int, shards: int, reached: dict[int, np.ndarray], longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a stretch of words: (length, sorted keys, counts, since) of the phrases counted in this step, by length and since.

    A phrase is counted in the ``shards`` steps after ``since``, when the cell of the later of its subphrases was reached, but not before
    that was counted itself.
    """
    since = np.where(w != 0, 0, NEVER).astype(np.int16)
    for size in range(1, longest + 1):
        if size > 1:
            if size - 1 not in reached or len(w) < size:
                return
            at = np.flatnonzero(since < NEVER)
            before = np.full(len(since), NEVER, np.int16)
            table = reached[size - 1]
            before[at] = np.maximum(table[_cell(phrase_keys(w, at, size - 1), len(table))], since[at])
            since = np.maximum(before[:-1], before[1:])
        own = since[:n]
        at = np.flatnonzero((own < step) & (own + shards >= step))
        if len(at):
            # a phrase has the same since wherever it stands, so each is counted by a plain sort
            keys, own = phrase_keys(w, at, size), own[at]
            for s in np.flatnonzero(np.bincount(own)):
                some = np.sort(keys[own == s])
                first = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
                yield size, some[first], np.diff(first, append=len(some)), np.full(len(first), s, own.dtype)


def _stretches(batches: Iterator[pd.DataFrame], longest: int) -> Iterator[tuple[np.ndarray, int]]:
    hashes, held, size = Hashes(), [], 0
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            held.append(hashes(lang, words_of(text)))
            size += len(held[-1])
            if size >= CHUNK:
                yield from _windows(np.concatenate(held), longest)
                held, size = [], 0
    if held:
        yield from _windows(np.concatenate(held), longest)


_STATE = "bucket int, size int, keys binary, n binary, since binary"
_COLUMNS = ["bucket", "size", "keys", "n", "since"]


def _scan(step: int, shards: int, buckets: int, cells: int, tables, longest: int) -> Callable:
    """Count the phrases that are active in this step; rows of packed keys for each bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reached = tables.value
        for w, n in _stretches(batches, longest):
            out = []
            for size, keys, counts, since in active_phrases(w, n, step, shards, reached, longest):
                ends = np.searchsorted(_cell(keys, cells) * buckets // cells, np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(ends)):
                    part = slice(ends[b], ends[b + 1])
                    out.append((int(b), size, *_pack(keys[part], counts[part], since[part])))
            if out:
                yield pd.DataFrame(out, columns=_COLUMNS)

    return run


def _merge(step: int, shards: int, buckets: int, cells: int, least: int) -> Callable:
    """Add up a bucket; note the cells that now reach the threshold; drop what ended its circle below it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, size = int(pdf["bucket"].iloc[0]), int(pdf["size"].iloc[0])
        parts = [_unpack(*r) for r in zip(pdf["keys"], pdf["n"], pdf["since"], strict=True)]
        keys, n, since = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        keys, n, since = keys[order], n[order], since[order]
        first = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]]))  # a bucket may have lost all its phrases
        keys, n, since = keys[first], np.add.reduceat(n, first), since[first]
        low, high = (-(-b * cells // buckets) for b in (bucket, bucket + 1))
        hit = np.zeros(high - low, bool)
        hit[_cell(keys[n >= least], cells) - low] = True
        stay = (n >= least) | (since.astype(int) + shards > step)
        packed = _pack(keys[stay], n[stay], since[stay])
        return pd.DataFrame([(bucket, size, *packed, low, np.packbits(hit).tobytes())], columns=[*_COLUMNS, "low", "hit"])

    return run


def _hits(state: DataFrame, cells: int) -> dict[int, np.ndarray]:
    """Cells with a phrase at the threshold, by length: a bit for each cell."""
    out: dict[int, np.ndarray] = {}
    for r in state.select("size", "low", "hit").toLocalIterator():
        bits = np.unpackbits(np.frombuffer(r["hit"], np.uint8)).astype(bool)
        mask = out.setdefault(r["size"], np.zeros(cells + 8, bool))
        mask[r["low"] : r["low"] + len(bits)] |= bits
    return {size: mask[:cells] for size, mask in out.items()}


def _marks(keys: np.ndarray) -> np.ndarray:
    """Three bits of a key's word in a filter."""
    one = np.uint64(1)
    return one << (keys & np.uint64(63)) | one << (keys >> np.uint64(6) & np.uint64(63)) | one << (keys >> np.uint64(12) & np.uint64(63))


def key_filters(state: DataFrame, words: int) -> dict[int, np.ndarray]:
    """By length, a filter of all keys of packed rows: three bits of one word for each.

    There are ``words`` words at least, and more than a quarter of the keys, so that one other key in a hundred or so
    passes however many phrases there are.
    """
    sizes = state.groupBy("size").agg(F.sum(F.length("since")).alias("k")).collect()
    many = {r["size"]: max(words, 1 << (r["k"] // 4).bit_length()) for r in sizes}

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, keys, n, since in zip(pdf["size"], pdf["keys"], pdf["n"], pdf["since"], strict=True):
                keys = _unpack(keys, n, since)[0]
                if len(keys):
                    at = _cell(keys, many[size])  # keys are sorted, and so are their words
                    first = np.flatnonzero(np.diff(at, prepend=-1))
                    own = np.zeros(at[-1] - at[0] + 1, np.uint64)
                    own[at[first] - at[0]] = np.bitwise_or.reduceat(_marks(keys), first)
                    yield pd.DataFrame({"size": [size], "low": [at[0]], "own": [own.tobytes()]})

    out = {size: np.zeros(k, np.uint64) for size, k in many.items()}
    for r in state.mapInPandas(part, "size int, low long, own binary").toLocalIterator():
        own = np.frombuffer(r["own"], np.uint64)
        out[r["size"]][r["low"] : r["low"] + len(own)] |= own
    return out


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    marks = _marks(keys)
    return table[_cell(keys, len(table))] & marks == marks


def frequent_cells(texts: DataFrame, least: int, shards: int = SHARDS, longest: int = LONGEST, cells: int = CELLS, buckets: int | None = None, log: list | None = None) -> dict[int, np.ndarray]:
    """Count in circles: filters of the phrases that occur ``least`` times, by length, for ``may_hold``.

    ``texts`` is (lang, text).  Each step scans one shard for phrases of all lengths that are active.  The driver holds
    a table of ``cells`` bytes for each length, however many phrases there are.  ``log`` gets (step, {length: phrases counted}).
    """
    spark = texts.sparkSession
    buckets = buckets or partitions(spark)
    shelf: list[str] = []
    dealt = keep(texts.withColumn("shard", F.pmod(F.xxhash64("lang", "text", F.monotonically_increasing_id()), F.lit(shards))), "shards", shelf, "shard", compression="zstd")
    reached: dict[int, np.ndarray] = {}
    state, step, before = None, 0, []
    while True:
        step += 1
        steps = {size: set(np.unique(r).tolist()) - {NEVER} for size, r in reached.items()}
        if step > shards and not any(s < step <= s + shards for size, own in steps.items() if size < longest for s in own):
            break
        tables = spark.sparkContext.broadcast(reached)
        rows = dealt.filter(F.col("shard") == (step - 1) % shards).select("lang", "text")
        rows = rows.mapInPandas(_scan(step, shards, buckets, cells, tables, longest), _STATE)
        if state is not None:
            rows = rows.union(state.select(*_COLUMNS))
        merged = rows.groupBy("bucket", "size").applyInPandas(_merge(step, shards, buckets, cells, least), _STATE + ", low int, hit binary")
        state = keep(merged, "phrases", now := [])
        hits = _hits(state, cells)
        clear(spark, before)
        before = now
        tables.destroy()
        for size, hit in hits.items():
            own = reached.setdefault(size, np.full(cells, NEVER, np.uint8))
            own[hit & (own == NEVER)] = step
        if log is not None:
            log.append((step, {r["size"]: r["k"] for r in state.groupBy("size").agg((F.sum(F.length("since"))).alias("k")).collect()}))
    found = key_filters(state, WORDS)
    clear(spark, shelf + before)
    return found


def _named(held: tuple, new: tuple, name: Callable[[np.ndarray], list[str]]) -> tuple:
    """Phrases held as (sorted keys, counts, names), with those of a stretch, (sorted keys, counts, places); ``name`` is asked
    for what is not held yet."""
    keys, counts, names = held
    more, times, places = new
    at = np.searchsorted(keys, more)
    known = np.zeros(len(more), bool)
    known[at < len(keys)] = keys[at[at < len(keys)]] == more[at < len(keys)]
    counts[at[known]] += times[known]
    fresh = np.empty(int((~known).sum()), object)
    fresh[:] = name(places[~known])
    return tuple(np.insert(x, at[~known], y) for x, y in ((keys, more[~known]), (counts, times[~known]), (names, fresh)))


def phrase_counts(texts: DataFrame, frequent: dict[int, np.ndarray]) -> DataFrame:
    """(lang, size, phrase, n) by words, not hashes, of all phrases that pass the filters; size 0 has all words of a language.

    Texts are ordered by language first, so that a phrase is handed over by the few tasks of its language and not by all.
    Each task that meets a phrase hands it over once, so there are no more tasks than keep all cores busy: they read
    batch by batch and hold ``HELD`` phrases, however long they are.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = shared.value
        hashes = Hashes()
        words: dict[str, tuple[list[bytes], list[np.ndarray]]] = {}
        held: dict[tuple[str, int], tuple] = {}
        total: dict[str, int] = {}

        def count(lang: str) -> None:
            said, parts = words.pop(lang)
            whole = np.concatenate(parts)
            total[lang] = total.get(lang, 0) + int((whole != 0).sum())
            for size in sorted(filters):
                inside = whole != 0
                for i in range(1, size):
                    inside = inside[:-1] & (whole[i:] != 0)
                at = np.flatnonzero(inside)
                keys = phrase_keys(whole, at, size)
                hit = may_hold(filters[size], keys)
                keys, at = keys[hit], at[hit]
                if len(keys):
                    order = np.argsort(keys)
                    keys, at = keys[order], at[order]
                    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                    new = keys[first], np.diff(first, append=len(keys)), at[first]
                    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
                    name = lambda at, size=size: [b" ".join(said[i : i + size]).decode("utf-8", "surrogatepass") for i in at.tolist()]
                    held[lang, size] = _named(held.get((lang, size), none), new, name)

        def handed() -> Iterator[pd.DataFrame]:
            for (lang, size), (_, n, names) in held.items():
                for i in range(0, len(n), 50_000):
                    yield pd.DataFrame({"lang": lang, "size": size, "phrase": names[i : i + 50_000], "n": n[i : i + 50_000]})
            held.clear()

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                said, parts = words.setdefault(lang, ([], []))
                own = words_of(text)
                said += own
                parts.append(hashes(lang, own))
                if len(said) >= NAMED:
                    count(lang)
                    if sum(len(x[0]) for x in held.values()) >= HELD:
                        yield from handed()
        for lang in list(words):
            count(lang)
        yield from handed()
        yield pd.DataFrame({"lang": list(total), "size": 0, "phrase": "", "n": list(total.values())})

    tasks = min(partitions(texts.sparkSession), WAVES * texts.sparkSession.sparkContext.defaultParallelism)
    dealt = texts.repartitionByRange(tasks, "lang", F.xxhash64(F.monotonically_increasing_id()))
    rows = dealt.mapInPandas(run, "lang string, size int, phrase string, n long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, absorb: int = 80, shards: int = SHARDS, cells: int = CELLS, lang: str = "lang", text: str = "text", log: list | None = None) -> DataFrame:
    """The ``top`` phrases of 2 to 4 words of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z is lowered; ``.,;:!?`` and line ends end a piece, spaces and tabs a word.  ``a`` counts all occurrences in
    pieces, at least ``least``; ``l`` and ``r`` those of the two parts at the cut with the lowest score
    floor(2000000 a / (l + r)), the first of equals; ``n`` all words of the language.  A phrase inside a longer
    one that has ``absorb`` percent of its occurrences is left out.  Order: score and a falling, phrase by bytes.

    A null language is ``und``, a null text has no words.  Copies count each for itself; an empty table gives no rows;
    further columns are ignored.  Hashes only choose the phrases; counts are of words.
    """
    bound_batches(docs.sparkSession)
    shelf: list[str] = []
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = phrase_counts(texts, frequent_cells(texts, least, shards, cells=cells, log=log))
    counts = keep(counts.filter((F.col("size") == 0) | (F.col("n") >= least)), "counts")
    known = counts.filter("size > 0")
    phrases = known.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    def part(start, size):
        return F.array_join(F.slice("w", start, size), " ")

    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("cast(a as decimal(20, 0)) * cast(2000000 as decimal(7, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the most frequent longer phrase around each shorter one
    inner = phrases.filter("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    inner = inner.groupBy("lang", part(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    scored = scored.join(inner, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") * F.lit(100).cast("decimal(3,0)"), F.lit(0)) < F.col("a") * F.lit(absorb).cast("decimal(3,0)"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counts.filter("size = 0").select("lang", "n")
    rows = best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    clear(docs.sparkSession, shelf)
    return rows


def collocations_sql(least: int = 30, top: int = 2000, absorb: int = 80) -> str:
    low = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    cut = "array_to_string(w[{}], ' ')"
    return f"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({low}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
t as (select lang, sum(len(w)) as n from w group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, range(1, 5) r(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as a from g group by all having count(*) >= {least}),
c as (select lang, k, phrase, a, string_split(phrase, ' ') as w from f where k > 1),
x as (select lang, k, phrase, a, j, {cut.format("1:j")} as lp, {cut.format("j + 1:k")} as rp from (select *, unnest(range(1, k)) as j from c)),
s as (select x.lang, x.phrase, x.a, j, fl.a as l, fr.a as r, ((2000000::hugeint * x.a) // (fl.a + fr.a))::bigint as score
      from x join f fl on fl.lang = x.lang and fl.phrase = lp join f fr on fr.lang = x.lang and fr.phrase = rp),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
i as (select lang, array_to_string(w[j:j + m - 1], ' ') as phrase, max(a) as longer
      from (select *, unnest(range(1, k - m + 2)) as j from (select *, unnest(range(2, k)) as m from c where k > 2)) group by all),
q as (select b.* from b left join i on i.lang = b.lang and i.phrase = b.phrase where coalesce(100 * longer::hugeint, 0) < {absorb} * a::hugeint)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n::bigint as n, score
from q join t using (lang) qualify rank <= {top}
"""
