"""N-gram Jaccard join by T-occurrence search over inverted lists of shingles.

A partner of a set of n shingles shares at least T of them.  As in DivideSkip, the n - T + 1 rarest
shingles are the short lists, which are merged: a partner occurs in at least one of them.  The other, long
lists are never read; a candidate's remaining shingles are probed by binary search.  As in PPJoin, the smaller
set of a linked pair has the shared shingle among fewer still, its first ones; lists that are first ones of no
set, or whose two sets differ too much in size, are dropped before anything is joined with them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortide.llm.components import connected_components
from cohortide.llm.scratch import bound_batches, broadcast_small, by_value, clear, keep
from cohortide.llm.substring_dedup import cells_of

by_value(__name__)

#: Shingles that get an order by frequency; all others count as equally rare.
COMMON = 1 << 19
#: Shingles that a task counts at once.
CHUNK = 1_000_000
#: Lists longer than this make their shingle a common one, and the short lists are chosen again.
LONG_LIST = 50_000
#: Times at most that every list picks a center, before all pairs left are compared.
CENTERS = 3
#: Pairs left for each member of a list at which they are compared without a further center.
PAIRS = 8
CACHE = 100_000
#: Bits at least, and bits for each shared shingle, of the table of cells by which lists are dropped before they are moved.
CELLS, WIDE = 1 << 20, 8
#: Classes of set sizes, in a circle, and the bit that tells that a list is among the first ones of a set.
CLASSES, FIRST = 60, 1 << 60
#: Columns with a set's parity in 256 cells.
SMALL = ("p0", "p1", "p2", "p3")

_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingles:
    """Sorted hashes of a text's distinct shingles of ``size`` words; a shorter text is one shingle."""

    def __init__(self, size: int = 3) -> None:
        self.size, self.cache = size, {}
        self.by = [_mix(_M[:1] * np.uint64(2 * i + 1))[0] | np.uint64(1) for i in range(size)]

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        try:
            h = np.array([cache[w] for w in words], np.uint64)
        except KeyError:
            digest = xxhash.xxh3_64_intdigest
            for w in set(words):
                if w not in cache:
                    cache[w] = digest(w)
            h = np.array([cache[w] for w in words], np.uint64)
        if len(h) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
        n = len(h) - self.size + 1
        total = h[:n] * self.by[0]
        for i in range(1, self.size):
            total = total + h[i : i + n] * self.by[i]
        return np.unique(_mix(total))


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shingles that a partner of a set of n must share with it."""
    return -(-n * percent // 100)


def first_ones(n: Column, percent: int) -> Column:
    """How many of the rarest shingles of a set of n hold one of every partner that is no smaller."""
    return n + 1 - F.ceil(n * (2 * percent) / (100 + percent))


def list_sizes(lists: DataFrame, percent: int) -> DataFrame:
    """token and k (sets) of all lists that can hold a linked pair.

    ``lists`` is (token, n, first).  The smaller set of a linked pair has the token among its first ones.  Linked sets
    are in one class of sizes or in neighbouring ones; a list's classes and whether it is a first one are one number,
    so little is shuffled.
    """
    # a little wider than the ratio of linked sizes, so that rounding parts no pair
    width = 1.001 * math.log(100 / percent) or 1.0
    bit = F.floor(F.log(F.col("n").cast("double")) / width) % CLASSES
    seen = F.expr("shiftleft(1L, cast(_bit as int))") + F.when(F.col("first"), FIRST).otherwise(0)
    sizes = lists.withColumn("_bit", bit).select("token", seen.alias("seen")).groupBy("token")
    sizes = sizes.agg(F.count("*").alias("k"), F.bit_or("seen").alias("seen")).filter((F.col("k") > 1) & (F.col("seen") >= FIRST))
    own = F.col("seen").bitwiseAND(FIRST - 1)
    next_ = F.shiftleft(own, 1).bitwiseOR(F.shiftright(own, CLASSES - 1))
    two = (F.bit_count(own) == 1) | (own.bitwiseAND(next_) != 0)
    return sizes.filter((F.col("k") > 2) | two).select("token", "k")


def shared_lists(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """node and token of the short lists whose token is in the cell of a shared one: nearly only those that are shared.

    The table of cells grows with the shared tokens, so about one other list in ten passes, however many there are.
    """
    cells = max(CELLS, 1 << (WIDE * shared.count()).bit_length())
    table = classes.sparkSession.sparkContext.broadcast(cells_of(shared.select(F.col("token").alias("h")), cells))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(table.value, np.uint8)
        for pdf in batches:
            if len(pdf):
                token = np.concatenate(pdf["short"].to_numpy())
                node = np.repeat(pdf["node"].to_numpy(), pdf["short"].map(len).to_numpy())
                cell = token % cells
                hit = (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
                yield pd.DataFrame({"node": node[hit], "token": token[hit]})

    return classes.select("node", "short").mapInPandas(run, "node long, token long")


def common_shingles(docs: DataFrame, size: int, most: int = COMMON) -> pd.DataFrame:
    """The most frequent shingles over all documents, at most ``most``, with their counts.

    Tasks count chunk by chunk and report what they see more than once; counts are added up over all
    tasks.  They only order the shingles: any order gives the same pairs.
    """

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingles, held, n = Shingles(size), [], 0

        def report() -> pd.DataFrame:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            more = times > 1
            return pd.DataFrame({"token": token[more].view(np.int64), "n": times[more]})

        for pdf in batches:
            for text in pdf["text"]:
                held.append(shingles(text))
                n += len(held[-1])
                if n >= CHUNK:
                    yield report()
                    held, n = [], 0
        if held:
            yield report()

    counts = docs.select("text").mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    shelf: list[str] = []
    counts = keep(counts.filter("n >= 8"), "common", shelf)
    # the least count that leaves at most so many
    steps = counts.groupBy(F.floor(8 * F.log2("n")).cast("int").alias("step")).agg(F.count("*").alias("k")).collect()
    floor, total = None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        if total + r["k"] > most:
            break
        floor, total = r["step"], total + r["k"]
    chosen = counts.filter(F.floor(8 * F.log2("n")) >= floor) if floor is not None else counts.limit(0)
    chosen = chosen.toPandas()
    clear(docs.sparkSession, shelf)
    return chosen


def document_sets(docs: DataFrame, common: pd.DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, key (hash of the text), n (shingles), node (digest of the set), bits (parity of the set in
    half as many cells, 512 at least, rounded up to a power of two), p0 to p3 (its parity in 256) and short
    (the shingles whose lists are merged) of every row."""
    common = common.sort_values("token")
    shared = docs.sparkSession.sparkContext.broadcast((common["token"].to_numpy().view(np.uint64), common["n"].to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(size)
        tokens, times = shared.value
        order = np.argsort(tokens)
        tokens, times = tokens[order], times[order]
        for pdf in batches:
            node, n, bits, small, short = [], [], [], [], []
            for text in pdf["text"]:
                h = shingles(text)
                n.append(len(h))
                if not len(h):
                    node.append(None), bits.append(None), small.append((0, 0, 0, 0)), short.append(None)
                    continue
                node.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                cells = max(512, 1 << (len(h) // 2).bit_length())
                parity = (np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)
                bits.append(np.packbits(parity).view(np.int64))
                small.append(np.bitwise_xor.reduce(bits[-1].reshape(-1, 4)))
                merge = len(h) - needed(len(h), percent) + 1
                at = np.minimum(np.searchsorted(tokens, h), max(len(tokens) - 1, 0))
                known = tokens[at] == h if len(tokens) else np.zeros(len(h), bool)
                rare = h[~known][:merge]
                if len(rare) < merge:
                    often = h[known]
                    rare = np.concatenate([rare, often[np.lexsort((often, times[at[known]]))][: merge - len(rare)]])
                short.append(rare.view(np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").astype(object), "key": pdf["key"], "n": n, "node": node, "bits": bits, **dict(zip(SMALL, np.array(small).reshape(-1, 4).T, strict=True)), "short": short})

    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return rows.mapInPandas(run, "doc_id long, key long, n long, node binary, bits array<long>, p0 long, p1 long, p2 long, p3 long, short array<long>")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _bits_fit(x: Column, y: Column, total: Column, percent: int) -> Column:
    """Cells of different parity are at most the shingles that one set has and the other lacks, and linked
    sets differ in at most (100 - percent) / (100 + percent) of both sizes.

    The larger of two bit arrays is folded onto the smaller, which keeps parity; arrays that would need
    a second fold pass.
    """
    xor = lambda a, b: a.bitwiseXOR(b)

    def fold(a: Column, to: Column) -> Column:
        n = F.size(to)
        return F.when(F.size(a) > n, F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, n + 1, n), xor)).otherwise(a)

    apart = F.aggregate(F.zip_with(fold(x, y), fold(y, x), xor), F.lit(0), lambda n, c: n + F.bit_count(c))
    near = F.greatest(F.size(x), F.size(y)) <= 2 * F.least(F.size(x), F.size(y))
    return ~near | (apart * (100 + percent) <= total * (100 - percent))


def _small_fit(total: Column, percent: int) -> Column:
    """The same test on 256 cells, columns p0 to p3 against the center's."""
    apart = F.lit(0)
    for c in SMALL:
        apart = apart + F.bit_count(F.col(c).bitwiseXOR(F.col(f"c.{c}")))
    return apart * (100 + percent) <= total * (100 - percent)


def probe(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sets link: the smaller one's shingles are looked up by binary search in the larger, rarest
    lists first read as they come, until the overlap is reached or out of reach."""
    if len(x) > len(y):
        x, y = y, x
    both = len(x) + len(y)
    least = -(-percent * both // (100 + percent))
    got = 0
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        got += int((y[np.minimum(np.searchsorted(y, part), len(y) - 1)] == part).sum())
        if got + len(x) - at - len(part) < least:
            return False
    return got >= least


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, kept: list[str]) -> DataFrame:
    """Of the pairs (u, v), those whose sets link.  Only texts of nodes in a pair are moved."""
    shelf: list[str] = []
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = keep(classes.join(nodes, "node", "left_semi").select("node", F.col("rep.doc_id").alias("_id"), F.col("rep.key").alias("_key")), "wanted", shelf)
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    small = broadcast_small(wanted)
    texts = rows.join(small, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
    texts = keep(texts, "texts", shelf)
    # a text that stands in several rows with one id is needed once
    repeated = texts.groupBy("node").agg(F.count("*").alias("k")).filter("k > 1").select("node")
    if not repeated.isEmpty():
        once = texts.join(repeated, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
        texts = keep(texts.join(repeated, "node", "left_anti").union(once), "texts", shelf)
    both = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
    both = both.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, last, center = Shingles(size), None, None
        for pdf in batches:
            yes = []
            for u, tu, tv in zip(pdf["u"], pdf["tu"], pdf["tv"], strict=True):
                if u != last:
                    last, center = u, shingles(tu)
                yes.append(probe(shingles(tv), center, percent))
            yield pdf.loc[yes, ["u", "v"]]

    links = keep(both.select("u", "v", "tu", "tv").mapInPandas(run, "u long, v long"), "links", kept)
    clear(docs.sparkSession, shelf)
    return links


def _with_labels(lists: DataFrame, links: DataFrame, shelf: list[str]) -> DataFrame:
    labels = connected_components(links, shelf)
    lists = lists.drop("label").join(labels, "node", "left")
    return lists.withColumn("label", F.coalesce("label", "node"))


def pairs_apart(full: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of members of one list that are in different components and may link.

    Both sides read the same columns of one table, so Spark shuffles it once for the two.
    """
    x, y = full.alias("x"), full.alias("y")
    fit = (F.col("x.label") < F.col("y.label")) & _sizes_fit(F.col("x.n"), F.col("y.n"), percent)
    fit = fit & _bits_fit(F.col("x.bits"), F.col("y.bits"), F.col("x.n") + F.col("y.n"), percent)
    return x.join(y, (F.col("x.token") == F.col("y.token")) & fit).select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))


def links_of(docs: DataFrame, classes: DataFrame, lists: DataFrame, size: int, percent: int, centers: int, kept: list[str]) -> DataFrame:
    """Links (u, v) between different sets that give the same components as all links.

    Every list first compares its members with a center, its set with the most copies.  Members that
    end in one component need no comparison with each other, so lists with a single component are done,
    as are centers, which have met all members.  After some rounds, or once few pairs are left, members
    of one list that are still in different components are compared pair by pair, none left out.
    """
    sets = classes.select("node", "bits")
    spark, links, before = docs.sparkSession, None, []
    for _ in range(centers):
        shelf: list[str] = []
        pick = lists.groupBy("token").agg(F.max(F.struct("copies", "node", "n", *SMALL)).alias("c"))
        met = lists.join(broadcast_small(keep(pick, "centers", shelf)), "token").filter(F.col("c.node") != F.col("node"))
        near = met.filter(_sizes_fit(F.col("n"), F.col("c.n"), percent) & _small_fit(F.col("n") + F.col("c.n"), percent))
        pairs = near.select(F.col("c.node").alias("u"), F.col("c.n").alias("un"), F.col("node").alias("v"), "n")
        pairs = keep(pairs.distinct(), "met", shelf)
        pairs = pairs.join(sets.select(F.col("node").alias("v"), F.col("bits").alias("bv")), "v")
        pairs = pairs.join(sets.select(F.col("node").alias("u"), F.col("bits").alias("bu")), "u")
        pairs = keep(pairs.filter(_bits_fit(F.col("bu"), F.col("bv"), F.col("n") + F.col("un"), percent)).select("u", "v"), "pairs", shelf)
        new = verified(pairs, docs, classes, size, percent, kept)
        links = links.union(new) if links is not None else new
        # a list of two has met its center and is done
        rest = _with_labels(met.filter("k > 2").withColumn("k", F.col("k") - 1).drop("c"), links, shelf)
        rest = keep(rest, "rest", shelf)
        several = rest.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a != b")
        lists = keep(rest.join(broadcast_small(keep(several.select("token"), "several", shelf)), "token", "left_semi"), "lists", now := [])
        clear(spark, shelf + before)
        before = now
        sizes = lists.groupBy("token", "label").agg(F.count("*").alias("m")).groupBy("token")
        sizes = sizes.agg(F.sum("m").alias("k"), F.sum(F.col("m") * F.col("m")).alias("own"))
        rows, apart = sizes.agg(F.sum("k"), F.sum((F.col("k") * F.col("k") - F.col("own")) / 2)).first()
        if not rows:
            return links
        if apart <= PAIRS * rows:
            break
    shelf = before
    full = keep(lists.join(sets, "node").select("token", "node", "n", "label", "bits"), "full", shelf)
    pairs = keep(pairs_apart(full, percent).distinct(), "pairs", shelf)
    new = verified(pairs, docs, classes, size, percent, kept)
    clear(spark, shelf)
    return links.union(new)


def ngram_join(docs: DataFrame, size: int = 3, percent: int = 90, text: str = "text", common: int = COMMON, long_list: int = LONG_LIST, centers: int = CENTERS) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles and component_id of every row.

    Two documents link when 100 |intersection| >= percent |union| of their sets of distinct shingles; a
    component is what links reach, its id the smallest doc_id in it.  A text with fewer words than
    a shingle is one shingle; null texts and ones without words have none and link with nothing.  Equal
    sets are one node, so copies cost nothing further.  Rows without id can link, but give no id; a row
    that links with nothing has its own.  Repeated rows each get a row; an empty table gives none.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    bound_batches(docs.sparkSession)
    spark, shelf = docs.sparkSession, []
    often = common_shingles(docs, size, common)
    while True:
        sets = keep(document_sets(docs, often, size, percent), "sets", own := [])
        rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
        classes = sets.filter("n > 0").groupBy(F.col("node").alias("digest"), "n")
        once = [F.first(c).alias(c) for c in ("bits", *SMALL, "short")]  # the same in all rows of a node
        classes = classes.agg(F.min(rank).alias("rep"), F.count("*").alias("copies"), *once)
        # a number of eight bytes for each set, fixed by writing it, stands for its digest from here on
        classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes", shelf)
        lists = classes.select("node", "n", F.posexplode("short").alias("at", "token"))
        sizes = list_sizes(lists.select("token", "n", (F.col("at") < first_ones(F.col("n"), percent)).alias("first")), percent)
        shared = keep(sizes, "shared", shelf)
        known = docs.sparkSession.createDataFrame(often[["token"]], "token long")
        long = shared.filter(F.col("k") > long_list).join(known, "token", "left_anti").orderBy(F.desc("k"), "token")
        new = long.limit(max(0, common - len(often))).select("token", F.col("k").alias("n")).toPandas()
        if not len(new):
            break
        clear(spark, shelf + own)
        shelf.clear()
        often = pd.concat([often, new], ignore_index=True)
    # the wide columns of all rows are not needed from here on
    rows = keep(sets.select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("node").alias("digest")), "rows")
    clear(spark, own)
    lists = shared_lists(classes, shared).join(broadcast_small(shared), "token")
    lists = keep(lists.join(classes.select("node", "n", "copies", *SMALL), "node"), "lists", now := [])
    classes = keep(classes.drop("short"), "slim", now)
    clear(spark, shelf)
    shelf = now
    links = links_of(docs, classes, lists, size, percent, centers, shelf)
    labels = connected_components(links, shelf)
    member = keep(classes.join(labels, "node").select("node", "digest", "label", F.col("rep.doc_id").alias("id")), "members", shelf)
    least = keep(member.groupBy("label").agg(F.min("id").alias("least")), "least", shelf)
    linked = keep(member.join(least, "label").select("node", "digest", "least"), "linked", shelf)
    alone = classes.join(linked.select("node"), "node", "left_anti").filter("copies > 1")
    groups = keep(linked.select("digest", "least").union(alone.select("digest", F.col("rep.doc_id").alias("least"))), "groups")
    clear(spark, shelf)
    return rows.join(groups, "digest", "left").select("doc_id", "key", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, joined: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with its id, once.

    Rows without id stay unless they link with one that has an id.
    """
    joined = keep(joined, "joined")
    gone = joined.filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = keep(gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "gone")
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.xxhash64(text))
    left = docs.join(broadcast_small(gone), same, "left_anti")
    twice = joined.groupBy("doc_id", "key").agg(F.count("*").alias("k")).filter("k > 1")
    twice = keep(twice.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")), "twice")
    if twice.isEmpty():
        return left
    small = broadcast_small(twice)
    once = left.join(small, same, "left_semi").withColumn("_text", F.xxhash64(text)).dropDuplicates(["doc_id", "_text"])
    return left.join(small, same, "left_anti").unionByName(once.drop("_text"))
