"""Spelling variants: vocabulary words one edit apart, by finite-state composition.

The pairs are those that acceptor, one-edit transducer and acceptor accept together.  Before the edit both
tapes read the same, so the composed machine is split by where it starts: states whose edit is still to
come, by the prefix read so far, and states whose edit lies within that prefix, by the rest that both tapes
must still read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortide.llm.scratch import bound_batches, by_value, clear, keep, partitions

by_value(__name__)

#: Letters of a word: ASCII and Latin-1.
RUN = "[A-Za-zÀ-ÿ]+"
#: Code points read before the vocabulary is split, and words of a part beyond which it is split further.
DEPTH, PART = 2, 10_000
#: Different words that a task counts at once, and pairs it hands over at once.
CHUNK, PAIRS = 200_000, 20_000
#: Stands for the edited code point; no letter.
GAP = "*"


def word_counts(docs: DataFrame, drop: int | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all runs of letters, A-Z lowered, over whole texts.

    With ``drop``, misprints are made: of a run for which it divides the crc32 of ``<doc>:<run>``, the code point
    at that number modulo the length goes.  A null id counts as an empty one, a null text has no words.
    """
    run = re.compile(RUN)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for pdf in batches:
            for name, whole in zip(pdf["doc"], pdf["text"], strict=True):
                found = Counter(run.findall(whole.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                if drop:
                    start = zlib.crc32(f"{name}:".encode())
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), start)
                        at = h % len(word)
                        held[word if h % drop else word[:at] + word[at + 1 :]] += n
                else:
                    held.update(found)
                if len(held) >= CHUNK:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    bound_batches(docs.sparkSession)
    rows = docs.filter(F.col(text).isNotNull())
    rows = rows.select(F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("doc"), F.col(text).alias("text"))
    counts = rows.mapInPandas(count, "word string, n long").filter("word <> ''")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """Minimal deterministic acceptor of sorted, different words; states are (final, {label: state})."""

    def __init__(self, words: list[str]) -> None:
        self.states: list[tuple[bool, dict[str, int]]] = []
        self._known: dict[tuple, int] = {}
        self._meets: dict[tuple[int, int], bool] = {}
        self._edits: dict[int, list[tuple[str, str]]] = {}
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]
        last = ""
        for word in words:
            same, most = 0, min(len(last), len(word))
            while same < most and last[same] == word[same]:
                same += 1
            self._close(path, last, same)
            path += [(False, {}) for _ in word[same:]]
            path[-1] = (True, path[-1][1])
            last = word
        self._close(path, last, 0)
        self.start = self._state(path[0])

    def _state(self, state: tuple[bool, dict[str, int]]) -> int:
        key = (state[0], tuple(state[1].items()))
        if key not in self._known:
            self._known[key] = len(self.states)
            self.states.append(state)
        return self._known[key]

    def _close(self, path: list[tuple[bool, dict[str, int]]], last: str, depth: int) -> None:
        """States of the last word below ``depth`` get no more edges: equal ones become one."""
        while len(path) > depth + 1:
            state = self._state(path.pop())
            path[-1][1][last[len(path) - 1]] = state

    def meets(self, p: int, q: int) -> bool:
        """Whether some rest is accepted from both states."""
        known, todo = self._meets, [(p, q)]
        while todo:
            a, b = pair = todo[-1]
            if pair not in known:
                (end, x), (also, y) = self.states[a], self.states[b]
                after = [(x[c], y[c]) for c in x if c in y]
                if a == b or (end and also) or any(known.get(z) for z in after):
                    known[pair] = True
                else:
                    ahead = [z for z in after if z not in known]
                    if ahead:
                        todo.append(ahead[0])
                        continue
                    known[pair] = False
            todo.pop()
        return known[p, q]

    def rests(self, p: int, q: int, but: str = "") -> Iterator[str]:
        """All rests accepted from both states, those that begin with ``but`` left out."""
        todo = [(p, q, "")]
        while todo:
            a, b, rest = todo.pop()
            if not self.meets(a, b):
                continue
            (end, x), (also, y) = self.states[a], self.states[b]
            if end and also:
                yield rest
            todo += [(x[c], y[c], rest + c) for c in x if c in y and (rest or c != but)]

    def edits(self, state: int) -> list[tuple[str, str]]:
        """Pairs of rests from a state that one edit turns into each other, at their first code point.

        Of equal neighbours the last is the one deleted, so that a pair has a single place of edit.
        """
        got = self._edits.get(state)
        if got is None:
            edges = self.states[state][1]
            got = [(a + r, b + r) for a, b in combinations(edges, 2) for r in self.rests(edges[a], edges[b])]
            got += [(a + r, r) for a in edges for r in self.rests(edges[a], state, a)]
            self._edits[state] = got
        return got

    def pairs(self) -> Iterator[tuple[str, str]]:
        """All pairs of accepted words one edit apart, each once."""
        todo = [(self.start, "")]
        while todo:
            state, read = todo.pop()
            for a, b in self.edits(state):
                yield read + a, read + b
            todo += [(to, read + c) for c, to in self.states[state][1].items()]


def _starts(low: int, high: int):
    """Rows (key, word, n) of the composed machine's start states: rests for edits at ``low`` to ``high`` - 1,
    and the prefix of ``high`` code points for later ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for word, n in zip(pdf["word"], pdf["n"], strict=True):
                size = len(word)
                out += [(word[:i] + GAP + word[i + 1 :], word, n) for i in range(low, min(high, size))]
                out += [(word[:i] + GAP + word[i:], word, n) for i in range(low, min(high, size + 1))]
                if size >= high:
                    out.append((word[:high], word, n))
            yield pd.DataFrame(out, columns=["key", "word", "n"])

    return run


def start_states(words: DataFrame, part: int, depth: int, shelf: list[str]) -> list[DataFrame]:
    """Tables (key, word, n) whose keys can be enumerated one by one: a key with a gap has at most one word for
    each letter, one without at most ``part`` words.  Prefixes with more words are read twice as far."""
    out, low, high, left = [], 0, depth, words
    while True:
        rows = keep(left.mapInPandas(_starts(low, high), "key string, word string, n long"), "starts", shelf)
        sizes = rows.filter(~F.contains(F.col("key"), F.lit(GAP))).groupBy("key").agg(F.count("*").alias("k"))
        large = keep(sizes.filter(F.col("k") > part).select("key"), "large", shelf)
        if large.isEmpty():
            return [*out, rows]
        out.append(rows.join(large, "key", "left_anti"))
        left = rows.join(large, "key", "left_semi").select("word", "n")
        low, high = high, 2 * high


def _gap_pairs(key: str, words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of words that differ at the gap; a shorter word has nothing there."""
    at = key.index(GAP)
    after = key[at + 1 : at + 2]
    for u, v in combinations(words, 2):
        long, short = (u, v) if len(u) >= len(v) else (v, u)
        if len(long) == len(short) or long[at] != after:
            yield u, v


def near_pairs(words: DataFrame, part: int = PART, depth: int = DEPTH, shelf: list[str] | None = None) -> DataFrame:
    """(word, near, near_n) of the words that differ by one inserted, deleted or replaced code point, both ways."""

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, dict[str, int]]]:
        rows = (r for pdf in batches for r in zip(pdf["key"], pdf["word"], pdf["n"], strict=True))
        for key, own in groupby(rows, lambda r: r[0]):
            yield key, {word: n for _, word, n in own}

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, names = [], ["word", "near", "near_n"]
        for key, n in groups(batches):
            if len(n) < 2:
                continue
            if GAP in key:
                found = _gap_pairs(key, list(n))
            else:
                found = ((key + a, key + b) for a, b in Acceptor([w[len(key) :] for w in n]).pairs())
            for u, v in found:
                out += [(u, v, n[v]), (v, u, n[u])]
                if len(out) >= PAIRS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    shelf = shelf if shelf is not None else []
    pairs = None
    for rows in start_states(words, part, depth, shelf):
        dealt = rows.repartition(partitions(words.sparkSession), "key").sortWithinPartitions("key", "word")
        new = dealt.mapInPandas(compose, "word string, near string, near_n long")
        pairs = new if pairs is None else pairs.union(new)
    return pairs


def follow(forms: DataFrame, shelf: list[str]) -> DataFrame:
    """(word, root): where the forms of forms end.  ``forms`` is (word, form) without circles; steps double."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        now = keep(now.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), "far"), "roots", shelf)
        if now.filter("far is not null").isEmpty():
            return now.select("word", "root")
        now = now.drop("far")


def group_variants(words: DataFrame, least: int = 3, shortest: int = 5, factor: int = 2, part: int = PART, depth: int = DEPTH) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of at least ``shortest`` code points that occur ``least`` times.

    ``words`` is (word, n), each word once.  A word's form is its most frequent near word (first in code-point
    order of equals), if that occurs at least ``factor`` times as often; factors above 1 rule out circles.  The root is where forms
    of forms end, the word itself without one.  Words hold no ``*``; null words and an empty table give no rows; further columns
    of ``words`` are left out.
    """
    shelf: list[str] = []
    wanted = (F.length("word") >= shortest) & (F.col("n") >= least)
    words = keep(words.filter(wanted).select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = near_pairs(words, part, depth, shelf).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left")

    def if_form(c: Column) -> Column:
        return F.when(-F.col("best.n") >= factor * F.col("n"), c)

    rows = keep(rows.select("word", if_form(F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), if_form(-F.col("best.n")).alias("form_n")), "forms")
    roots = keep(follow(rows.filter("form is not null"), shelf), "roots")
    clear(words.sparkSession, shelf)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
