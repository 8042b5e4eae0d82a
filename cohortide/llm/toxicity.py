"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted lists."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched, pairwise, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortide.llm.scratch import by_value, keep, received, send
from cohortide.llm.words import WORD

by_value(__name__)

#: Labelled documents of each class in the index, the first in hash order.
SAMPLE_PER_CLASS = 4000
#: Examples in a block, and terms with bounds that a search adds up first; it doubles them while too many examples are open.
BLOCK, STEP = 64, 96
#: Neighbours that vote, and the weight of the prior vote.
NEIGHBOURS, PRIOR = 15, 1.0
#: A term weighs at least this part of its TF-IDF, and half of it where the label's log odds are this many errors off.
LEAST, ERRORS = 0.001, 7.0
#: Sums of short floats are off by less than this.
SLACK = 1e-5
#: First letters of a word that make its term: at most 5, as they and the number of a text are sorted as 64 bits.
STEM = 5
#: Code points and texts whose words are cut at once.
CHUNK, CHUNK_TEXTS = 1 << 19, 1 << 12
#: Texts whose sums over common terms are held at once.
TOGETHER = 128
#: Lists of more than this part of the examples are held with a weight for every example.
COMMON = 0.1
#: A search compares what is open by their vectors once that is at most so many times the neighbours.
OPEN = 8

_STEM = re.compile(f"({WORD[:-1]}{{1,{STEM}}}){WORD[:-1]}*")
#: Bytes of words in lower case, any other byte as a space.
_BYTES = bytes(b if re.match(WORD, chr(b)) else 32 for b in bytes(range(256)).lower())
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(STEM + 1)], np.uint64)
_BEYOND_ASCII = np.uint64(sum(0x80 << 8 * k for k in range(STEM)))
_TEXT_BITS = np.uint64(24)


def _lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def stems(text: str) -> list[str]:
    """The words of a text by their first letters, so inflected and compound words share a term."""
    return _STEM.findall(_lower(text))


class Vectors:
    """Terms and their counts in texts, for a given vocabulary.

    Words of many texts are cut at once.  A term of ASCII is read as one number; of a word with other letters
    among its first bytes the term is cut from the decoded word.
    """

    def __init__(self, terms: dict[str, int]) -> None:
        self.terms = terms
        plain = [t for t in terms if t.isascii()]
        number = np.array([int.from_bytes(t.encode(), "little") for t in plain], np.uint64)
        order = np.argsort(number)
        self.number = np.append(number[order], np.uint64(2**64 - 1))
        self.place = np.array([terms[t] for t in plain], np.int64)[order]

    def chunks(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Terms and counts of consecutive texts, each text's terms in order, and where the texts begin and end in them."""
        some, size = [], 0
        for t in texts:
            if some and (size + len(t or "") > CHUNK or len(some) == CHUNK_TEXTS):
                yield self._count(some)
                some, size = [], 0
            some.append(t or "")
            size += len(some[-1])
        if some:
            yield self._count(some)

    def __call__(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Terms and counts of each text."""
        for edge, at, n in self.chunks(texts):
            for first, last in pairwise(edge.tolist()):
                yield at[first:last], n[first:last]

    def _count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        flat = b" ".join([b"", *coded, b" " * 8]).translate(_BYTES)
        inside = np.frombuffer(flat, np.uint8) != 32
        ends = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, length = ends[::2], ends[1::2] - ends[::2]
        begin = np.cumsum([1, *(len(c) + 1 for c in coded)])
        owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, begin)))
        eight = np.ndarray(len(flat) - 7, "<u8", flat, strides=(1,))
        number = eight[start] & _FIRST[np.minimum(length, STEM)]
        other = np.flatnonzero(number & _BEYOND_ASCII)
        plain = np.flatnonzero(number & _BEYOND_ASCII == 0)

        both = np.sort(number[plain] << _TEXT_BITS | owner[plain].astype(np.uint64))
        first = np.flatnonzero(np.diff(both, prepend=~both[:1]))
        n = np.diff(first, append=len(both))
        both = both[first]
        number = both >> _TEXT_BITS
        place = np.searchsorted(self.number, number)
        known = np.flatnonzero(self.number[place] == number)
        width = max(len(self.terms), 1)
        pair = (both[known] & ((np.uint64(1) << _TEXT_BITS) - np.uint64(1))).astype(np.int64) * width + self.place[place[known]]
        n = n[known]

        if len(other):
            words = [flat[a : a + b] for a, b in zip(start[other].tolist(), length[other].tolist(), strict=True)]
            term = {w: self.terms.get(w.decode("utf-8", "surrogatepass")[:STEM], -1) for w in set(words)}
            at = np.fromiter(map(term.get, words), np.int64, len(words))
            more, count = np.unique((owner[other] * width + at)[at >= 0], return_counts=True)
            pair, n = np.concatenate([pair, more]), np.concatenate([n, count])
        order = np.argsort(pair)
        pair = pair[order]
        return np.searchsorted(pair, np.arange(len(texts) + 1) * width), pair % width, n[order]


def _joined(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Several ranges of an array, one after the other."""
    return np.concatenate([values[:0], *(values[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True))])


@dataclass
class BlockIndex:
    """Vectors of labelled documents, as they are (``forward``, ``term``, ``weight``) and as inverted lists
    (``lists``, ``row``, ``held``), with the largest weight of each list (``peak``).  Lists of ``common`` terms are
    rows of ``full``.  Another list of more examples than there are blocks is ``bound`` to a row of ``most``, its
    largest weight in each block; shorter lists take no more work than such a row."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    share: np.ndarray
    base: float
    forward: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    lists: np.ndarray
    row: np.ndarray
    held: np.ndarray
    common: np.ndarray
    full: np.ndarray
    bound: np.ndarray
    most: np.ndarray
    peak: np.ndarray
    scale: tuple[float, float] = (0.0, 1.0)

    def __post_init__(self) -> None:
        self.asked = np.zeros(len(self.idf))

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a text, of length 1."""
        return _unit(at, n, self.idf)

    def cosines(self, at: np.ndarray, w: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Cosines of some examples, from their own vectors."""
        asked = self.asked
        asked[at] = w
        first, last = self.forward[rows], self.forward[rows + 1]
        owner = np.repeat(np.arange(len(rows)), last - first)
        got = np.bincount(owner, asked[_joined(self.term, first, last)] * _joined(self.weight, first, last), len(rows))
        asked[at] = 0
        return np.round(got, 9)  # equal texts tie whatever the order of sums

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above 0, ties to smaller ids, exactly; ``leave`` is no candidate."""
        return next(self.search([(at, w)], k, [leave]))

    def search(self, vectors: Iterable[tuple], k: int, leave: Iterable[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` for several texts: lists of common terms are added up for ``TOGETHER`` texts by one product."""
        leave = repeat(-1) if leave is None else iter(leave)
        for some in batched(vectors, TOGETHER):
            asked = np.zeros((len(some), len(self.full)), np.float32)
            for row, (at, w) in zip(asked, some, strict=True):
                common = self.common[at]
                row[common[common >= 0]] = w[common >= 0]
            for total, (at, w) in zip(asked @ self.full, some, strict=True):
                yield self._nearest(at, w, k, next(leave), total.astype(float))

    def _nearest(self, at: np.ndarray, w: np.ndarray, k: int, leave: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add up the other lists, first those without bounds, then in the order of what they could give.

        An example stays open while its sum so far and the largest weights in its block of the lists not yet
        added could reach the k-th sum; once few are open, or all lists are added, those are compared by
        their vectors.
        """
        n = len(self.ids)
        whole = at, w
        rare = self.common[at] < 0
        at, w = at[rare], w[rare]
        free = self.bound[at] < 0
        order = np.argsort(np.where(free, -np.inf, -w * self.peak[at]), kind="stable")
        at, w = at[order], w[order]
        few = np.count_nonzero(free)
        most, part = self.most[self.bound[at[few:]]], w[few:].astype(np.float32)
        begin, end = self.lists[at], self.lists[at + 1]
        done, last, step = 0, few + STEP, STEP
        while True:
            now = slice(done, last)
            held = np.repeat(w[now], end[now] - begin[now])
            held *= _joined(self.held, begin[now], end[now])
            total += np.bincount(_joined(self.row, begin[now], end[now]), held, n)
            if leave >= 0:
                total[leave] = 0
            floor = np.partition(total, n - k)[n - k] if n >= k else 0.0
            if last >= len(at):
                open_ = np.flatnonzero((total > 0) & (total >= floor - SLACK))
                break
            rest = part[last - few :] @ most[last - few :]
            open_ = np.flatnonzero(total + np.repeat(rest, BLOCK)[:n] >= floor - SLACK)
            if len(open_) <= OPEN * k:
                break
            step *= 2
            done, last = last, last + step
        open_ = open_[open_ != leave]
        cos = self.cosines(*whole, open_)
        best = np.lexsort((self.ids[open_], -cos))[:k]
        best = best[cos[best] > 0]
        return open_[best], cos[best]

    def vote(self, rows: np.ndarray, cos: np.ndarray) -> float:
        """Share of toxic votes; each neighbour counts by cosine and by the documents it stands for."""
        v = cos * self.share[rows]
        return float((v @ self.toxic[rows] + PRIOR * self.base) / (v.sum() + PRIOR))

    def calibrated(self, vote: float) -> float:
        a, b = self.scale
        return float(1 / (1 + np.exp(-(a + b * np.log(vote / (1 - vote))))))


def _unit(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = (1 + np.log(n)) * idf[at]
    norm = np.sqrt(w @ w)
    return (at, w / norm) if norm > 0 else (at[:0], w[:0])


def informed(idf: np.ndarray, clean: np.ndarray, toxic: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """IDF of every term times what the term tells of the label: z^2 / (z^2 + ERRORS^2), z the difference of its log odds
    in the two classes over its standard error; never below ``LEAST``, so that no term is without weight."""
    odds = np.log((toxic + 0.5) / (n1 - toxic + 0.5)) - np.log((clean + 0.5) / (n0 - clean + 0.5))
    error = 1 / (toxic + 0.5) + 1 / (n1 - toxic + 0.5) + 1 / (clean + 0.5) + 1 / (n0 - clean + 0.5)
    z2 = odds * odds / error
    return idf * (LEAST + (1 - LEAST) * z2 / (z2 + ERRORS**2))


def _numbered(some: np.ndarray) -> np.ndarray:
    """Numbers from 0 on for what is chosen, -1 for the rest."""
    return np.where(some, np.cumsum(some) - 1, -1).astype(np.int32)


def build_index(
    terms: dict[str, int],
    idf: np.ndarray,
    examples: list[tuple[int, int, np.ndarray, np.ndarray]],
    totals: dict[int, int],
) -> BlockIndex:
    """Index examples (id, toxic, terms, counts).  Those with the same strongest term stand together, so that few
    blocks hold large weights of it."""
    units = [_unit(np.asarray(at, np.int64), np.asarray(n, float), idf) for _, _, at, n in examples]
    strongest = [int(at[w.argmax()]) if len(at) else -1 for at, w in units]
    order = sorted(range(len(examples)), key=lambda i: (examples[i][1], strongest[i], examples[i][0]))
    ids = np.array([examples[i][0] for i in order], np.int64)
    toxic = np.array([examples[i][1] for i in order], float)
    forward = np.concatenate([[0], np.cumsum([len(units[i][0]) for i in order])]).astype(np.int64)
    term = np.concatenate([units[i][0] for i in order] or [np.zeros(0)]).astype(np.int32)
    weight = np.concatenate([units[i][1] for i in order] or [np.zeros(0)]).astype(np.float32)
    row = np.repeat(np.arange(len(order), dtype=np.int32), np.diff(forward))
    by_term = np.argsort(term, kind="stable")  # rows stay in order within a list
    listed, row, held = term[by_term], row[by_term], weight[by_term]
    count = np.bincount(term, minlength=len(terms))
    common = _numbered(count > COMMON * len(order))
    full = np.zeros((common.max(initial=-1) + 1, len(order)), np.float32)
    dense = common[listed] >= 0
    full[common[listed[dense]], row[dense]] = held[dense]
    listed, row, held = listed[~dense], row[~dense], held[~dense]
    blocks = -(-len(order) // BLOCK)
    bound = _numbered((common < 0) & (count > blocks))
    most = np.zeros((bound.max(initial=-1) + 1, blocks), np.float32)
    long = bound[listed] >= 0
    np.maximum.at(most, (bound[listed[long]], row[long] // BLOCK), held[long])
    lists = np.searchsorted(listed, np.arange(len(terms) + 1))
    peak = np.zeros(len(terms), np.float32)
    np.maximum.at(peak, term, weight)
    share = np.where(toxic == 1, totals[1] / max(toxic.sum(), 1), totals[0] / max((1 - toxic).sum(), 1))
    return BlockIndex(
        terms, idf, ids, toxic, share / share.mean(), totals[1] / (totals[0] + totals[1]),
        forward, term, weight, lists, row, held, common, full, bound, most, peak,
    )


def _platt(votes: np.ndarray, toxic: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Logistic fit of the labels on the log odds of left-out votes, with a small ridge, to the end."""
    x = np.column_stack([np.ones(len(votes)), np.log(votes / (1 - votes))])

    def loss(w: np.ndarray) -> float:
        m = x @ w
        return float(share @ (np.logaddexp(0, m) - toxic * m) + 5e-3 * ((w - [0, 1]) ** 2).sum())

    w = np.array([0.0, 1.0])
    while True:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (share * (p - toxic)) + 1e-2 * (w - [0, 1])
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step, now = np.linalg.solve(h, g), loss(w)
        # strictly convex: halved steps get lower until the minimum is reached as far as numbers go
        while np.abs(step).max() > 1e-9 and loss(w - step) >= now:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            return float(w[0]), float(max(w[1], 1e-3))
        w = w - step


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, text: str = "text") -> BlockIndex | float:
    """Index at most ``per_class`` labelled documents of each class by all their terms; inverse document frequencies
    are of all documents.  ``labels``: doc_id, toxic (0 or 1); other values are left out.  Of rows that share an
    id the smallest text counts.

    Without labels of both classes the result is the share of toxic labels, 0 without any.
    """
    spark = docs.sparkSession
    labels = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return float(totals.get(1, 0) > 0)
    order = F.xxhash64("doc_id", F.lit(7))
    sample = labels.filter("toxic = 0").orderBy(order, "doc_id").limit(per_class)
    sample = sample.union(labels.filter("toxic = 1").orderBy(order, "doc_id").limit(per_class))
    # at most 2 x per_class ids: a bound set by parameters
    texts = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    chosen = keep(chosen, "examples")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(pdf["text"], pdf["toxic"], strict=True):
                seen[y].update(set(stems(t)))
            every = list({*seen[0], *seen[1]})
            if every:
                yield pd.DataFrame({"term": every, "clean": [seen[0][x] for x in every], "toxic": [seen[1][x] for x in every]})

    counts = chosen.mapInPandas(tally, "term string, clean long, toxic long").groupBy("term")
    known = counts.agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).orderBy("term").toPandas()
    terms = {t: i for i, t in enumerate(known["term"])}
    vocabulary = send(spark, terms)

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, rows = Vectors(received(vocabulary)), 0
        seen = np.zeros(len(vectors.terms), np.int64)
        for pdf in batches:
            rows += len(pdf)
            for _, at, _ in vectors.chunks(pdf["text"]):
                seen += np.bincount(at, minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pd.DataFrame({"term": [-1, *some], "n": [rows, *seen[some]]})

    every = texts.select("text").mapInPandas(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n_docs = int(every.loc[every["term"] < 0, "n"].sum())
    df = np.zeros(len(terms))
    some = every[every["term"] >= 0]
    df[some["term"]] = some["n"]
    idf = np.log((n_docs + 1) / (df + 1)) + 1e-3

    def vectors_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = Vectors(received(vocabulary))
        for pdf in batches:
            got = list(vectors(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "p": [p for p, _ in got], "n": [n for _, n in got]})

    rows = chosen.mapInPandas(vectors_of, "doc_id long, toxic int, p array<int>, n array<int>").toPandas()
    n0, n1 = (float((rows["toxic"] == y).sum()) for y in (0, 1))
    idf = informed(idf, known["c"].to_numpy(float), known["t"].to_numpy(float), n0, n1)
    index = build_index(terms, idf, list(rows.itertuples(index=False, name=None)), totals)
    vocabulary.destroy()
    whole = send(spark, index)

    def left_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = received(whole)
        for pdf in batches:
            own = [slice(index.forward[i], index.forward[i + 1]) for i in pdf["id"]]
            vectors = [(index.term[x], index.weight[x].astype(float)) for x in own]
            out = [index.vote(*found) for found in index.search(vectors, NEIGHBOURS, pdf["id"])]
            yield pd.DataFrame({"id": pdf["id"], "vote": out})

    votes = spark.range(0, len(rows), 1, 16).mapInPandas(left_out, "id long, vote double").toPandas().sort_values("id")
    whole.destroy()
    index.scale = _platt(votes["vote"].to_numpy(), index.toxic, index.share)
    return index


def score_toxicity(docs: DataFrame, index: BlockIndex | float, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1), ``predicted`` (1 from 1/2 on), ``evidence`` (ids of the nearest examples) and
    ``cosines`` to every row.

    Only the text counts.  Null and empty texts, and ones without any term, have no neighbours and get
    the calibrated prior.  Rows are scored one by one, so ties, copies and an empty table need no
    rule.  Input columns of the names above are replaced.
    """
    docs = docs.drop("score", "predicted", "evidence", "cosines")
    shared = send(docs.sparkSession, index)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = received(shared)
        vectors = None if isinstance(index, float) else Vectors(index.terms)
        for texts in batches:
            copies: dict[str | None, tuple] = dict.fromkeys(texts, (index, [], []))
            if vectors:
                asked = (index.vector(at, n) for at, n in vectors(copies))
                for t, (rows, cos) in zip(copies, index.search(asked, NEIGHBOURS), strict=True):
                    copies[t] = index.calibrated(index.vote(rows, cos)), index.ids[rows], cos
            yield pd.DataFrame([copies[t] for t in texts], columns=["score", "evidence", "cosines"])

    scored = F.pandas_udf(score, "score double, evidence array<long>, cosines array<double>")
    rows = docs.withColumn("_s", scored(F.col(text)))
    predicted = F.when(F.col("_s.score") >= 0.5, 1).otherwise(0).alias("predicted")
    return rows.select(*docs.columns, "_s.score", predicted, "_s.evidence", "_s.cosines")
