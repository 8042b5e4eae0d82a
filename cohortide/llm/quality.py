"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortide.llm.scratch import bound_batches, by_value, received, send

by_value(__name__)

DIMS = 1 << 16
#: Rated documents of each grade that the model is fitted on, the first in hash order.
SAMPLE_PER_GRADE = 1500
#: Tokens whose features a task keeps at hand.
CACHE = 50_000

_UPPER, _LOWER, _DIGIT = re.compile("[A-ZÀ-Þ]+"), re.compile("[a-zß-￿]+"), re.compile("[0-9]+")


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIMS


class Features:
    """Hashed features of a text: its tokens, their shapes, how often tokens repeat, and its size."""

    def __init__(self) -> None:
        self.cache: dict[str, tuple[int, int]] = {}

    def token(self, token: str) -> tuple[int, int]:
        got = self.cache.get(token)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            shape = _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", token)))
            got = self.cache[token] = (_bucket("w " + token.lower()), _bucket("s " + shape))
        return got

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = text.split()
        n = len(tokens)
        if not n:
            return np.array([_bucket("empty")]), np.ones(1)
        counts = Counter(tokens)
        pairs = np.array([self.token(t) for t in counts], np.int64)
        part = np.fromiter(counts.values(), float, len(counts)) / n
        repeats = sum(map(eq, tokens, tokens[1:])) / n
        whole = [f"distinct {int(10 * len(counts) / n)} {min(n, 2000).bit_length()}", f"words {n.bit_length()}"]
        whole.append(f"repeats {int(10 * repeats)}")
        places = np.concatenate([pairs[:, 0], pairs[:, 1], [_bucket(x) for x in whole]])
        values = np.concatenate([np.sqrt(part), 3 * part, [0.5, 0.5, 1.0]])
        return places, values


@dataclass
class OrdinalModel:
    """P(grade > k) is the logistic of the text's score minus the k-th threshold; one weight vector for all k."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -50, 50)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, share: np.ndarray, n_grades: int, ridge: float = 2e-4, steps: int = 250) -> OrdinalModel:
    """Weighted maximum likelihood by Adam steps over all rows; ``share`` weighs each row.

    Without two different grades there is nothing to learn: weights are 0 and thresholds put all
    mass on the grade seen, or on the highest grade if there is none.
    """
    if len(set(grades.tolist())) < 2:
        seen = int(grades[0]) if len(grades) else n_grades - 1
        return OrdinalModel(np.zeros(DIMS), np.where(np.arange(n_grades - 1) < seen, -50.0, 50.0))
    used, flat = np.unique(np.concatenate([p for p, _ in rows]), return_inverse=True)
    values = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    share = share / share.sum()
    above = np.array([max((share * (grades > k)).sum(), 1e-6) for k in range(n_grades - 1)])
    above = np.minimum.accumulate(np.minimum(above, 1 - 1e-6))
    start = np.log((1 - above) / above)
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    w = np.concatenate([np.zeros(len(used)), start[:1], gaps])
    m, v = np.zeros_like(w), np.zeros_like(w)
    k = len(used)
    for step in range(1, steps + 1):
        cut = np.concatenate([[-np.inf], w[k] + np.concatenate([[0], np.cumsum(np.exp(w[k + 1 :]))]), [np.inf]])
        score = np.bincount(row, values * w[flat], len(rows))
        f = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        high, low = f(cut[grades + 1] - score), f(cut[grades] - score)
        high, low = np.where(grades == n_grades - 1, 1.0, high), np.where(grades == 0, 0.0, low)
        prob = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high), low * (1 - low)
        slope = share * (dh - dl) / prob  # of the loss by the score
        grad = np.zeros_like(w)
        grad[:k] = np.bincount(flat, values * slope[row], k) + ridge * w[:k]
        by_cut = np.zeros(n_grades - 1)
        np.add.at(by_cut, np.minimum(grades, n_grades - 2), np.where(grades < n_grades - 1, -share * dh / prob, 0))
        np.add.at(by_cut, np.maximum(grades - 1, 0), np.where(grades > 0, share * dl / prob, 0))
        grad[k] = by_cut.sum()
        after = np.cumsum(by_cut[::-1])[::-1]
        grad[k + 1 :] = after[1:] * np.exp(w[k + 1 :])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(DIMS)
    weights[used] = w[:k]
    return OrdinalModel(weights, w[k] + np.concatenate([[0], np.cumsum(np.exp(w[k + 1 :]))]))


def rated(labels: DataFrame) -> Column:
    """Grades of the labels table: 0 bad, 1 sound but toxic, 2 sound.  Null without a quality label."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0))
    return F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(toxic == 1, 1).otherwise(2))


def fit_quality(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, per_grade: int = SAMPLE_PER_GRADE, text: str = "text") -> OrdinalModel:
    """Fit on at most ``per_grade`` rated documents of each grade, weighted to the grades' shares.

    ``ratings``: doc_id and grade, 0 to ``n_grades - 1``; rows with null or other values are left out.
    """
    bound_batches(docs.sparkSession)
    ratings = ratings.filter(F.col("grade").between(0, n_grades - 1) & F.col("doc_id").isNotNull())
    ratings = ratings.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    counts = {r["grade"]: r["n"] for r in ratings.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(5))
    parts = [ratings.filter(F.col("grade") == g).orderBy(order, "doc_id").limit(per_grade) for g in counts]
    if not parts:
        return fit_ordinal([], np.array([], int), np.array([]), n_grades)
    sample = parts[0]
    for p in parts[1:]:
        sample = sample.union(p)
    # at most per_grade x n_grades ids: a bound set by parameters
    chosen = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for pdf in batches:
            made = [features(t or "") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "grade": pdf["grade"], "p": [p.astype(np.int32) for p, _ in made], "v": [v.astype(np.float32) for _, v in made]})

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
        grades = rows["grade"].to_numpy(int)
        held = Counter(grades.tolist())
        share = np.array([counts[g] / held[g] for g in grades.tolist()])
        model = fit_ordinal(list(zip(rows["p"], rows["v"], strict=True)), grades, share, n_grades)
        return pd.DataFrame({"weights": [model.weights], "thresholds": [model.thresholds]})

    # the sample, whose size is a parameter, meets in one task; the driver gets the weights alone
    rows = chosen.mapInPandas(vectors, "doc_id long, grade int, p array<int>, v array<float>")
    found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "weights array<double>, thresholds array<double>").collect()
    if not found:
        return fit_ordinal([], np.array([], int), np.array([]), n_grades)
    return OrdinalModel(np.array(found[0]["weights"]), np.array(found[0]["thresholds"]))


def score_quality(docs: DataFrame, model: OrdinalModel, text: str = "text", least: int = 1) -> DataFrame:
    """Add ``expected_grade``, ``tail`` (probability of grade ``least`` or more) and ``accepted`` (tail at
    least 1/2) to every row.

    Null and empty texts have one feature of their own; rows are scored one by one, so ties, copies and an
    empty table need no rule.  Input columns of those names are replaced.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("expected_grade", "tail", "accepted")
    weights = send(docs.sparkSession, model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features, model = Features(), received(weights)
        for texts in batches:
            scores = []
            for t in texts:
                p, v = features(t or "")
                scores.append(float(model.weights[p] @ v))
            tails = model.tails(np.array(scores, float))
            yield pd.DataFrame({"expected_grade": tails.sum(1), "tail": tails[:, least - 1]})

    scored = F.pandas_udf(score, "expected_grade double, tail double")
    rows = docs.withColumn("_s", scored(F.col(text)))
    return rows.select(*docs.columns, "_s.expected_grade", "_s.tail", (F.col("_s.tail") >= 0.5).alias("accepted"))
