"""Exact top-k by inner product: dual-tree search over cover trees of queries and data."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortide.llm.scratch import by_value, keep, received, send

by_value(__name__)

#: Rows of a data block and of a query block; a pair of blocks is searched in one task.
DATA_BLOCK, QUERY_BLOCK = 4096, 4096
#: At most so many cells, each the data rows nearest to one pivot; larger cells have several blocks.
PIVOTS = 1024
#: Rows that a tree no longer divides, children of a node, and ratio of covering radii from level to level.
LEAF, FAN_OUT, BASE = 512, 8, 1.4


@dataclass
class Node:
    """Points ``rows`` within ``radius`` of ``center``; children cover parts of them at a smaller radius."""

    rows: np.ndarray
    center: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)

    @property
    def norm(self) -> float:
        return float(np.sqrt(self.center @ self.center))


def cover_tree(points: np.ndarray) -> Node:
    """A tree over all rows of ``points``.

    Each node's center is one of its points, and its first child keeps that center.  Further centers are
    the points farthest from all centers so far, until every point is within the next level's
    radius or the fan-out is reached; radii are then the real distances covered.
    """

    points = points.astype(float)

    def node(rows: np.ndarray, center: np.ndarray) -> Node:
        away = points[rows] - center
        return Node(rows, center, float(np.sqrt(max((away * away).sum(1).max(), 0.0))))

    root = node(np.arange(len(points)), points[0])
    todo = [root]
    while todo:
        top = todo.pop()
        if len(top.rows) <= LEAF or top.radius == 0:
            continue
        own = points[top.rows]
        near = ((own - top.center) ** 2).sum(1)
        belongs, centers = np.zeros(len(own), np.int64), [top.center]
        while len(centers) < FAN_OUT and near.max() > (top.radius / BASE) ** 2:
            centers.append(own[near.argmax()])
            gap = ((own - centers[-1]) ** 2).sum(1)
            belongs[gap < near] = len(centers) - 1
            near = np.minimum(gap, near)
        if len(centers) == 1:
            continue
        top.children = [node(top.rows[belongs == c], centers[c]) for c in range(len(centers)) if (belongs == c).any()]
        if len(top.children) == 1:
            top.children = []
        todo += top.children
    return root


def _bound(q: Node, r: Node) -> float:
    """No point of q has a higher inner product with a point of r; the slack covers rounding."""
    value = q.center @ r.center + q.radius * r.norm + r.radius * q.norm + q.radius * r.radius
    return value + _slack((q.norm + q.radius) * (r.norm + r.radius))


def _slack(size: float | np.ndarray) -> float | np.ndarray:
    """More than rounding can do to sums of products of that size."""
    return 1e-9 * (1 + size)


def dual_search(
    queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """For each query the scores and ids of its k best data rows but its own, best first, ties to smaller
    ids; places without a row hold the lowest number.  Pairs of nodes are skipped when their bound is below the worst
    k-th score of the query node; ``floor`` are k-th scores that the queries have from elsewhere, and rows below may be
    left out.  Integers stay integers, so their products are exact up to 63 bits."""
    none = -np.inf if queries.dtype.kind == "f" else -np.iinfo(np.int64).max
    score = np.full((len(queries), k), none)
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    ident = np.full((len(queries), k), np.iinfo(np.int64).max)
    todo = [(np.inf, cover_tree(queries), cover_tree(data))]

    def compare(q: Node, r: Node) -> None:
        got = queries[q.rows] @ data[r.rows].T
        got[query_ids[q.rows][:, None] == data_ids[r.rows][None, :]] = none
        better = np.flatnonzero((got.max(1) >= score[q.rows, -1]) & (got.max(1) >= floor[q.rows]))  # the others keep what they have
        if not len(better):
            return
        at, got = q.rows[better], got[better]
        ids = np.broadcast_to(data_ids[r.rows], got.shape)
        if got.shape[1] > k:  # all that reach the k-th best of the node, its ties included
            edge = np.partition(got, got.shape[1] - k, 1)[:, got.shape[1] - k, None]
            wide = int((got >= edge).sum(1).max())
            pick = np.argpartition(-got, wide - 1, 1)[:, :wide] if wide < got.shape[1] else np.arange(got.shape[1])[None, :].repeat(len(got), 0)
            got, ids = np.take_along_axis(got, pick, 1), np.take_along_axis(ids, pick, 1)
        both = np.concatenate([score[at], got], 1)
        ids = np.concatenate([ident[at], ids], 1)
        best = np.lexsort((ids, -both), axis=1)[:, :k]
        score[at] = np.take_along_axis(both, best, 1)
        ident[at] = np.take_along_axis(ids, best, 1)

    # depth first, the most promising pair on top, so that k-th scores rise early
    while todo:
        bound, q, r = todo.pop()
        if bound < np.maximum(score[q.rows, -1], floor[q.rows]).min():
            continue
        if not q.children and not r.children:
            compare(q, r)
            continue
        wide = r.children and (not q.children or r.radius >= q.radius)
        pairs = [(q, x) for x in r.children] if wide else [(x, r) for x in q.children]
        todo += sorted(((_bound(a, b), a, b) for a, b in pairs), key=lambda p: p[0])
    return score, ident


@dataclass
class Cells:
    """Pivots by vector length: their numbers and places, and how far the rows of each cell reach.

    Rows of a length without pivots share cell -1 around 0."""

    number: dict[int, np.ndarray]
    center: dict[int, np.ndarray]
    radius: dict[tuple[int, int], float] = field(default_factory=dict)

    def of(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        return self.number.get(dim, np.array([-1])), self.center.get(dim, np.zeros((1, dim)))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and the distance to its pivot."""
        number, center = self.of(x.shape[1])
        best = ((center**2).sum(1) - 2 * x @ center.T).argmin(1)
        return number[best], np.sqrt(((x - center[best]) ** 2).sum(1))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells with rows, and a score that no row of a cell exceeds, for each query."""
        number, center = self.of(x.shape[1])
        radius = np.array([self.radius.get((x.shape[1], int(c)), -1.0) for c in number])
        number, center, radius = number[radius >= 0], center[radius >= 0], radius[radius >= 0]
        norm = np.sqrt((x * x).sum(1))[:, None]
        return number, x @ center.T + norm * radius + _slack(norm * (np.sqrt((center**2).sum(1)) + radius))


def choose_pivots(rows: list[tuple[int, list[int]]]) -> Cells:
    """Cells around (length, vector) pairs; equal vectors make one."""
    by_dim: dict[int, list[tuple[int, ...]]] = {}
    for dim, v in rows:
        if tuple(v) not in by_dim.setdefault(dim, []):
            by_dim[dim].append(tuple(v))
    return Cells({d: np.arange(len(c)) for d, c in by_dim.items()}, {d: np.array(c, float) for d, c in by_dim.items()})


def _by_dim(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, at in pdf.groupby("dim").indices.items():
        yield at, np.stack(pdf["v"].iloc[at]).astype(float)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    scale: float = 64.0,
    data_block: int = DATA_BLOCK,
    query_block: int = QUERY_BLOCK,
    pivots: int = PIVOTS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (integer inner product) of each query's k best rows.

    Both tables have vec_id and embedding; components become floor(scale x).  Data rows go to the cell of their nearest
    pivot, the first rows in hash order.  A query is first searched in the cell whose bound is highest, then, with
    the k-th score found there, in the other cells whose bound reaches it.  Blocks of a cell's queries
    and rows meet pair by pair; a pair is searched in one task.  A query's own id is never its result.  Rows with a null id, vector or
    component, or with a component that isn't finite, take no part, and only vectors of the same
    length are compared.  Rows that share an id count once, with the smallest vector.  Results
    are exact as far as scores fit 63 bits; equal scores go to the smaller id.  Empty tables give no rows, other columns play no part.
    The pivots and one radius for each cell and length come to the driver.
    """

    def clean(df: DataFrame) -> DataFrame:
        whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
        sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(sound & (F.size("embedding") > 0))
        return rows.groupBy("vec_id").agg(F.min(whole).alias("v")).withColumn("dim", F.size("v"))

    spark = vectors.sparkSession
    data, asked = keep(clean(vectors), "vectors"), keep(clean(queries), "asked")
    n_cells = min(pivots, max(1, -(-data.count() // data_block)))
    first = data.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").select("dim", "v").limit(n_cells)
    cells = choose_pivots([(r["dim"], r["v"]) for r in first.collect()])
    around = send(spark, cells)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = received(around)
        for pdf in batches:
            cell, away = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
            for at, x in _by_dim(pdf):
                cell[at], away[at] = cells.nearest(x)
            yield pdf.assign(cell=cell, away=away)

    row = "vec_id long, v array<long>, dim int"
    data = keep(data.mapInPandas(place, f"{row}, cell long, away double"), "cells")
    sizes = data.groupBy("dim", "cell").agg(F.ceil(F.count("*") / data_block).alias("parts"), F.max("away").alias("radius"))
    sizes = keep(sizes, "sizes")
    cells.radius = {(r["dim"], r["cell"]): r["radius"] for r in sizes.collect()}
    reach = send(spark, cells)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = received(reach)
        for pdf in batches:
            cell = np.full(len(pdf), -2)
            for at, x in _by_dim(pdf):
                number, bound = cells.bounds(x)
                if len(number):
                    cell[at] = number[bound.argmax(1)]
            yield pdf.assign(cell=cell, floor=-np.inf)[cell > -2]

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = received(reach)
        for pdf in batches:
            for at, x in _by_dim(pdf):
                number, bound = cells.bounds(x)
                part = pdf.iloc[at]
                reached = (bound >= part["floor"].to_numpy()[:, None]) & (number != part["cell"].to_numpy()[:, None])
                for c in np.flatnonzero(reached.any(0)):
                    yield part[reached[:, c]].assign(cell=number[c])

    def search(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        left, right, ids = np.stack(q["v"]), np.stack(d["v"]), q["vec_id"].to_numpy()
        longest = [np.sqrt((x.astype(float) ** 2).sum(1).max()) for x in (left, right)]
        if longest[0] * longest[1] < 2**53:  # products and their sums are whole numbers that doubles hold
            left, right = left.astype(float), right.astype(float)
        score, ident = dual_search(left, ids, right, d["vec_id"].to_numpy(), k, q["floor"].to_numpy())
        at, place = np.nonzero(score > (-np.inf if left.dtype.kind == "f" else -np.iinfo(np.int64).max))
        return pd.DataFrame({"query_id": ids[at], "vec_id": ident[at, place], "score": score[at, place].astype(np.int64)})

    hashed = F.xxhash64("vec_id")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cell = ["dim", "cell"]

    def meet(q: DataFrame) -> DataFrame:
        blocks = q.groupBy(*cell).agg(F.ceil(F.count("*") / query_block).alias("blocks")).join(sizes.select(*cell, "parts"), cell)
        left = q.join(blocks, cell).select("vec_id", "v", "floor", *cell, F.pmod(hashed, "blocks").alias("qb"), every("parts").alias("db"))
        right = data.join(blocks, cell).select("vec_id", "v", *cell, every("blocks").alias("qb"), F.pmod(hashed, "parts").alias("db"))
        key = [*cell, "qb", "db"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    at_home = keep(asked.mapInPandas(home, f"{row}, cell long, floor double"), "home")
    found = keep(best(meet(at_home)).drop("rank"), "found")
    score = F.col("score").cast("double")
    last = best(found).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (score - 1e-9 * (1 + F.abs(score))).alias("floor"))
    known = at_home.drop("floor").join(last, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    further = keep(known.select(at_home.columns).mapInPandas(others, f"{row}, cell long, floor double"), "further")
    return best(found.unionByName(meet(further))).select("query_id", "rank", "vec_id", "score")


def top_k_sql(k: int = 20, every: int = 20, scale: int = 64) -> str:
    return f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)) as v from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, list_inner_product(q.v, d.v)::bigint as score
      from v q join v d on q.vec_id % {every} = 0 and q.vec_id <> d.vec_id and len(q.v) = len(d.v))
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= {k}
"""
