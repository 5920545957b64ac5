"""Approximate nearest neighbours by inner product, from low-dimensional stable projections.

Vectors are lifted by one coordinate to a common length, which makes the largest inner product the smallest
distance; PROJECTIONS Gaussian projections (2-stable) keep distances in the sense that the squared projected
distance over the squared distance is chi-square with PROJECTIONS degrees of freedom.

The projected space is cut into cells by a kd-tree whose splits are medians of a bounded sample (SAMPLE vectors,
those with the smallest hashes); every vector is put into its cell, and a cell of more than SHARD vectors into several
shards by hash, so a crowd of equal vectors is spread. A query first meets the shards of its own cell, then
those of all cells that its K-th best so far does not rule out by the stopping test. In a shard a kd-tree over
the projections gives the vectors in runs of leaves. The nearest by projected distance are verified by their inner
products, then those of each run that a query does not rule out: a vector as near as its K-th best would be projected
nearer than they are with probability CONFIDENCE.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from rollscope.llm.common import checkpointed

K = 20
PROJECTIONS = 24
CONFIDENCE = 0.95
LEAF = 64
#: Leaves of one run, and queries that are searched together.
RUN, TOGETHER = 8, 128
SHARD = 16384
QUERIES = 4096
SAMPLE = 16384


def chi_square(x: np.ndarray | float, m: int = PROJECTIONS) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, dtype=float), 1e3) / 2
    term, total = np.ones_like(half), np.zeros_like(half)
    for i in range(m // 2):
        total += term
        term = term * half / (i + 1)
    return 1 - np.exp(-half) * total


def directions(length: int) -> np.ndarray:
    """The projections of lifted vectors of this length, the same in every task."""
    return np.random.default_rng(20).standard_normal((length + 1, PROJECTIONS))


def projected(vectors: np.ndarray, reach: float) -> np.ndarray:
    lift = np.sqrt(np.maximum(reach**2 - (vectors**2).sum(axis=1), 0.0))
    return np.hstack([vectors, lift[:, None]]) @ directions(vectors.shape[1])


def projected_queries(queries: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Projections of the queries at the common length, and the factors that bring them there."""
    scale = reach / np.sqrt((queries**2).sum(axis=1))
    return np.hstack([queries * scale[:, None], np.zeros((len(queries), 1))]) @ directions(queries.shape[1]), scale


def median_boxes(points: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(members, lower corners, upper corners): boxes of at most `size` points, by medians along the widest axis.

    The corners are those of the half-spaces that the splits leave, so the boxes fill the space.
    """
    boxes, todo = [], [(np.arange(len(points)), np.full(PROJECTIONS, -np.inf), np.full(PROJECTIONS, np.inf))]
    while todo:
        some, low, high = todo.pop()
        axis = int(np.argmax(np.ptp(points[some], axis=0))) if len(some) else 0
        at = np.median(points[some, axis]) if len(some) else 0.0
        left = points[some, axis] < at
        if len(some) <= size or not left.any():
            boxes.append((some, low, high))
            continue
        below, above = high.copy(), low.copy()
        below[axis] = above[axis] = at
        todo += [(some[~left], above, high), (some[left], low, below)]
    return [b[0] for b in boxes], np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes])


def box_distances(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(points, boxes) squared distances."""
    near = np.zeros((len(at), len(low)))
    for d in range(at.shape[1]):
        near += np.maximum(np.maximum(low[None, :, d] - at[:, d, None], at[:, d, None] - high[None, :, d]), 0.0) ** 2
    return near


def stopping_ratio() -> float:
    """The squared projected distance over the squared distance at which the stopping test ends a search."""
    low, high = 0.0, 1e3
    for _ in range(100):
        at = (low + high) / 2
        low, high = (at, high) if float(chi_square(at)) < CONFIDENCE else (low, at)
    return high


class ProjectedTree:
    """A kd-tree over the projections of a shard. `verified` counts the inner products that were taken.

    Queries are searched together. Each verifies its 4 k nearest by projected distance, which gives a radius by the stopping
    test; then the leaves come up one run after the other, and a run's inner products are taken for the queries whose radius
    reaches into it. Radii shrink as better vectors are found, so whatever is projected nearer than the last radius is verified.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, reach: float):
        by_id = np.argsort(ids, kind="stable")
        points = projected(vectors[by_id], reach)
        self.leaves, _, _ = median_boxes(points, LEAF)
        order = np.concatenate(self.leaves) if len(ids) else by_id
        self.vectors, self.ids, self.points = vectors[by_id][order], ids[by_id][order], points[order]
        self.reach, self.verified, self.ratio = reach, 0, stopping_ratio()
        self.ends = np.cumsum([len(x) for x in self.leaves])

    def _runs(self) -> list[tuple[int, int]]:
        """First vectors and ends of runs of RUN leaves."""
        ends = [int(x) for x in self.ends[RUN - 1 :: RUN]]
        ends = ends if ends and ends[-1] == len(self.ids) else [*ends, len(self.ids)]
        return list(zip([0, *ends[:-1]], ends, strict=True))

    def _radii(self, kth: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Squared projected distances up to which vectors have to be verified; both lifted vectors have length `reach`."""
        far = np.maximum(2 * self.reach**2 - 2 * kth * scale, 0.0)
        return np.where(np.isfinite(kth), self.ratio * far, np.inf)

    def _best(self, queries: np.ndarray, rows: np.ndarray, least: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, inner products) of the k best of the given rows of each query, -1 and -inf for none."""
        # Summed one way for every pair, so that equal vectors have equal scores.
        scores = np.einsum("qkj,qj->qk", self.vectors[rows], queries)
        out = (rows < 0) | (self.ids[rows] == own[:, None]) | (scores < least[:, None])
        scores, rows = np.where(out, -np.inf, scores), np.where(out, -1, rows)
        best = np.lexsort((np.where(rows < 0, np.iinfo(np.int64).max, self.ids[rows]), -scores), axis=1)[:, :k]
        return np.take_along_axis(rows, best, 1), np.take_along_axis(scores, best, 1)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, k: int = K) -> pd.DataFrame:
        """query_id, vec_id, score of the k best of each query that are not under its `least`."""
        parts = [self._some(queries[i : i + TOGETHER], query_ids[i : i + TOGETHER], least[i : i + TOGETHER], k) for i in range(0, len(queries), TOGETHER)]
        return pd.concat(parts)

    def _some(self, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> pd.DataFrame:
        at, scale = projected_queries(queries, self.reach)
        near = (at**2).sum(axis=1)[:, None] + (self.points**2).sum(axis=1)[None, :] - 2 * at @ self.points.T
        slack = 1e-9 * ((at**2).sum(axis=1) + (self.points**2).sum(axis=1).max(initial=0.0))  # what this sum can be off by
        lot = min(4 * k + 1, len(self.ids))
        first = np.argpartition(near, lot - 1, axis=1)[:, :lot]
        rows, scores = self._best(queries, first, least, own, k)
        self.verified += first.size
        np.put_along_axis(near, first, np.inf, 1)
        kth = lambda: np.maximum(least, scores[:, k - 1] if scores.shape[1] >= k else -np.inf)
        for low, high in self._runs():
            inside = (near[:, low:high] <= (self._radii(kth(), scale) + slack)[:, None]) & (near[:, low:high] < np.inf)
            some = np.flatnonzero(inside.any(axis=1))
            if not len(some):
                continue
            self.verified += int(inside[some].sum())
            products = queries[some] @ self.vectors[low:high].T
            products[~inside[some]] = -np.inf
            margin = 1e-9 * self.reach * np.sqrt((queries[some] ** 2).sum(axis=1))
            better = products >= (kth()[some] - margin)[:, None]
            hit = np.flatnonzero(better.any(axis=1))
            if not len(hit):
                continue
            width = int(better[hit].sum(axis=1).max())
            ranked = np.argsort(~better[hit], axis=1, kind="stable")[:, :width]
            fresh = np.where(np.take_along_axis(better[hit], ranked, 1), ranked + low, -1)
            which = some[hit]
            got = self._best(queries[which], np.concatenate([rows[which], fresh], axis=1), least[which], own[which], k)
            if rows.shape[1] < got[0].shape[1]:
                more = got[0].shape[1] - rows.shape[1]
                rows, scores = np.pad(rows, ((0, 0), (0, more)), constant_values=-1), np.pad(scores, ((0, 0), (0, more)), constant_values=-np.inf)
            rows[which, : got[0].shape[1]], scores[which, : got[0].shape[1]] = got
        found = rows >= 0
        return pd.DataFrame({"query_id": np.repeat(own, found.sum(axis=1)), "vec_id": self.ids[rows[found]], "score": scores[found]})


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and its vector in double precision, without null, zero or non-finite vectors."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        .filter(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull())
    )


class Cells:
    """The boxes of the projected space, for each length of vectors in the sample; other lengths have one cell, 0."""

    def __init__(self, sample: list[list[float]], n: int, reach: float):
        self.reach, self.boxes = reach, {}
        by_length: dict[int, list[list[float]]] = {}
        for v in sample:
            by_length.setdefault(len(v), []).append(v)
        for length, some in by_length.items():
            points = projected(np.array(some), reach)
            self.boxes[length] = median_boxes(points, max(1, math.floor(len(sample) * SHARD / max(1, n))))[1:]

    def of(self, vectors: pd.Series, queries: bool) -> np.ndarray:
        """The cell of each vector, or that in which each query would lie."""
        out = np.zeros(len(vectors), dtype=np.int32)
        lengths = vectors.map(len).to_numpy()
        for length in self.boxes.keys() & set(lengths.tolist()):
            at = np.flatnonzero(lengths == length)
            low, high = self.boxes[length]
            for begin in range(0, len(at), 4096):
                some = at[begin : begin + 4096]
                given = np.stack(vectors.to_numpy()[some])
                points = projected_queries(given, self.reach)[0] if queries else projected(given, self.reach)
                out[some] = self._inside(points, low, high)
        return out

    @staticmethod
    def _inside(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        inside = np.ones((len(points), len(low)), dtype=bool)
        for d in range(points.shape[1]):
            inside &= (points[:, d, None] >= low[None, :, d]) & (points[:, d, None] < high[None, :, d])
        return inside.argmax(axis=1)

    def others(self, vectors: pd.Series, homes: pd.Series, kth: pd.Series) -> pd.Series:
        """The further cells that each query has to meet, given the inner product of its K-th best (null: none yet)."""
        out = []
        for v, home, least in zip(vectors, homes, kth.to_numpy(dtype=float), strict=True):
            if len(v) not in self.boxes:
                out.append([])
                continue
            at, scale = projected_queries(np.asarray(v)[None, :], self.reach)
            bound = box_distances(at, *self.boxes[len(v)])[0]
            far = 2 * self.reach**2 - 2 * least * scale[0]
            open_ = ~(chi_square(bound / far) >= CONFIDENCE) if far > 0 else np.ones(len(bound), dtype=bool) if math.isnan(far) else bound <= 0
            open_[home] = False
            out.append(np.flatnonzero(open_).tolist())
        return pd.Series(out, dtype=object)


def _meet(data: pd.DataFrame, wanted: pd.DataFrame, reach: float, k: int) -> pd.DataFrame:
    """The answers of one shard to one block of queries; vectors of other lengths than a query's don't count."""
    out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=float)]
    for length in wanted["v"].map(len).unique() if len(data) else ():
        some, ask = data[data["v"].map(len) == length], wanted[wanted["v"].map(len) == length]
        if not len(some):
            continue
        tree = ProjectedTree(np.stack(some["v"].to_numpy()), some["vec_id"].to_numpy(), reach)
        for low in range(0, len(ask), 512):
            part = ask.iloc[low : low + 512]
            out.append(tree.search(np.stack(part["v"].to_numpy()), part["vec_id"].to_numpy(), part["kth"].fillna(-np.inf).to_numpy(), k))
    return pd.concat(out).astype({"query_id": "int64", "vec_id": "int64"})


def answers(base: DataFrame, asked: DataFrame, shards: DataFrame, reach: float, k: int) -> DataFrame:
    """Queries (vec_id, v, kth, cell) against the vectors (vec_id, v, cell, shard) of their cells -> query_id, vec_id, score.

    Each shard is one group with the queries sent to it, in blocks of about QUERIES if there are more.
    """
    asking = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    cells = shards.join(asking, "cell")
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = base.join(cells.select("cell", "blocks"), "cell").select("cell", "shard", whole("blocks").alias("block"), "vec_id", "v")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int").alias("block")
    right = asked.join(cells, "cell").select("cell", whole("shards").alias("shard"), block, "vec_id", "v", "kth")
    keys = ["cell", "shard", "block"]
    meet = partial(_meet, reach=reach, k=k)
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(
        lambda data, wanted: meet(data, wanted), "query_id long, vec_id long, score double"
    )


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest of the others, ties to the smaller vec_id.

    Both tables have vec_id and embedding; a query is not a candidate of its own. Vectors that are null, zero or
    hold null or non-finite components take no part, nor do those of another length than the query's. A repeated
    vec_id is one candidate a row. A vec_id is one query however often it is given: of its usable vectors the
    smallest in array order is searched. Empty tables give none; other columns are ignored, whatever their names.
    """
    base = usable(embeddings)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    size = base.agg(F.count("*").alias("n"), F.max(norm).alias("reach")).first()
    n, reach = size["n"], size["reach"] or 1.0
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE if n > SHARD else 0)
    cells = Cells([r.v for r in sample.select("v").collect()], n, reach)

    cell = F.pandas_udf(lambda v: pd.Series(cells.of(v, False)), "int")
    home = F.pandas_udf(lambda v: pd.Series(cells.of(v, True)), "int")
    placed = checkpointed(base.select("vec_id", "v", cell("v").alias("cell")))
    shards = placed.groupBy("cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    split = placed.join(shards, "cell").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")).drop("shards")
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = checkpointed(asked.select("vec_id", "v", home("v").alias("cell"), F.lit(None).cast("double").alias("kth")))

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    first = checkpointed(best(answers(split, asked, shards, reach, k)))
    if not cells.boxes:
        return first.select("query_id", "rank", "vec_id", "score")
    kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    further = F.pandas_udf(lambda v, at, least: cells.others(v, at, least), "array<int>")
    again = (
        asked.drop("kth").join(kth, "vec_id", "left")
        .select("vec_id", "v", "kth", F.explode(further("v", "cell", "kth")).alias("cell"))
    )
    second = answers(split, checkpointed(again), shards, reach, k)
    return best(first.drop("rank").unionByName(second)).select("query_id", "rank", "vec_id", "score")
