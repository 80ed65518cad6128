"""Exact top-k by inner product over M-trees.

Vectors are dealt to blocks by a hash; each block is indexed as one M-tree of paged nodes. Query
blocks meet tree blocks by block number, every query is searched best first in each tree, and the
best of all trees are merged.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.sources.shared_tables import write_table

BLOCK_VECTORS = 8192
QUERY_BLOCK = 2048
LEAF = 128
FANOUT = 64
SLACK = 1e-9  # relative; bounds are in floating point, scores are whole numbers


class Tree:
    """Nodes in arrays: routing object, covering radius, distance to the parent's routing object,
    largest squared norm below, children (inner pages) or range of points (leaf pages)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.points = ids, points
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.largest: list[float] = []
        self.pages: list[tuple] = []
        spots = np.arange(len(ids))
        self.order: list[np.ndarray] = []
        self.filled = 0
        self.parent = np.zeros(len(ids))
        values = points.astype(np.float64)
        self.root = self._build(values, spots, _middle(values)) if len(ids) else None
        if len(ids):
            order = np.concatenate(self.order)
            self.ids, self.points, self.parent = ids[order], points[order], self.parent[order]
        del self.order

    def _build(self, values: np.ndarray, spots: np.ndarray, center: np.ndarray) -> int:
        own = values[spots]
        away = np.sqrt(((own - center) ** 2).sum(axis=1))
        node = len(self.center)
        self.center.append(center)
        self.radius.append(float(away.max()))
        self.largest.append(float((own ** 2).sum(axis=1).max()))
        self.pages.append(())
        if len(spots) <= LEAF:
            spots, away = spots[np.argsort(away, kind="stable")], np.sort(away)
            self.parent[spots] = away
            self.order.append(spots)
            self.pages[node] = (True, self.filled, self.filled + len(spots))
            self.filled += len(spots)
            return node
        parts = _split(own, min(FANOUT, -(-len(spots) // LEAF) + 1))
        children = [self._build(values, spots[p], _middle(own[p])) for p in parts]
        centers = np.array([self.center[c] for c in children])
        self.pages[node] = (
            False, children, centers, np.sqrt(((centers - center) ** 2).sum(axis=1)),
            np.array([self.radius[c] for c in children]), np.array([self.largest[c] for c in children]),
            (centers ** 2).sum(axis=1))
        return node

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, id and score of the ``k`` best of each query, ties to smaller ids, without its
        ``own`` id.

        Best first for all queries at once: in each round every query opens the page with its highest bound, and
        queries that open the same page share its products. A query is done when no bound reaches its
        ``k``-th score.
        """
        if self.root is None or not len(queries):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        values = queries.astype(np.float64)
        square = (values ** 2).sum(axis=1)
        norm = np.sqrt(square)
        most = float(norm.max()) * max(self.largest) ** 0.5 + 1
        # Products are exact in floating point while they stay below 2^52; beyond, integers are used.
        exact = most < 2**52
        # Score and id in one number: score * count - rank of the id.
        count = len(self.ids)
        kind = np.int64 if most * count < 2**62 else object
        none = -(2**62) if kind is np.int64 else -(2**130)
        by_id = np.argsort(self.ids, kind="stable")
        rank = np.empty(count, np.int64)
        rank[by_id] = np.arange(count)
        top = np.full((len(queries), k), none, dtype=kind)
        least = np.full(len(queries), -np.inf)
        bound = np.full((len(queries), len(self.center)), -np.inf)
        away = np.zeros(bound.shape)
        bound[:, self.root] = np.inf
        away[:, self.root] = np.sqrt(((values - self.center[self.root]) ** 2).sum(axis=1))
        live = np.arange(len(queries))
        while len(live):
            node = bound[live].argmax(axis=1)
            highest = bound[live, node]
            open_ = (highest >= least[live]) & (highest > -np.inf)
            live, node = live[open_], node[open_]
            order = np.argsort(node, kind="stable")
            cuts = np.flatnonzero(np.diff(node[order])) + 1
            for group in np.split(order, cuts) if len(order) else []:
                at, page = live[group], int(node[group[0]])
                bound[at, page] = -np.inf
                if self.pages[page][0]:
                    self._leaf(page, at, values, queries, square, away, least, top, own, rank, exact, k, none)
                else:
                    self._inner(page, at, values, square, norm, away, least, bound)
        place, spot = np.nonzero(top != none)
        found = top[place, spot]
        score = -(-found // count)
        return place, self.ids[by_id[(score * count - found).astype(np.int64)]], score.astype(np.int64)

    def _leaf(self, page, at, values, queries, square, away, least, top, own, rank, exact, k, none) -> None:
        lo, hi = self.pages[page][1:]
        # Points are sorted by their stored distance to the routing object. A point that could reach a query's k-th
        # score has one that differs from the query's by at most `reach`; the others need no product.
        scale = square[at] + self.largest[page]
        with np.errstate(invalid="ignore", over="ignore"):
            reach = np.sqrt(np.maximum(0, scale - 2 * least[at] + 4 * SLACK * scale)) + SLACK * (1 + away[at, page])
        first = lo + int(np.searchsorted(self.parent[lo:hi], (away[at, page] - reach).min(), "left"))
        last = lo + int(np.searchsorted(self.parent[lo:hi], (away[at, page] + reach).max(), "right"))
        if first >= last:
            return
        points = self.points[first:last]
        if exact:
            scores = (values[at] @ points.astype(np.float64).T).astype(np.int64)
        else:
            scores = queries[at].astype(np.int64) @ points.astype(np.int64).T
        keys = scores.astype(top.dtype) * len(self.ids) - rank[first:last]
        keys[own[at][:, None] == self.ids[None, first:last]] = none
        every = np.concatenate([top[at], keys], axis=1)
        if top.dtype == object:
            every.sort(axis=1)
        else:
            every.partition(every.shape[1] - k, axis=1)
        best = every[:, every.shape[1] - k:]
        top[at] = best
        worst = best.min(axis=1)
        full = worst != none
        least[at[full]] = (-(-worst[full] // len(self.ids))).astype(np.float64)

    def _inner(self, page, at, values, square, norm, away, least, bound) -> None:
        _, children, centers, parent, radius, largest, squares = self.pages[page]
        # The stored distances to this page's routing object bound every child without a product.
        near = np.maximum(0, np.abs(away[at, page][:, None] - parent) - radius)
        total = square[at][:, None] + largest
        needed = _up((total - near * near) / 2, total) >= least[at][:, None]
        used = np.flatnonzero(needed.any(axis=0))
        if not len(used):
            return
        products = values[at] @ centers[used].T
        apart = np.sqrt(np.maximum(0, square[at][:, None] + squares[used] - 2 * products))
        near = np.maximum(0, apart - radius[used])
        total = total[:, used]
        highest = np.minimum((total - near * near) / 2, products + norm[at][:, None] * radius[used])
        highest = _up(highest, total + squares[used])
        spots = np.asarray(children)[used]
        away[np.ix_(at, spots)] = apart
        bound[np.ix_(at, spots)] = np.where(needed[:, used], highest, -np.inf)


def _up(bound: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return bound + SLACK * scale


def _middle(values: np.ndarray) -> np.ndarray:
    """The point nearest to the mean."""
    return values[int(((values - values.mean(axis=0)) ** 2).sum(axis=1).argmin())]


def _split(values: np.ndarray, parts: int) -> list[np.ndarray]:
    """Parts by the nearest of evenly chosen pivots, after one step towards the parts' means.
    Points that no pivot tells apart are cut in halves."""
    step = len(values) / parts
    pivots = values[(np.arange(parts) * step).astype(np.int64)]
    for last in (False, True):
        apart = (pivots ** 2).sum(axis=1) - 2 * values @ pivots.T
        nearest = apart.argmin(axis=1)
        if not last:
            used = np.unique(nearest)
            pivots = np.array([values[nearest == p].mean(axis=0) for p in used])
    groups = [np.flatnonzero(nearest == p) for p in np.unique(nearest)]
    if len(groups) == 1:
        return np.array_split(np.arange(len(values)), parts)
    return groups


def scaled(vector: Column, scale: int) -> Column:
    """Floor of ``scale`` times each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def whole(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _packed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a matrix in a fixed order; shorter vectors are filled up with zeros."""
    ids = np.asarray(table["vec_id"].to_pylist(), np.int64)
    lists = table["vector"].combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    points = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
    points[np.arange(points.shape[1]) < sizes[:, None]] = flat
    if points.size and float(np.abs(points.astype(np.float64)).max()) ** 2 * points.shape[1] >= 2.0**62:
        raise OverflowError("inner products do not fit a 64-bit integer")
    order = np.lexsort((*points.T, ids)) if points.size else np.argsort(ids)
    return ids[order], points[order]


def _blob(ids: np.ndarray, points: np.ndarray) -> bytes:
    small = points.astype(np.int32) if np.abs(points).max(initial=0) < 2**31 else points
    return pickle.dumps(Tree(ids, small), protocol=5)


def _same_width(points: np.ndarray, width: int) -> np.ndarray:
    return points[:, :width] if points.shape[1] >= width else np.pad(points, ((0, 0), (0, width - points.shape[1])))


def top_k(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64,
          vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row of ``rows`` that meets ``is_query`` its ``k`` highest scores among all other ids.

    The score is the inner product of the vectors after ``floor(scale * x)``. Returns query_id, rank
    (from 1), vec_id and score; ties go to the smaller vec_id. Rows with a null id or vector, or with a null or
    non-finite component, take no part; vectors of different length are filled up with zeros; rows
    equal in id and vector count once, and a query never meets its own id. Other columns of
    ``rows`` are used by ``is_query`` only.

    Queries are all rows that meet the condition, so the work is queries times rows; it is cut into
    pairs of blocks of bounded size that share nothing.
    """
    given = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"),
                        F.coalesce(is_query, F.lit(False)).alias("asked"))
    given = given.filter(F.col("vec_id").isNotNull() & whole(F.col("v"))).select(
        "vec_id", scaled(F.col("v"), scale).alias("vector"), "asked")
    points = write_table(given.groupBy("vec_id", "vector").agg(F.max("asked").alias("asked")), "vectors")
    count, asked = points.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    blocks, query_blocks = max(1, -(-count // BLOCK_VECTORS)), max(1, -(-asked // QUERY_BLOCK))
    place = F.xxhash64("vec_id", "vector")

    def build(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        return pa.table({"block": pa.array([block], pa.int32()), "tree": [_blob(*_packed(table))]})

    def gather(table: pa.Table) -> pa.Table:
        ids, matrix = _packed(table)
        return pa.table({"asked_ids": [ids.tobytes()], "asked_points": [pickle.dumps(matrix, protocol=5)]})

    dealt = points.select("vec_id", "vector", F.pmod(place, F.lit(blocks)).cast("int").alias("block"))
    trees = dealt.groupBy("block").applyInArrow(build, "block int, tree binary")
    questions = (points.filter("asked")
                 .select("vec_id", "vector", F.pmod(place, F.lit(query_blocks)).cast("int").alias("query_block"))
                 .groupBy("query_block").applyInArrow(gather, "asked_ids binary, asked_points binary"))
    pairs = questions.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(trees, "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                tree: Tree = pickle.loads(batch.column("tree")[at].as_py())
                ids = np.frombuffer(batch.column("asked_ids")[at].as_py(), np.int64)
                matrix = _same_width(pickle.loads(batch.column("asked_points")[at].as_py()), tree.points.shape[1])
                place, near, score = tree.search(matrix, ids, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[place]), pa.array(place), pa.array(near), pa.array(score)],
                    names=["query_id", "place", "vec_id", "score"])

    # `place` tells queries apart that share an id; a query block has one order in all pairs.
    found = pairs.select("asked_ids", "asked_points", "tree").mapInArrow(
        search, "query_id long, place long, vec_id long, score long")
    best = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
