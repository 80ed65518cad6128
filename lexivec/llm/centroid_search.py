"""Centroid clustering in whole numbers with an equal-average equal-variance search.

Centroids stand in order of their component sum (their mean). A vector looks outward from its own sum, at
the nearer side first. With ``k`` components, sums ``S`` and ``V = k * sum(x * x) - S * S``,

    k * distance >= (S_x - S_c) ** 2 + (sqrt(V_x) - sqrt(V_c)) ** 2,

so a side ends once the first term alone exceeds ``k`` times the best distance, and a centroid is passed over
when both terms do. What is left is computed in integers, so assignments and ties are exact.

Vectors stay in Spark: each round sums them per cluster inside the tasks, and ``clusters * components``
numbers, the model itself, come to the driver.

Defined cases: vectors that are null, hold null, NaN or infinite components, or have another number of components, take no
part. Equal distances go to the smaller cluster. Equal ids start in order of their components; a null id counts as an
empty string in the draw. With fewer vectors than clusters, each is a centroid. An empty cluster keeps its
centroid. An empty table gives an empty table. Columns other than key and vector are not read. Components
beyond ``LIMIT`` after scaling, whose distances might not fit 64 bits, are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.sources.shared_tables import write_table

LIMIT = 1 << 24
SENT_NUMBERS = 1 << 24


def whole_vectors(vectors: DataFrame, key: str, vector: str, scale: int, size: int) -> DataFrame:
    """``key`` and ``v``: the components times ``scale``, rounded down, of the vectors that take part."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bound = F.lit(float(limit_for(size)))
    scaled = F.transform(x, lambda c: F.floor(F.when(F.abs(c.cast("double") * scale) < bound, c.cast("double") * scale)
                                              .otherwise(F.raise_error(F.lit("a component is too large to cluster")))))
    return vectors.filter(x.isNotNull() & (F.size(x) == size) & fine).select(F.col(key), scaled.alias("v"))


def limit_for(size: int) -> int:
    """Largest component: ``size * size * (2 * limit) ** 2`` must fit into 63 bits."""
    return min(LIMIT, int((1 << 62) ** 0.5 / (2 * size)))


class CentroidSearch:
    """Nearest centroids of many vectors at once; ``products`` counts the distances computed."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(axis=1)
        order = np.lexsort((np.arange(len(sums)), sums))
        self.numbers, self.centroids, self.sums = order, centroids[order], sums[order]
        self.spread = self.deviations(self.centroids, self.sums)
        self.products = 0

    @staticmethod
    def deviations(rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
        # V is at most 2 ** 62, so the integer difference is exact before the root.
        return np.sqrt((rows.shape[1] * (rows * rows).sum(axis=1) - sums * sums).astype(np.float64))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the number of the nearest centroid and the squared distance."""
        k, last = rows.shape[1], len(self.sums)
        sums = rows.sum(axis=1)
        spread = self.deviations(rows, sums)
        slack = 1e-9 * (1 + spread + self.spread.max()) ** 2  # far above what rounding can take from a bound
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        best = np.full(len(rows), np.iinfo(np.int64).max // max(1, k))
        number = np.full(len(rows), last)
        active = np.arange(len(rows))
        while len(active):
            s, b = sums[active], k * best[active]
            to_left = s - self.sums[np.maximum(left[active], 0)]
            to_right = self.sums[np.minimum(right[active], last - 1)] - s
            can_left = (left[active] >= 0) & (to_left * to_left <= b)
            can_right = (right[active] < last) & (to_right * to_right <= b)
            go_left = can_left & (~can_right | (to_left <= to_right))
            at = np.where(go_left, left[active], right[active])
            open_ = can_left | can_right
            active, at, b, s, go_left = active[open_], at[open_], b[open_], s[open_], go_left[open_]
            left[active[go_left]] -= 1
            right[active[~go_left]] += 1
            gap = (s - self.sums[at]).astype(np.float64)
            bound = gap * gap + (spread[active] - self.spread[at]) ** 2
            near = bound - slack[active] <= b
            who, which = active[near], at[near]
            self.products += len(who)
            delta = rows[who] - self.centroids[which]
            distance = (delta * delta).sum(axis=1)
            named = self.numbers[which]
            better = (distance < best[who]) | ((distance == best[who]) & (named < number[who]))
            best[who[better]] = distance[better]
            number[who[better]] = named[better]
        return number, best


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def first_centroids(rows: DataFrame, key: str, clusters: int, seed: str) -> np.ndarray:
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    found = rows.select(name.alias("name"), "v").orderBy("name", "v").limit(clusters).collect()
    return np.array([r["v"] for r in found], dtype=np.int64)


def next_centroids(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Means, rounded down, of the vectors nearest to each centroid; an empty one stays."""
    size = centroids.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total = CentroidSearch(centroids), np.zeros((len(centroids), size + 1), np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), size)
            number, _ = search.nearest(v)
            for c in np.unique(number):
                own = v[number == c]
                total[c, :size] += own.sum(axis=0)
                total[c, size] += len(own)
        met = np.flatnonzero(total[:, size])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(met, size + 1)), pa.array(np.tile(np.arange(size + 1), len(met))),
             pa.array(total[met].ravel())], names=["cluster", "place", "total"])

    parts = rows.select("v").mapInArrow(sums, "cluster long, place long, total long")
    out = centroids.copy()
    table = np.zeros((len(centroids), size + 1), dtype=object)
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        table[r["cluster"], r["place"]] = int(r["total"])
    for c in range(len(centroids)):
        if table[c, size]:
            out[c] = [t // table[c, size] for t in table[c, :size]]
    return out


def fit(rows: DataFrame, key: str, clusters: int, rounds: int, seed: str) -> np.ndarray:
    centroids = first_centroids(rows, key, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = next_centroids(rows, centroids)
    return centroids


def assign(rows: DataFrame, key: str, centroids: np.ndarray) -> DataFrame:
    """``key``, ``cluster`` and ``distance`` of every whole vector."""
    schema = T.StructType([rows.schema[key], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = CentroidSearch(centroids)
        for batch in batches:
            number, distance = search.nearest(_matrix(batch.column(1), centroids.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=schema.names)

    return rows.select(key, "v").mapInArrow(nearest, schema)


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = 8,
                    rounds: int = 10, seed: str = "3", scale: int = 1024, size: int = 64) -> DataFrame:
    """Key, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` per vector
    that takes part. ``clusters * size`` numbers are sent to every task; more than ``SENT_NUMBERS`` are refused."""
    if clusters * size > SENT_NUMBERS:
        raise ValueError("the centroids are too large to be sent to every task")
    spark = vectors.sparkSession
    rows = write_table(whole_vectors(vectors, key, vector, scale, size), "whole-vectors")
    centroids = fit(rows, key, clusters, rounds, seed)
    found = write_table(assign(rows, key, centroids), "assigned") if len(centroids) else spark.createDataFrame(
        [], T.StructType([rows.schema[key], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))
    inertias = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # one row per cluster
    final = [(c, i, sum(inertias.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
             for c, i in inertias.items()]
    table = spark.createDataFrame(final, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
