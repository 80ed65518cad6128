"""Assignments and centroids equal those of a plain search in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from lexivec.llm import centroid_search


def brute(rows, clusters, rounds, seed="3", scale=1024, size=64):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, _, v in sorted((name(i), v, v) for i, v in kept)][:clusters]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    total = {n: sum(d for d, m in found if m == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(repr((i, n, d, total[n], sum(total.values()), digest[n])) for (i, _), (d, n) in zip(kept, found))


def check(spark, rows, **more):
    table = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<float>, v string, cluster int")
    got = centroid_search.cluster_vectors(table.repartition(3), **more).collect()
    args = {"clusters": 8, "rounds": 10} | more
    assert sorted(repr(tuple(r)) for r in got) == brute(
        [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], **args)
    return got


def test_against_plain_search(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(11, 64))
    rows = [(i, (middle[i % 11] + 0.3 * rng.normal(size=64)).tolist()) for i in range(300)]
    rows += [(None, rows[0][1]), (5, rows[5][1]), (5, rows[6][1]), (900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, []),
             (904, [float("nan")] * 64), (905, [1.0] * 63 + [None]), (906, [float("inf")] + [0.0] * 63)]
    assert len({r["cluster"] for r in check(spark, rows)}) > 3


def test_ties_and_few_vectors(spark):
    same = [(i, [0.25] * 64) for i in range(20)]
    assert {r["cluster"] for r in check(spark, same, rounds=3)} == {0}
    check(spark, [(1, [1.0] * 64), (2, [-1.0] * 64)])
    grid = [(i, [float(i % 3), float(i % 2), 0.0, 1.0]) for i in range(24)]
    check(spark, grid, clusters=5, rounds=4, size=4, seed="x", scale=2)


def test_empty_and_too_large(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert centroid_search.cluster_vectors(none).count() == 0
    assert centroid_search.cluster_vectors(none.filter("false")).count() == 0
    large = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        centroid_search.cluster_vectors(large)


@pytest.mark.parametrize("spread", [1, 1000, 100_000])
def test_inequalities_save_products(spread):
    rng = np.random.default_rng(2)
    centroids = rng.integers(-spread, spread + 1, (200, 16)) + rng.integers(-9 * spread, 9 * spread, (200, 1))
    rows = np.concatenate([centroids[rng.integers(0, 200, 500)] + rng.integers(-spread, spread + 1, (500, 16)), centroids])
    search = centroid_search.CentroidSearch(centroids)
    number, best = search.nearest(rows)
    plain = ((rows[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (number == plain.argmin(axis=1)).all() and (best == plain.min(axis=1)).all()
    assert search.products < 0.5 * plain.size


def test_search_at_the_limit():
    top = centroid_search.limit_for(64) - 1
    rows = np.array([[top] * 64, [-top] * 64, [top, -top] * 32], dtype=np.int64)
    number, best = centroid_search.CentroidSearch(rows).nearest(rows)
    assert number.tolist() == [0, 1, 2] and best.tolist() == [0, 0, 0]
