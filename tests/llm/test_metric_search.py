"""Results equal a scan of all pairs."""

import numpy as np
import pytest

from lexivec.llm import metric_search as m
from pyspark.sql import functions as F


def scan(rows, k, step=20, scale=64):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault((i, tuple(int(np.floor(scale * float(x))) for x in v)), None)
    out = []
    for qi, q in good:
        if qi % step == 0:
            scored = sorted(((-sum(a * b for a, b in zip(q, v)), i) for i, v in good if i != qi))[:k]
            out += [(qi, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def found(rows):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows.collect())


@pytest.mark.parametrize("n, width, spread", [(1, 3, 1.0), (40, 4, 0.1), (2000, 8, 0.05), (1500, 16, 1.0), (700, 2, 0.0)])
def test_tree(n, width, spread):
    rng = np.random.default_rng(n)
    centers = rng.normal(size=(6, width)) * 40
    points = np.floor(centers[rng.integers(0, 6, n)] + rng.normal(size=(n, width)) * 40 * spread).astype(np.int64)
    ids = rng.permutation(n * 3)[:n].astype(np.int64)
    tree = m.Tree(ids, points)
    queries = np.concatenate([points[:30], np.floor(rng.normal(size=(20, width)) * 60).astype(np.int64), np.zeros((1, width), np.int64)])
    own = np.concatenate([ids[:30], np.full(len(queries) - len(ids[:30]), -1)])
    place, near, score = tree.search(queries, own, 7)
    for k, q in enumerate(queries):
        want = sorted((-int(p @ q), int(i)) for p, i in zip(points, ids) if i != own[k])[:7]
        assert sorted((-int(s), int(i)) for s, i in zip(score[place == k], near[place == k])) == want


@pytest.mark.parametrize("size", [1 << 20, 1 << 29])
def test_large_numbers_stay_exact(size):
    rng = np.random.default_rng(3)
    points = rng.integers(-size, size, (300, 4))
    place, near, score = m.Tree(np.arange(300), points).search(points[:20], np.arange(20), 5)
    for k in range(20):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(p, points[k])), i) for i, p in enumerate(points) if i != k)[:5]
        assert sorted((-int(s), int(i)) for s, i in zip(score[place == k], near[place == k])) == want


def test_stored_bounds_save_products(monkeypatch):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 16)) * 300
    points = np.floor(centers[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 5).astype(np.int64)
    tree, read = m.Tree(np.arange(8000), points), []
    leaf = tree._leaf
    monkeypatch.setattr(tree, "_leaf", lambda page, at, *rest: (read.append(len(at) * (tree.pages[page][2] - tree.pages[page][1])), leaf(page, at, *rest)))
    tree.search(points[:100], np.arange(100), 20)
    assert sum(read) < 0.25 * 100 * 8000


def test_query(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(m, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 6) for i in range(40)]  # ties
    rows += [(20, rows[20][1]), (40, [9.0] * 6), (None, [1.0] * 6), (1001, None), (1002, [1.0, None]), (1003, [float("nan")] * 6),
             (1020, [float("inf"), 1.0]), (1040, []), (1060, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    want = scan([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows], 20)
    assert found(m.top_k(df.repartition(5), F.col("vec_id") % 20 == 0)) == want
    assert found(m.top_k(df, F.col("vec_id") % 20 == 0, k=1)) == [w for w in want if w[1] == 1]
    assert m.top_k(df.limit(0), F.lit(True)).count() == 0 and m.top_k(df, F.lit(False)).count() == 0
    two = spark.createDataFrame([(20, [1.0]), (21, [2.0])], "vec_id long, embedding array<float>")
    assert found(m.top_k(two, F.col("vec_id") % 20 == 0)) == [(20, 1, 21, 64 * 128)]
