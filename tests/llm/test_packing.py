"""Every piece gets a place of its own, in nearly as few sequences as the token count allows."""

import collections
import random

import numpy as np
import public_tokenizers
import pytest

from lexivec.llm import packing


def solved(lengths, capacity):
    found = collections.Counter(lengths)
    kinds = np.array(sorted(found), dtype=np.int64)
    counts = np.array([found[n] for n in kinds.tolist()], dtype=np.int64)
    amounts = packing.solve_configurations(kinds, counts, capacity)
    groups = packing.round_configurations(amounts, kinds, counts, capacity)
    held = collections.Counter()
    for config, times in groups:
        assert sum(config) <= capacity and times > 0
        for n in config:
            held[n] += times
    assert held == found
    return sum(t for _, t in groups)


@pytest.mark.parametrize("seed", range(6))
def test_random_lengths(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, rng.choice([20, 60, 100])) for _ in range(rng.choice([1, 30, 3000]))]
    least = -(-sum(lengths) // 100)
    big = sum(n > 50 for n in lengths)
    assert solved(lengths, 100) <= max(least, big) * 1.03 + 2


def test_program_finds_what_greedy_misses():
    # Greedy pairs 6 with 3; the best packing is 6+4 and 3+3+4 (capacity 10).
    assert solved([6] * 100 + [4] * 200 + [3] * 200, 10) <= 201


def test_knapsack_by_brute_force():
    lengths, values = np.array([3, 5, 7]), np.array([0.3, 0.55, 0.71])
    best, taken = packing.best_fillings(values, lengths, 20)
    for c in range(21):
        brute = max(0.3 * a + 0.55 * b + 0.71 * d for a in range(7) for b in range(5) for d in range(3)
                    if 3 * a + 5 * b + 7 * d <= c)
        assert best[c] == pytest.approx(brute)
        own = packing.filling(taken, c)
        assert sum(own) <= c and sum(dict(zip([3, 5, 7], values))[n] for n in own) == pytest.approx(brute)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 7)
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 700), (3, "word " * 700), *[(k, "x y " * (k % 9)) for k in range(60)]]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, length int, rank int")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path, capacity=64).toPandas()
    assert got.groupby(["doc_id", "piece"], dropna=False).size().sum() == len(got)
    assert (got[got.doc_id == 3].groupby("piece").size() >= 2).all()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 64
    pieces = packing.token_pieces(docs, path, 64, 1, with_ids=True).collect()
    assert sorted(p.length for p in pieces) == sorted(got.length.tolist()) and all(len(p.ids) == p.length for p in pieces)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_texts_reach_the_encoder_a_thousand_at_a_time(spark, monkeypatch):
    """Not in batches of the session's size, which hold ten thousand texts of any length."""
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), *(pa.array([k], t) for k, t in (
                (0, pa.int32()), (0, pa.int64()), (1, pa.int64()), (0, pa.int64())))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = spark.range(2500).coalesce(1).selectExpr("id as doc_id", "'a' as text")
    monkeypatch.setattr(packing, "token_pieces", lambda docs, *_: docs.mapInArrow(sizes, packing.PIECE_SCHEMA))
    got = [r.doc_id for r in packing.pack_documents(docs, "unused").collect()]
    assert sum(got) == 2500 and max(got) <= 1000
