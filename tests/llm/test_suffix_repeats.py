"""Removed bytes equal those found by counting every string of the length."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.llm import suffix_repeats


def brute(texts, size):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(d[i:i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - size + 1):
            if count[d[i:i + size]] > 1:
                gone[i:i + size] = True
        edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), list(zip(edges[::2], edges[1::2])), kept))
    return out


def rows_of(spark, texts, size, part_bytes=1 << 23):
    rows = [(None if i == 3 else i, t, "x", b"y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, kept binary").repartition(3)
    cut = suffix_repeats.cut_texts(docs, min_bytes=size, part_bytes=part_bytes)
    none = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    joined = suffix_repeats.per_document(docs.select("doc_id", "text"), cut, other={
        "spans": none, "kept": F.lit(None).cast("binary")})
    return joined.collect()


def check(spark, texts, size, **more):
    got = rows_of(spark, texts, size, **more)
    want = collections.Counter()
    for t, (i, found) in zip(texts, enumerate(brute(texts, size))):
        n, spans, kept = found
        short = n < size
        want[repr((None if i == 3 else i, n, spans, None if short else hashlib.sha256(kept).hexdigest()))] += 1
    have = collections.Counter(
        repr((r["doc_id"], r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]],
              None if r["kept"] is None else hashlib.sha256(bytes(r["kept"])).hexdigest())) for r in got)
    assert have == want
    return sum(len(r["spans"]) for r in got)


@pytest.mark.parametrize("modulus", suffix_repeats.COVERS)
def test_covers_have_every_difference_once(modulus):
    cover = suffix_repeats.COVERS[modulus]
    assert sorted((a - b) % modulus for a in cover for b in cover if a != b) == list(range(1, modulus))


def test_any_two_starts_share_a_sampled_shift():
    modulus, cover = suffix_repeats.cover_for(200)
    assert modulus == 73 and all(any((i + s) % modulus in cover and (j + s) % modulus in cover for s in range(modulus))
                                 for i in range(modulus) for j in range(modulus))


def passages(seed):
    rng = random.Random(seed)
    words = ["ab", "é", "漢字", "😀", "xyz", "q", "lorem", "ipsum", "\n", "\x00"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [line(rng.choice([8, 15, 40, 90])) for _ in range(6)]
    out = [None, "", "a", "short", "a" * 300, "ab" * 150, line(4)]
    for _ in range(60):
        parts = [line(rng.randint(0, 30)) for _ in range(3)]
        if rng.random() < 0.7:
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        out.append("|".join(parts))
    return [*out, *out[10:14], out[10]]


@pytest.mark.parametrize("size,part_bytes", [(200, 1 << 23), (200, 500), (40, 1 << 23), (18, 300)])
def test_against_brute_force(spark, size, part_bytes):
    assert check(spark, passages(size + part_bytes % 7), size, part_bytes=part_bytes) > 5


def test_edges(spark):
    rng = random.Random(1)
    fresh = lambda n: "".join(chr(rng.randint(33, 126)) for _ in range(n))
    mid, both = fresh(200), fresh(199)
    # Exactly as long as needed, one byte short, twice in one text, touching and overlapping runs.
    texts = [fresh(50) + mid + fresh(50), fresh(3) + mid, fresh(9) + both + fresh(9), both + fresh(40),
             mid + mid, mid[100:] + fresh(100) + mid[:100], fresh(1000) * 2, fresh(200)]
    assert check(spark, texts, 200) == 4


def test_one_passage_in_most_texts_and_a_long_text(spark):
    rng = random.Random(2)
    fresh = lambda n: "".join(chr(rng.randint(97, 122)) for _ in range(n))
    common = fresh(260)
    texts = [fresh(rng.randint(0, 300)) + common + fresh(rng.randint(0, 30)) for _ in range(150)]
    texts += [fresh(60_000) + common + fresh(60_000), *[fresh(250)] * 40]
    check(spark, texts, 200, part_bytes=4000)


def test_nothing_to_do(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_repeats.cut_texts(empty).count() == 0
    assert rows_of(spark, ["a", None, "", "b"], 200)[0]["spans"] == []
    with pytest.raises(ValueError):
        suffix_repeats.cut_texts(empty, min_bytes=10)
