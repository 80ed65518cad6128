"""Fingerprints equal those of a plain winnowing, and keep its guarantee."""

import hashlib
import random

import pytest
import xxhash

from lexivec.llm import winnowing as w
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def spark_hash(data: bytes, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def rot(x, r):
    return ((x << r) | (x >> (64 - r))) & MASK


def winnow(text, gram=4, window=8):
    words = text.encode().split()
    if not words:
        return []
    if len(words) < gram:
        h = 42
        for word in words:
            h = xxhash.xxh64_intdigest(word, h)
        grams = [h]
    else:
        hs = [spark_hash(x) for x in words]
        grams = []
        for i in range(len(hs) - gram + 1):
            total = 0
            for x in hs[i:i + gram]:
                total = rot(total, 1) ^ x
            grams.append(total)
    grams = [g >> 33 for g in grams]
    out = []
    for i in range(max(1, len(grams) - window + 1)):
        part = list(enumerate(grams[i:i + window], i))
        best = min(part, key=lambda p: (p[1], -p[0]))
        if best not in out:
            out.append(best)
    return out


def texts():
    rng = random.Random(4)
    vocabulary = ["été", "a", "bb", "日本", "long" * 9, "x,y", "🙂"]
    out = ["", "  \t ", "one", "one two three", "w " * 50, "same same same same same same"]
    for _ in range(60):
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", "\x0b"]) for _ in range(rng.randrange(1, 60))))
    return out


def test_fingerprints(spark):
    rows = spark.createDataFrame(list(enumerate(texts())) + [(999, None)], "k int, n string")
    got = {r.k: r for r in w.with_fingerprint(rows, "n", "f").select("k", "n", w.chosen("f").alias("f"), w.written(F.col("f")).alias("t")).collect()}
    for k, text in enumerate(texts()):
        assert [(x.position, x.hash) for x in got[k].f] == winnow(text), text
        assert got[k].t == " ".join(f"{p}:{h:X}" for p, h in winnow(text))
    assert got[999].f == []


def test_guarantee(spark):
    rng = random.Random(8)
    shared = [f"s{k}" for k in range(w.GRAM + w.WINDOW - 1)]
    rows = []
    for k in range(40):
        noise = [f"n{rng.random()}" for _ in range(30)]
        at = rng.randrange(31)
        rows.append((k, " ".join(noise[:at] + shared + noise[at:])))
    own = w.with_fingerprint(spark.createDataFrame(rows, "k int, text string"), "text", "f").select(w.hashes(F.col("f")).alias("h")).collect()
    first = set(own[0].h)
    assert all(first & set(r.h) for r in own)


@pytest.mark.parametrize("parts", [1, 4])
def test_edited(spark, parts):
    rng = random.Random(2)
    rows = [(k * 3, "".join(rng.choice("abé🙂 ") for _ in range(rng.randrange(200)))) for k in range(40)]
    rows += [(5, None), (5, None), (None, "null key"), (7, "twin"), (7, "other twin"), (8, "same"), (8, "same")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, id int, words int").repartition(parts)
    got = w.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    def version(t):
        v = spark_hash(t.encode())
        return v - (1 << 64) if v >= 1 << 63 else v
    distinct = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), version(r[1])))
    nxt = {distinct[k]: distinct[(k + 1) % len(distinct)][1] for k in range(len(distinct))}
    want = []
    for d, t in rows:
        t = t or ""
        n = len(t) // 3
        edited = t[:len(t) - n] + nxt[d, t][:n]
        want.append((str(d), len(t), edited, [(p, h) for p, h in winnow(t)], [(p, h) for p, h in winnow(edited)], sorted({h for _, h in winnow(nxt[d, t])})))
    unpack = lambda f: [((1 << 32) - 1 - (x & 0xFFFFFFFF), x >> 32) for x in f]
    assert sorted((str(r.id), r.chars, r.edited, unpack(r.fingerprint), unpack(r.edited_fingerprint), sorted(r.next_hashes)) for r in got) == sorted(want)


def test_query(spark, sf):
    from lexivec.llm.queries import op2_winnowing

    rows = op2_winnowing(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts, reverse=True)
    for k, d in enumerate(ids):
        t, other = texts[d], texts[ids[(k + 1) % len(ids)]]
        ids_edited = t[:len(t) - len(t) // 3] + other[:len(t) // 3]
        texts[f"e{d}"] = hashlib.sha256(ids_edited.encode()).hexdigest()
    assert len(rows) == len(ids)
    for r in rows:
        assert r.n_chars == len(texts[r.doc_id]) and r.edited_sha256 == texts[f"e{r.doc_id}"]
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)


def test_no_python_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    out = w.edited_fingerprints(empty)
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().toString()
