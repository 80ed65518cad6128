"""Counts by brute force, probabilities that sum to one, and a model better than single words."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexivec.llm import class_lm as lm


def corpus(n=300):
    rng = random.Random(2)
    nouns, verbs = [f"n{k}" for k in range(20)], [f"v{k}" for k in range(20)]
    return [(k, " ".join(f"{rng.choice(nouns)} {rng.choice(verbs)}" for _ in range(rng.randrange(1, 25)))) for k in range(n)]


def test_scores(spark):
    rows = corpus() + [(1000, None), (1001, ""), (None, "n1 v1"), (1002, "N1\tV2\x0bn3 unseen ünseen"), (7, corpus()[7][1])]
    docs = spark.createDataFrame([(d, t, 1.0, 2) for d, t in rows], "doc_id long, text string, score double, chunk int").repartition(3)
    got = lm.score_documents(docs, classes=4, frequent_share=1e-3, chunk_tokens=700)
    assert got.columns[0] == "doc_id"
    tokens = [[*(t or "").encode().lower().split(), lm.END] for _, t in rows]
    held = [lm.held_out(d, 7, 2) for d, _ in rows]
    counts = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    total, types = sum(counts.values()), len(counts)
    want = sorted((str(d), h, len(t), sum(counts[w] > 0 for w in t), total,
                   round(sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in t), 6)) for (d, _), t, h in zip(rows, tokens, held))
    result = got.collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in result) == want
    unheld = [r for r in result if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in unheld) > sum(r.base_score for r in unheld) * 0.9
    assert all(np.isfinite(r.score) for r in result)
    # Chunks and partitions do not matter.
    other = lm.score_documents(docs.repartition(1), classes=4, frequent_share=1e-3).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in other) == sorted((str(r.doc_id), round(r.score, 6)) for r in result)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 9, (3, 3)).astype(float)
    words = [np.array([5, 3]), np.array([4, 2, 1]), np.array([1, 1, 1, 2])]
    counts, types = np.array([w.sum() for w in words], float), np.array([len(w) for w in words])
    model = lm.smoothed(table, np.zeros(3), counts, types, 3, 2)
    assert np.allclose((10 ** model.transitions).sum(axis=1), 1)
    for c, w in enumerate(words):
        assert np.isclose((10 ** model.emission(w, np.full(len(w), c))).sum(), 1)
    assert model.emission(np.array([0]), np.array([3]))[0] == 0


def test_best_class_is_that_of_a_full_search():
    rng = np.random.default_rng(4)
    for _ in range(40):
        size, movable = 5, 4
        after, before = rng.integers(0, 6, size).astype(float), rng.integers(0, 6, size).astype(float)
        own = int(rng.integers(movable))
        table = rng.integers(0, 30, (size, size)).astype(float)
        table[own] += after
        table[:, own] += before
        scores = []
        for c in range(movable):
            moved = table.copy()
            moved[own] -= after
            moved[:, own] -= before
            moved[c] += after
            moved[:, c] += before
            scores.append(lm.objective(moved))
        best = lm.best_class(table, own, after, before, movable)
        assert scores[best] >= max(scores) - 0.05 * abs(max(scores))


def test_exchange_raises_the_likelihood(spark):
    words = 24  # even ones are followed by odd ones
    rows = [(a, b, 5) for a in range(0, words, 2) for b in range(1, words, 2)] + [(b, a, 5) for a in range(0, words, 2) for b in range(1, words, 2)]
    bigrams = spark.createDataFrame(rows, "a long, b long, n long")
    found, table = lm.exchange(bigrams, np.full(words, 120), classes=2, half_sweeps=6)
    start = np.append(np.arange(words) % 2, 2)
    assert lm.objective(table) >= lm.objective(lm.class_table(bigrams, start, 3)) - 1e-6
    assert len(found) == words + 1 and found[-1] == 2


def test_nothing_to_learn_from(spark):
    fold = next(k for k in range(100) if lm.held_out(k, 7, 2))
    only = spark.createDataFrame([(fold, "some words")], "doc_id long, text string")
    (row,) = lm.score_documents(only).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)
    assert lm.score_documents(only.limit(0)).count() == 0


def test_words_of_small_share_are_clustered(spark, monkeypatch):
    # Two occurrences among 400,000 are a share far below 1e-5.
    common = " ".join(f"c{k % 50}" for k in range(400))
    rows = [(k, common) for k in range(1200)] + [(2000 + k, f"r{k % 80} once{k}") for k in range(160)]
    counts = collections.Counter(w for d, t in rows if not lm.held_out(d, 7, 2) for w in [*t.split(), lm.END])
    seen, smoothed = [], lm.smoothed
    monkeypatch.setattr(lm, "smoothed", lambda *given: seen.append(given[2:4]) or smoothed(*given))
    lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), classes=4)
    ((in_class, members),) = seen
    once = sum(n == 1 for n in counts.values())
    assert sum(n == 2 for n in counts.values()) > 20 and (members[-1], in_class[-1]) == (once, once)
    assert (sum(members), sum(in_class)) == (len(counts), sum(counts.values()))


def test_moves_of_many_words_are_those_of_one():
    rng = np.random.default_rng(5)
    size, movable, words = 7, 6, 60
    after, before = (rng.integers(0, 4, (words, size)) * rng.integers(0, 2, (words, size)) for _ in range(2))
    own = rng.integers(0, movable, words)
    table = rng.integers(0, 60, (size, size)).astype(float)
    for w in range(words):
        table[own[w]] += after[w]
        table[:, own[w]] += before[w]
    table[0, 0] = 3
    got = lm.best_classes(table, own, after.astype(float), before.astype(float), movable)
    assert got.tolist() == [lm.best_class(table, int(o), a.astype(float), b.astype(float), movable)
                            for o, a, b in zip(own, after, before)]


def test_classes_of_many_words_meet_bigrams_in_a_shuffled_join(spark):
    bigrams = spark.createDataFrame([(0, 1, 2), (1, 9, 3), (9, 0, 4)], "a long, b long, n long")
    groups = spark.createDataFrame([(0, 0), (1, 1)], "w long, class int")
    for most in (0, 10):
        got = lm.classed_bigrams(bigrams, groups, 2, 2, broadcast_words=most)
        assert sorted(map(tuple, got.collect())) == [(0, 1, 2, 0, 1), (1, 9, 3, 1, 2), (9, 0, 4, 2, 0)]


def test_exchange_finds_the_classes_from_a_bad_start(spark):
    rng = np.random.default_rng(6)
    words, classes = 40, 4  # a word of class c is followed by one of class c + 1, seldom by any other
    kind = rng.permutation(np.arange(words) % classes)
    n = rng.poisson(np.where((kind[:, None] + 1) % classes == kind[None, :], 9, 0.3))
    bigrams = spark.createDataFrame([(int(a), int(b), int(n[a, b])) for a, b in zip(*np.nonzero(n))], "a long, b long, n long")
    start = np.arange(words) % classes
    known, dealt = (lm.objective(lm.class_table(bigrams, np.append(c, classes), classes + 1)) for c in (kind, start))
    groups, table = lm.exchange_words(lm.bigram_neighbours(bigrams, words, classes), lm.class_rows(bigrams, start), words, classes)
    found = np.array([r["class"] for r in groups.orderBy("w").collect()])
    assert lm.objective(table) >= known - 1e-6 and lm.objective(table) - dealt > 100
    assert len(set(zip(found.tolist(), kind.tolist()))) == classes


def test_lost_sweeps_are_undone(spark):
    rng = np.random.default_rng(3)
    words, classes = 60, 6
    pairs = [(int(a), int(b), int(n)) for a, b, n in zip(*rng.integers(0, words, (2, 900)), rng.integers(1, 9, 900))]
    bigrams = spark.createDataFrame(pairs, "a long, b long, n long").groupBy("a", "b").sum("n").toDF("a", "b", "n")
    dealt = lm.class_rows(bigrams, np.arange(words) % classes)
    groups, table = lm.exchange_words(lm.bigram_neighbours(bigrams, words, classes), dealt, words, classes, tolerance=0.0)
    found = np.array([r["class"] for r in groups.orderBy("w").collect()])
    assert np.array_equal(table, lm.class_table(bigrams, np.append(found, classes), classes + 1))
    assert lm.objective(table) > lm.objective(lm.class_table(bigrams, np.append(np.arange(words) % classes, classes), classes + 1))


def test_chunks_count_as_bigrams_do(spark, monkeypatch):
    rows = corpus(120) + [(900, "solo x y x"), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    chunks = lm.write_bucketed(lm.text_chunks(docs, 7, 2, chunk_tokens=300), "chunk", 4, "chunks")
    train = [[lm.END, *(t or "").encode().lower().split(), lm.END] for d, t in rows if not lm.held_out(d, 7, 2)]
    counts = collections.Counter(w for t in train for w in t[1:])
    known = sorted((w for w in counts if counts[w] > 1), key=lambda w: (-counts[w], w))
    number = {w: k for k, w in enumerate(known)}
    pairs = collections.Counter((number.get(a, len(known)), number.get(b, len(known))) for t in train for a, b in zip(t, t[1:]))
    bigrams = spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "a long, b long, n long")
    hashes = spark.createDataFrame([(lm.word_hash(w), k) for w, k in number.items()], "words long, w long")
    places = chunks.selectExpr("chunk", "posexplode(words) as (spot, words)").join(hashes, "words").select("chunk", "spot", "w")
    groups = lm.class_rows(bigrams, np.arange(len(known)) % 5)
    assert chunks.count() > 3
    numbered = lm.write_bucketed(lm.numbered_chunks(chunks, places), "chunk", 4, "numbered")
    monkeypatch.setattr(lm, "SLICE_TOKENS", 70)
    for turn, parts in ((0, 2), (1, 2), (3, 4)):
        found = []
        for count in (lm.bigram_neighbours(bigrams, len(known), 5), lm.chunk_neighbours(numbered, places, len(known), 5),
                      lm.chunk_neighbours(numbered, places, len(known), 5, sent_words=0)):
            seen = count(groups, turn, parts)
            cells = seen.selectExpr("range", "inline(arrays_zip(w, own, cell, n))").groupBy("range", "w", "own", "cell").sum("n")
            found.append(sorted(map(tuple, cells.collect())))
        assert found[0] == found[1] == found[2] and len(found[0]) > 20


def test_chunks_of_a_task_are_added_up(spark):
    """A task sends a range of words once, not once for each of its chunks, whatever it is handed at a time."""
    rows = corpus(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    chunks = lm.write_bucketed(lm.text_chunks(docs, 7, 2, chunk_tokens=300), "chunk", 1, "chunks")
    words = sorted(r.words for r in chunks.selectExpr("inline(arrays_zip(words, train))").filter("train > 0").select("words").distinct().collect())
    hashes = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "words long, w long")
    places = chunks.selectExpr("chunk", "posexplode(words) as (spot, words)").join(hashes, "words").select("chunk", "spot", "w")
    numbered = lm.write_bucketed(lm.numbered_chunks(chunks, places), "chunk", 1, "numbered")
    assert numbered.count() > 3
    dealt = lm.class_rows(chunks, np.arange(len(words)) % 5)
    seen = [lm.write_table(lm.chunk_neighbours(numbered.coalesce(1), places, len(words), 5)(dealt, 0, 2), "neighbours", batch_rows=n)
            for n in (0, 1)]
    assert [s.filter("range >= 0").count() for s in seen] == [1, 1]
    assert sorted(map(str, seen[0].collect())) == sorted(map(str, seen[1].collect()))


def test_score_is_that_of_the_plain_model(spark, monkeypatch):
    rows = corpus(200) + [(1000, None), (1001, "n1 unseen v2 rare"), (1003, "rare rare once")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept, exchanged = [], lm.exchange_words

    def recorded(*given):
        groups, table = exchanged(*given)
        kept.append([r["class"] for r in groups.orderBy("w").collect()])
        return groups, table

    monkeypatch.setattr(lm, "exchange_words", recorded)
    got = {r.doc_id: r.score for r in lm.score_documents(docs, classes=4, chunk_tokens=500).collect()}
    texts = {d: [*(t or "").encode().lower().split(), lm.END] for d, t in rows}
    train = [t for d, t in texts.items() if not lm.held_out(d, 7, 2)]
    counts = collections.Counter(w for t in train for w in t)
    order = sorted(counts, key=lambda w: (-counts[w], lm.word_hash(w)))
    group = {w: kept[0][k] if counts[w] > 1 else 4 for k, w in enumerate(order)}
    once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
    discount = once / (once + 2 * twice) if once and twice else 0.5
    in_class, types = collections.Counter(), collections.Counter(group.values())
    for w, n in counts.items():
        in_class[group[w]] += n
    pairs = collections.Counter((group[a], group[b]) for t in train for a, b in zip([lm.END, *t], t))
    mass = {c: in_class[c] - discount * types[c] for c in range(5)} | {5: discount * len(counts)}
    total = sum(counts.values())

    def moves(a, b):  # class 5: unknown words, which take from every class what discounting leaves
        share = [mass[c] / in_class[c] if in_class[c] else 0.0 for c in range(5)]
        n = pairs[a, b] * share[b] if b < 5 else sum(pairs[a, c] * (1 - share[c]) for c in range(5))
        all_ = sum(pairs[a, c] for c in range(5))
        return (n + lm.BACKOFF * mass[b] / total) / (all_ + lm.BACKOFF)

    for doc, text in texts.items():
        want, before = 0.0, lm.END
        for w in text:
            a, b = group.get(before, 5), group.get(w, 5)
            want += math.log10(moves(a, b)) + (math.log10((counts[w] - discount) / mass[b]) if b < 5 else 0.0)
            before = w
        assert math.isclose(got[doc], want, rel_tol=1e-9, abs_tol=1e-9)


def test_packed_neighbours(spark):
    """The exchange is handed bytes, not arrays, and they say the same, also of counts beyond 32 bits and of many ranges."""
    size, table = 6, np.arange(36) * (1 << 28)
    w, own, cell = np.array([7, 2, 9, 2, 12]), np.array([1, 3, 0, 3, 5]), np.array([11, 4, 0, 10, 2])
    n = np.array([1, 2, 1 << 40, 3, 5])
    for ranges in (1, 5):
        rows = pa.Table.from_batches([lm._neighbour_rows(w, own, cell, n, ranges, table, packed=True)])
        assert rows.schema.types == [pa.int64(), pa.binary(), pa.binary()]
        keys, times = lm._unpacked(rows.filter(pc.field("range") != lm.TABLE))
        assert sorted(zip(*(x.tolist() for x in lm._of_keys(keys, size)), times.tolist())) == sorted(zip(*(x.tolist() for x in (w, own, cell, n))))
        assert all(k // (2 * size * size) % ranges == r for r, b in zip(rows["range"].to_pylist(), rows["keys"].to_pylist())
                   if r != lm.TABLE for k in np.frombuffer(b, np.int64))
        packed = spark.createDataFrame(pa.concat_tables([rows, rows]).to_pylist(), "range long, keys binary, n binary")
        assert (lm.table_of(packed, size).ravel() == 2 * table).all()
