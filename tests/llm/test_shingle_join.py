"""Components equal those of a brute-force join of all sets."""

import collections
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lexivec.llm import encoders
from lexivec.llm import shingle_join as sj


def brute(rows, words=5, percent=75):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(words, len(w))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    lead = list(range(len(rows)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            lead[find(i)] = find(j)
    low = collections.defaultdict(list)
    for k, (d, _) in enumerate(rows):
        if sets[k]:
            low[find(k)].append(d)
    smallest = {r: min((d for d in ds if d is not None), default=None) for r, ds in low.items()}
    return sorted((str(d), len(s), str(smallest[find(k)] if s else d)) for k, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, n=220):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.choice([12, 40, 90]))] for _ in range(3)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.55:
            new = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(len(new) + 1)
                new[at:at + rng.choice([0, 1, 8])] = [rng.choice(words) for _ in range(rng.choice([0, 1, 6]))]
        else:
            new = [rng.choice(words) for _ in range(rng.choice([1, 3, 6, 9, 20, 60, 150]))]
            if kind < 0.75:
                new += rng.choice(passages)
        texts.append(" ".join(new))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    # Settings that bring every branch out on small data.
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sj.near_duplicates(docs, batch_shingles=3000, group_entries=200, broadcast_ids=10,
                             often_in_batch=2, hot_entries=5, triple_share=0.04).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_odd_rows(spark):
    same = "a b c d e f g h i"
    rows = [(7, same), (7, same), (3, same.upper()), (None, same), (9, None), (8, ""), (8, " \n"), (1, "one two"),
            (2, "ONE\ttwo"), (4, "two one"), (None, "x y z"), (5, "a b c d e"), (6, "a b c d e f " * 4000)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node int, n long")
    got = sj.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "node", "component"]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute(rows)
    assert sj.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [50, 75, 90])
def test_similar_sets_share_a_possible_signature(percent, monkeypatch):
    """The prefix guarantee, with all kinds of frequency classes."""
    monkeypatch.setattr(sj, "SMALL_LEVEL", 4)
    rng = np.random.default_rng(percent)
    pool = rng.integers(1, 2**63, 3000).astype(np.uint64)
    frequent = sj.Frequent(pool[:2500], rng.integers(2, 300, 2500), 100)
    tried = 0
    for _ in range(4000):
        a = np.unique(rng.choice(pool, rng.integers(1, 300)))  # sizes of several levels
        b = a[rng.random(len(a)) > rng.random() * 0.3]
        b = np.unique(np.append(b, rng.choice(pool, rng.integers(0, 1 + len(a) // 8))))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
            continue
        tried += 1
        (sa, pa, _), (sb, pb, _) = sj.signatures(a, frequent, percent), sj.signatures(b, frequent, percent)
        room_a, room_b = dict(zip(sa.tolist(), pa.tolist())), dict(zip(sb.tolist(), pb.tolist()))
        assert any(sj.enough(len(a), len(b), min(room_a[s], room_b[s]), percent) for s in room_a.keys() & room_b)
    assert tried > 100


def test_combinations_stay_linear():
    """A long text of frequent shingles only has a few signatures per shingle."""
    pool = np.unique(np.random.default_rng(1).integers(1, 2**63, 20_000).astype(np.uint64))
    for count in (50, 500):
        sigs, _, _ = sj.signatures(pool, sj.Frequent(pool, np.full(len(pool), count), 100.0), 75)
        assert len(sigs) < 8 * len(pool)


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (200, 100), (55, 55)]
    got = {r.node: r.component for r in sj.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[k] for k in range(41)}) == 1 and got[100] == got[101] == got[200] and len(set(got.values())) == 2


def test_one_per_group(spark):
    same = "a b c d e f g h i"
    rows = [(7, same), (7, same), (3, same.upper()), (None, same), (9, None), (8, ""), (8, " "), (1, "one two"), (2, "One two"),
            (5, "p q r s t u"), (5, "v w x y z"), (5, "v w x y z"), (None, "left alone here"), (None, "left alone here")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int")
    got = sj.one_per_group(docs)
    assert got.columns == docs.columns
    want = [(3, same.upper()), (9, None), (8, ""), (8, " "), (1, "one two"), (5, "p q r s t u"), (5, "v w x y z"), (None, "left alone here")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
    assert sj.one_per_group(docs.limit(0)).count() == 0


def test_sketches_refuse_no_similar_pair(spark):
    rng = np.random.default_rng(4)
    rows = []
    for n in (1, 3, 20, 200, 900, 3000):
        for share in (1.0, 0.95, 0.87, 0.85, 0.5, 0.0):
            for size in (n, n + n // 8):
                a = np.unique(rng.integers(-2**63, 2**63 - 1, n, dtype=np.int64))
                b = np.unique(np.concatenate([a[:int(len(a) * share)], rng.integers(-2**63, 2**63 - 1, max(0, size - int(len(a) * share)), dtype=np.int64)]))
                if len(b):
                    rows.append((len(a), len(b), len(np.intersect1d(a, b)), sj.sketch_of(a).tolist(), sj.sketch_of(b).tolist()))
    table = spark.createDataFrame(rows, "n_a int, n_b int, common int, a array<long>, b array<long>")
    found = table.withColumn("allowed", sj.sketches_allow("a", "b", "n_a", "n_b", 75)).collect()
    similar = [sj.enough(r.n_a, r.n_b, r.common, 75) for r in found]
    assert all(r.allowed for r, same in zip(found, similar) if same) and sum(similar) > 10
    assert sum(not r.allowed for r in found if 20 <= r.n_a <= 200) > 5


def test_low_similarities_are_refused(spark):
    with pytest.raises(ValueError):
        sj.near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"), percent=49)


def test_texts_hashed_together_have_their_own_shingles(monkeypatch):
    """Windows never reach into the next text, whatever is hashed at a time."""
    texts = [t for _, t in corpus(5, 60)] + ["", None, " \n", "one", "one two", "a b c d e", "a b c d e f " * 300]
    alone = [sj.shingle_set(t) for t in texts]
    assert [len(s) for s in alone] == [n for _, n, _ in brute(list(zip(range(100, 100 + len(texts)), texts)))]
    for at_once in (1, 50, 1 << 16):
        monkeypatch.setattr(sj, "SLICE_WORDS", at_once)
        batch = sj.pa.record_batch([sj.pa.array(range(len(texts))), sj.pa.array(texts)], names=["id", "text"])
        got = list(sj.read_sets(iter([batch]), 5))
        assert [d for d, _, _ in got] == list(range(len(texts)))
        assert all(np.array_equal(s, want) and node == sj.node_of(want) for (_, s, node), want in zip(got, alone))


def test_links_between_components_count_once(spark, monkeypatch):
    labels = sj.write_table(spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "node long, component long"), "labels")
    links = spark.createDataFrame([(1, 3), (1, 3), (3, 1), (9, 8), (8, 9), (5, 3)], "c_a long, c_b long")
    got = collections.defaultdict(set)
    for r in sj.joined_components(labels, links).collect():
        got[r.component].add(r.node)
    assert sorted(map(sorted, got.values())) == [[1, 2, 3, 4, 5], [8, 9]]


def test_sketch_rules_out_sets_that_are_not_similar(spark):
    """Sets of 300 with 72 percent in common are told from similar ones before they are compared, and no similar sets are lost."""
    rng, rows = np.random.default_rng(1), []
    for k in range(200):
        pool = rng.integers(1, 2**63, 400).astype(np.uint64) * np.uint64(2)
        common = 248 if k % 2 else 264  # of 300 each: 70 and 78 percent
        a, b = pool[:300], np.append(pool[:common], pool[300:600 - common])
        rows.append((k % 2, 300, 300, sj.sketch_of(a).tolist(), sj.sketch_of(b).tolist()))
    pairs = spark.createDataFrame(rows, "far int, n_a long, n_b long, a array<long>, b array<long>")
    kept = pairs.filter(sj.sketches_allow("a", "b", "n_a", "n_b", 75)).groupBy("far").count().collect()
    kept = {r["far"]: r["count"] for r in kept}
    assert kept[0] == 100 and kept.get(1, 0) <= 10


def test_crowded_signatures(spark):
    # Every signature of more than two sets is compared block by block, and the result is that of all pairs.
    rows = corpus(7, 160)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sj.near_duplicates(docs, crowded=2, often_in_batch=2, hot_entries=2).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(tuple(map(str, r[:1])) + (r[1], str(r[2])) for r in got) == brute(rows)


def test_crowded_pairs_once(spark):
    # Sets that share 60 signatures are compared once, over blocks of four sets; those of one component never.
    rng = np.random.default_rng(5)
    base, own = np.arange(1, 61, dtype=np.int64), rng.integers(1 << 40, 1 << 62, (12, 16))
    sets = {k: np.sort(np.append(base, own[k])).view(np.uint64) for k in range(12)}
    placed = [(int(s), k, 76, 76, 0 if k < 3 else k, 1) for k in sets for s in base]
    crowded = spark.createDataFrame(placed, "sig long, node long, n long, room long, component long, crowd long")
    sketches = spark.createDataFrame([(k, sj.sketch_of(x).tolist()) for k, x in sets.items()], "node long, sketch array<long>")
    got = sj.crowded_pairs(crowded, sketches, 60, block_sets=4)
    assert sorted((r.a, r.b) for r in got.collect()) == [(a, b) for a, b in combinations(range(12), 2) if b > 2]
    assert sj.crowded_pairs(crowded, sketches, 75, block_sets=4).isEmpty()
    short = crowded.withColumn("room", (crowded["room"] - 40).cast("long"))
    assert sj.crowded_pairs(short, sketches, 60, block_sets=4).isEmpty()


def test_encoders_are_released():
    """A worker that packed texts before does not hold the tokenizer and its pieces while it hashes sets."""
    encoders._encoders["kind", "path"] = object()
    batch = pa.record_batch({"id": [1, 2], "text": ["a b c d e f", None]})
    assert [(doc, len(found)) for doc, found, _ in sj.read_sets(iter([batch]), 5)] == [(1, 2), (2, 0)]
    assert not encoders._encoders
