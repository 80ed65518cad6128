"""Near duplicates by exact Jaccard joins of word shingles.

Candidates come from prefixes of each document's shingles, rarest first. Rare shingles are indexed
one by one; frequent ones lie in classes that are indexed by combinations of two or three, for which
the prefix is extended, so that what many documents share brings no candidates by itself.
Candidates are verified on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexivec.llm.common import fresh, small
from lexivec.llm.encoders import release_encoders
from lexivec.sources.shared_tables import drop_table, write_table

WORDS = 5
PERCENT = 75
BATCH_SHINGLES = 500_000
BATCH_ROWS = 1000  # texts handed to Python at a time
SLICE_WORDS = 1 << 16  # words of several texts that are hashed together
LISTED = 1 << 20  # frequent shingles known to every task, at most
OFTEN_IN_BATCH = 4  # sets of a batch that make a shingle a candidate for the list
TRIPLE_SHARE = 0.01  # share of the documents from which three shingles are combined
SMALL_LEVEL = 5  # documents below 2^5 shingles are indexed by single shingles only
GROUP_ENTRIES = 100_000
CROWDED = 64  # sets with the same signature above which they are compared block by block
BLOCK_SETS = 256  # sets of a block, about
SKETCHES_TOGETHER = 1 << 14  # pairs whose sketches are compared at once
HOT_ENTRIES = 64  # documents of a batch with the same signature that are not sent to one place
BROADCAST_IDS = 1 << 20

# Rare shingles are ordered by their hash; up to this one all of them belong to the prefix.
REACH = np.uint64(int(0.22 * 2**64))

# Odd multipliers of a polynomial hash and of its mixing.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                    0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], dtype=np.uint64)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * MIX
    return values ^ (values >> np.uint64(29))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive words, given by their hashes."""
    total = np.full(max(0, len(hashes) - width + 1), np.uint64(width))
    for k in range(width):
        total = total * FACTORS[0] + mixed(hashes[k:k + len(total)] + FACTORS[k % len(FACTORS)])
    return mixed(total)


def shingle_sets(found: list[list[bytes]], words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text, given by its words; of a shorter text, that of all its
    words; without words none."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(found)), np.uint64)
    every, start = windows(hashes, words), 0
    for size in map(len, found):
        own = every[start:start + size - words + 1] if size >= words else windows(hashes[start:start + size], size)[:size]
        own = np.sort(own)
        yield own[np.append(True, own[1:] != own[:-1])[:len(own)]]
        start += size


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    return next(shingle_sets([words_of(text)], words))


def node_of(shingles: np.ndarray) -> int | None:
    """A number for the set: equal sets are one node. The empty set has none."""
    if not len(shingles):
        return None
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "big", signed=True)


def read_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int | None, np.ndarray, int | None]]:
    def sets() -> Iterator[tuple[int | None, np.ndarray, int | None]]:
        for doc, shingles in zip(docs, shingle_sets(found, words)):
            yield doc, shingles, node_of(shingles)

    release_encoders()
    for batch in batches:
        docs, found, size = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            docs.append(doc)
            found.append(words_of(text))
            size += len(found[-1])
            if size >= SLICE_WORDS:
                yield from sets()
                docs, found, size = [], [], 0
        yield from sets()
    pa.default_memory_pool().release_unused()


def survey(docs: DataFrame, words: int, batch_shingles: int, often_in_batch: int) -> DataFrame:
    """What, id, node, n: a row per document (what 0) and one per batch and shingle that several sets of the
    batch hold (what 1: the shingle as id, their number as n)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        sets: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            cols = [[r[k] for r in rows] for k in range(3)]
            hashes, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets.values()]), return_counts=True)
            often = n >= often_in_batch
            hashes, n = hashes[often].view(np.int64), n[often]
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array([0, 1], np.int32), [len(rows), len(n)])),
                pa.array(cols[0] + hashes.tolist(), pa.int64()),
                pa.array(cols[1] + [None] * len(n), pa.int64()), pa.array(cols[2] + n.tolist(), pa.int64())],
                names=["what", "id", "node", "n"])

        for doc, shingles, node in read_sets(batches, words):
            rows.append((doc, node, len(shingles)))
            if node is not None and node not in sets:
                sets[node] = shingles
                size += len(shingles)
            if size >= batch_shingles:
                yield flush()
                rows, sets, size = [], {}, 0
        if rows:
            yield flush()

    return docs.mapInArrow(work, "what int, id long, node long, n long")


class Frequent:
    """The listed shingles with their count of documents, and from which count three are combined."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, triple: float):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.triple = hashes[order], counts[order], triple

    def of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
        return np.where(self.hashes[at] == shingles, self.counts[at], 0)


def levels(n: int, percent: int) -> list[int]:
    """Size classes in which a set must be found: its own, and the next smaller if a set of that class
    can be similar."""
    own = n.bit_length() - 1
    least = -(-n * percent // 100)
    return [own, own - 1] if least < 1 << own else [own]


def signatures(shingles: np.ndarray, frequent: Frequent, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of a set, the room of each, and how many rare shingles up to ``REACH`` it has; every prefix
    holds all of those. The room is how many shingles can be common with another set whose first
    common signature, in the global order, is this.

    Two similar sets share at least ceil(percent% of the larger) shingles, so each has at most
    n - that many which the other lacks. A prefix is long enough when, whichever so many of its shingles are
    taken away, one single shingle or one combination is left: a group of c shingles indexed by
    combinations of k stands ``c - k + 1`` losses. Groups depend on the shingle and the size class
    only, so both sets of a pair have the same. Before the first common signature no single shingle is common,
    and of a group of combinations of k at most k - 1 are.
    """
    n = len(shingles)
    need = n - -(-n * percent // 100) + 1
    counts = frequent.of(shingles)
    rare = shingles[counts == 0]
    low = int(np.searchsorted(rare, REACH, "right"))
    if len(rare) >= need:
        rare = rare[:max(need, low)]
        return rare, n - np.arange(len(rare)), low
    listed = np.flatnonzero(counts)
    listed = listed[np.lexsort((shingles[listed], counts[listed]))]
    common, triple = shingles[listed], counts[listed] >= frequent.triple
    sigs, rooms = [rare], [n - np.arange(len(rare))]
    for level in levels(n, percent):
        if level < SMALL_LEVEL:
            taken = common[:need - len(rare)]
            sigs.append(mixed(taken + np.uint64(level)))
            rooms.append(n - len(rare) - np.arange(len(taken)))
            continue
        doubles, triples = max(1, (1 << level) // 16), max(1, (1 << level) // 12)
        groups: dict[tuple[int, int], list[int]] = {}
        stands, hidden, made, left = len(rare), 0, [], []
        for at, (h, is_triple) in enumerate(zip(common.tolist(), triple.tolist())):
            if stands >= need:
                break
            k = 3 if is_triple else 2
            members = groups.setdefault((k, h % (triples if is_triple else doubles)), [])
            stands += len(members) >= k - 1
            # Combinations that end with this shingle.
            for others in combinations(members, k - 1):
                made.append((*others, h, 0)[:3])
                left.append(n - len(rare) - at + hidden)
            hidden += len(members) < k - 1
            members.append(h)
        if made:
            parts = np.array(made, dtype=np.uint64)
            total = np.full(len(parts), np.uint64(level))
            for k in range(3):
                total = total * FACTORS[0] + mixed(parts[:, k] + FACTORS[k])
            sigs.append(mixed(total))
            rooms.append(np.minimum(np.array(left), n))
    return np.concatenate(sigs), np.concatenate(rooms), low


def enough(n_a, n_b, common, percent: int):
    """Whether so many common shingles make two sets similar; works on numbers, arrays and columns."""
    return common * (100 + percent) >= percent * (n_a + n_b)


HEADS = -(1 << 62)  # parts below this tell of each set how many rare shingles up to REACH it has
MARK = 2**32 - 1  # in place of a room: other parts hold sets of this signature as well
POSTING = "part long, sigs binary, nodes binary, sizes binary, rooms binary"


def postings(docs: DataFrame, frequent: Frequent, groups: int, words: int, percent: int, batch_shingles: int,
             hot_entries: int) -> DataFrame:
    """Signatures packed by hash range, from each distinct set of a batch once. Those that many sets of a batch
    hold go to parts of the batch's own, numbered below 0, and only a mark goes to their range."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own_part = sent.value, -1 - TaskContext.get().partitionId() * groups
        found: dict[int, tuple] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            sigs = np.concatenate([f[0] for f in found.values()])
            lengths = [len(f[0]) for f in found.values()]
            nodes = np.repeat(np.fromiter(found, np.int64, len(found)), lengths)
            n = np.repeat(np.array([f[3] for f in found.values()], np.uint32), lengths)
            rooms = np.concatenate([f[1] for f in found.values()]).astype(np.uint32)
            order = np.argsort(sigs, kind="stable")
            sigs, nodes, n, rooms = sigs[order], nodes[order], n[order], rooms[order]
            starts = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1]))
            lengths = np.diff(np.append(starts, len(sigs)))
            hot = np.repeat(lengths >= hot_entries, lengths)
            first = np.zeros(len(sigs), bool)
            first[starts] = True
            ranges = (sigs % np.uint64(groups)).astype(np.int64)
            marks = np.flatnonzero(hot & first)
            spots = np.concatenate([np.arange(len(sigs)), marks])
            part = np.concatenate([np.where(hot, own_part - ranges, ranges), ranges[marks]])
            rooms = np.concatenate([rooms, np.full(len(marks), MARK, np.uint32)])
            order = np.argsort(part, kind="stable")
            spots, part, rooms = spots[order], part[order], rooms[order]
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            # Within a range the rest of a signature fits 32 bits well enough: a chance match is only a candidate.
            short = (sigs // np.uint64(groups)).astype(np.uint32)
            pieces = [np.split(x, cuts[1:]) for x in (short[spots], nodes[spots], n[spots], rooms)]
            # One more part of its own for the sets themselves.
            heads = (np.zeros(0, np.uint32), np.fromiter(found, np.int64, len(found)), np.zeros(0, np.uint32),
                     np.array([f[2] for f in found.values()], np.uint32))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(part[cuts], HEADS - TaskContext.get().partitionId())),
                 *(pa.array([x.tobytes() for x in [*column, head]], pa.binary()) for column, head in zip(pieces, heads))],
                names=["part", "sigs", "nodes", "sizes", "rooms"])

        for _, shingles, node in read_sets(batches, words):
            if node is not None and node not in found:
                found[node] = (*signatures(shingles, known, percent), len(shingles))
                size += len(found[node][0])
            if size >= batch_shingles // 4:
                yield flush()
                found, size = {}, 0
        if found:
            yield flush()

    return docs.mapInArrow(work, POSTING)


def could_match(group_starts: np.ndarray, group: np.ndarray, n: np.ndarray, rooms: np.ndarray, percent: int) -> np.ndarray:
    """Which sets, ordered by signature and size, could be similar to another of their signature.

    Of larger sets the next one asks least, of smaller ones the smallest that can be similar at all; the
    most room in the signature is taken for the other's.
    """
    common = np.minimum(np.minimum(rooms, np.maximum.reduceat(rooms, group_starts)[group]), n)
    same = group[1:] == group[:-1]
    larger = np.append(np.where(same, n[1:], -1), -1)
    smaller = np.maximum(n[group_starts][group], -(-n * percent // 100))
    follows = np.append(False, same)
    possible = (larger >= 0) & enough(n, larger, common, percent)
    return possible | follows & enough(n, smaller, np.minimum(common, smaller), percent)


def grouped(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and group numbers of runs in sorted ``sigs``."""
    starts = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1]))[:len(sigs)]
    lengths = np.diff(np.append(starts, len(sigs)))
    return starts, lengths, np.repeat(np.arange(len(starts)), lengths)


SHARED = "part long, sig long, node long, n long, room long, elsewhere boolean"


def shared_signatures(packed: DataFrame, groups: int, percent: int) -> DataFrame:
    """Rows (part, sig, node, n, room, elsewhere) of signatures that several sets hold, where sizes and places leave it
    possible that two of them are similar; ``elsewhere`` if other parts hold sets of it. Two more kinds
    have no n: how many rare shingles up to ``REACH`` a set has (no sig, elsewhere true), and how many of the
    part's signatures it shares with others (no sig, elsewhere false), both as room."""
    names = SHARED.replace(",", "").split()[::2]

    def table_of(part, sigs, nodes, n, rooms, elsewhere) -> pa.Table:
        count = len(nodes)
        none = pa.nulls(count, pa.int64())
        return pa.table([pa.array(np.full(count, part, np.int64)), none if sigs is None else pa.array(sigs), pa.array(nodes),
                         none if n is None else pa.array(n), pa.array(rooms.astype(np.int64)),
                         pa.array(np.broadcast_to(elsewhere, count))], names=names)

    def work(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        sigs, nodes, n, rooms = (
            np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()])
            for c, kind in (("sigs", np.uint32), ("nodes", np.int64), ("sizes", np.uint32), ("rooms", np.uint32)))
        if part <= HEADS:
            return table_of(part, None, nodes, None, rooms, True)
        n, rooms = n.astype(np.int64), rooms.astype(np.int64)
        order = np.lexsort((rooms, nodes, n, sigs))
        sigs, nodes, n, rooms = (x[order] for x in (sigs, nodes, n, rooms))
        keep = np.append(True, (sigs[1:] != sigs[:-1]) | (nodes[1:] != nodes[:-1]) | (rooms[1:] == MARK))
        sigs, nodes, n, rooms = (x[keep] for x in (sigs, nodes, n, rooms))
        starts, lengths, group = grouped(sigs)
        elsewhere = (np.maximum.reduceat(rooms, starts)[group] == MARK) | (part < 0)
        common = (lengths[group] > 1) | elsewhere
        met, times = np.unique(nodes[common & (rooms != MARK)], return_counts=True)
        possible = (could_match(starts, group, n, rooms, percent) | elsewhere) & (rooms != MARK)
        sigs, nodes, n, rooms, elsewhere = (x[possible] for x in (sigs, nodes, n, rooms, elsewhere))
        full = sigs.astype(np.int64) * groups + (part if part >= 0 else (-1 - part) % groups)
        return pa.concat_tables([table_of(part, full, nodes, n, rooms, elsewhere),
                                 table_of(part, None, met, None, times, False)])

    return packed.groupBy("part").applyInArrow(work, SHARED)


def candidates(shared: DataFrame, percent: int) -> DataFrame:
    """(sig, node, n, room, star, star_n, star_room) of signatures by which two sets could still be similar.

    All prefixes hold all rare shingles up to ``REACH``. One of those that is no other set's signature is therefore in no
    other set, and what a set can have in common is its size less those. Counting every signature that is
    shared makes them fewer, never more. ``star`` is the set that the others of its signature, part and size class meet
    first: the one with the smallest number, so sets that share many signatures mostly meet one star.
    """
    counts = shared.filter("sig IS NULL").groupBy("node").agg(
        F.max(F.when(F.col("elsewhere"), F.col("room"))).alias("single"),
        F.coalesce(F.sum(F.when(~F.col("elsewhere"), F.col("room"))), F.lit(0)).alias("met"))
    lacked = counts.select("node", F.greatest(F.col("single") - F.col("met"), F.lit(0)).alias("lacked")).filter("lacked > 0")
    rows = shared.filter("sig IS NOT NULL").join(lacked, "node", "left")
    rows = rows.withColumn("room", F.least("room", F.col("n") - F.coalesce("lacked", F.lit(0)))).drop("lacked")

    def work(table: pa.Table) -> pa.Table:
        sigs, nodes, n, rooms, elsewhere = (table[c].to_numpy() for c in ("sig", "node", "n", "room", "elsewhere"))
        elsewhere = elsewhere.astype(bool)
        order = np.lexsort((nodes, n, sigs))
        sigs, nodes, n, rooms, elsewhere = (x[order] for x in (sigs, nodes, n, rooms, elsewhere))
        starts, _, group = grouped(sigs)
        possible = could_match(starts, group, n, rooms, percent) | elsewhere
        sigs, nodes, n, rooms, elsewhere = (x[possible] for x in (sigs, nodes, n, rooms, elsewhere))
        starts, lengths, group = grouped(sigs)
        stay = (lengths[group] > 1) | elsewhere
        sizes = np.floor(np.log(n) / np.log(100 / percent)).astype(np.int64) if percent < 100 else n
        order = np.lexsort((nodes, sizes, sigs))
        sigs, nodes, n, rooms, stay, sizes = (x[order] for x in (sigs, nodes, n, rooms, stay, sizes))
        first = np.append(True, (sigs[1:] != sigs[:-1]) | (sizes[1:] != sizes[:-1]))[:len(sigs)]
        star = np.flatnonzero(first)[np.cumsum(first) - 1]
        columns = [sigs, nodes, n, rooms, nodes[star], n[star], rooms[star]]
        return pa.table([pa.array(c[stay]) for c in columns],
                        names=["sig", "node", "n", "room", "star", "star_n", "star_room"])

    return rows.groupBy("part").applyInArrow(
        work, "sig long, node long, n long, room long, star long, star_n long, star_room long")


def possible_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b), a below b, of rows a, n_a, room_a, b, n_b, room_b that could be similar; and, if the rows have them, the
    components c_a and c_b of both."""
    fits = enough(F.col("n_a"), F.col("n_b"), F.least("room_a", "room_b"), percent)
    ends = [("a", "b"), ("c_a", "c_b")] if "c_a" in pairs.columns else [("a", "b")]
    first = F.col("a") < F.col("b")
    return pairs.filter((F.col("a") != F.col("b")) & fits).select(
        *(F.when(first, one).otherwise(F.col(other)).alias(name) for x, y in ends
          for name, one, other in ((x, F.col(x), y), (y, F.col(y), x)))).distinct()


SKETCH_WORDS = 32  # of 64 bits; a power of 2


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """A bit for each shingle's place among 2048. A bit that another set's sketch lacks is a shingle that it lacks."""
    bits = np.zeros(64 * SKETCH_WORDS, bool)
    bits[(shingles.view(np.uint64) // np.uint64(2**64 // len(bits))).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def sketch_words(sketch: str) -> list[Column]:
    return [F.get(sketch, F.lit(k)) for k in range(SKETCH_WORDS)]


def words_allow(words_a: list[Column], words_b: list[Column], n_a: str, n_b: str, percent: int) -> Column:
    """False only for sets that cannot be similar: each has at most its size less the bits that the other lacks in common."""
    def lacked(one: list[Column], other: list[Column]) -> Column:
        return sum((F.bit_count(x.bitwiseAND(F.bitwise_not(y))) for x, y in zip(one, other)), F.lit(0))

    common = F.least(F.col(n_a) - lacked(words_a, words_b), F.col(n_b) - lacked(words_b, words_a))
    return enough(F.col(n_a), F.col(n_b), common, percent)


def sketches_allow(sketch_a: str, sketch_b: str, n_a: str, n_b: str, percent: int) -> Column:
    """``words_allow`` of two sketches that are arrays."""
    return words_allow(sketch_words(sketch_a), sketch_words(sketch_b), n_a, n_b, percent)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar. Sets come to their pairs by two joins and are compared row by row, so a
    task holds two sets at a time, however long."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))

    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(enough(F.size("set_a"), F.size("set_b"), common, percent)).select(*pairs.columns)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is one of its nodes.

    Each round every root takes the smallest root that it is linked with and links are rewritten to roots, so
    their number falls by half at least and the rounds are few. Tables are written each round.
    """
    links = write_table(links.filter("a != b").distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = write_table(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        steps = write_table(both.groupBy("a").agg(F.min("b").alias("to")).filter("to < a"), "steps")
        ahead = steps.select(F.col("a").alias("to"), F.col("to").alias("further"))
        for _ in range(2):  # towards the root of a chain of steps
            moved = steps.join(ahead, "to", "left").select("a", F.coalesce("further", "to").alias("to"))
            new = write_table(moved, "steps")
            drop_table(steps)
            steps = new
            ahead = steps.select(F.col("a").alias("to"), F.col("to").alias("further"))
        new_labels = write_table(labels.join(steps.select(F.col("a").alias("component"), "to"), "component", "left")
                                 .select("node", F.coalesce("to", "component").alias("component")), "labels")
        from_a = steps.select("a", F.col("to").alias("new_a"))
        from_b = steps.select(F.col("a").alias("b"), F.col("to").alias("new_b"))
        new_links = write_table(
            links.join(from_a, "a", "left").join(from_b, "b", "left")
            .select(F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b"))
            .filter("a != b").distinct(), "links")
        for old in (labels, links, steps):
            drop_table(old)
        labels, links = new_labels, new_links
    drop_table(links)
    return labels


FEW_LINKS = 50  # a round of stars that links fewer than one in so many sets is the last


def open_signatures(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The written rows (sig, node, n, room, component) of signatures that hold several components."""
    placed = shared.drop("star", "star_n", "star_room").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    placed = write_table(placed, "placed", release=True)
    mixed_ = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = write_table(placed.join(mixed_.filter("low != high").select("sig"), "sig", "left_semi").distinct(), "open", release=True)
    drop_table(placed)
    return open_


def drawn_stars(open_: DataFrame, number: int, percent: int) -> DataFrame:
    """Pairs of every set with one set of its signature, drawn by a hash, if that is in another component; with both components."""
    star = open_.groupBy("sig").agg(F.max_by(
        F.struct("node", "n", "room", "component"), F.xxhash64("sig", "node", F.lit(number))).alias("star"))
    return possible_pairs(open_.join(star, "sig").filter(F.col("component") != F.col("star.component")).select(
        F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("room").alias("room_a"), F.col("component").alias("c_a"),
        F.col("star.node").alias("b"), F.col("star.n").alias("n_b"), F.col("star.room").alias("room_b"),
        F.col("star.component").alias("c_b")), percent)


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after more links, given by the components of their ends (c_a, c_b). Links between the same two
    components count once. A component that has no label yet is a set alone, which its number names."""
    moved = components(links.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    alone = moved.join(labels.select("node"), "node", "left_anti").select("node", "component")
    new = write_table(labels.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
                      .select("node", F.coalesce("to", "component").alias("component")).unionByName(alone), "labels")
    for old in (moved, labels):
        drop_table(old)
    return new


BLOCK = "node, component, n, sketch, met"


def fitting_pairs(one: dict[str, np.ndarray], two: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``one``, in ``two``) of the sets of two blocks that are in different components, share a signature with
    room for similarity and whose sketches allow it; each once, however many signatures they share."""
    least = -(-percent * (one["n"][:, None] + two["n"]) // (100 + percent))
    fits = np.zeros(least.shape, bool)
    sides = []
    for side in (one, two):
        order = np.argsort(side["sig"], kind="stable")
        sigs, at, rooms = (side[c][order] for c in ("sig", "at", "room"))
        starts, lengths, _ = grouped(sigs)
        sides.append({s: (at[i:i + k], rooms[i:i + k]) for s, i, k in zip(sigs[starts].tolist(), starts, lengths)})
    for sig in sides[0].keys() & sides[1].keys():
        (at_a, rooms_a), (at_b, rooms_b) = sides[0][sig], sides[1][sig]
        cells = np.ix_(at_a, at_b)
        fits[cells] |= np.minimum(rooms_a[:, None], rooms_b) >= least[cells]
    fits &= one["component"][:, None] != two["component"]
    a, b = np.nonzero(fits)
    stay = np.zeros(len(a), bool)
    for i in range(0, len(a), SKETCHES_TOGETHER):
        at_a, at_b = a[i:i + SKETCHES_TOGETHER], b[i:i + SKETCHES_TOGETHER]
        both = np.bitwise_count(one["sketch"][at_a] & two["sketch"][at_b]).sum(axis=1, dtype=np.int64)
        common = np.minimum(*(side["n"][at] - side["bits"][at] + both for side, at in ((one, at_a), (two, at_b))))
        stay[i:i + SKETCHES_TOGETHER] = common >= least[at_a, at_b]
    return a[stay], b[stay]


def block_of(rows: pa.StructArray) -> dict[str, np.ndarray]:
    """The columns of a block's sets, and its signatures with the place of their set."""
    out = {c: rows.field(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "n")}
    sketch = rows.field("sketch")
    out["sketch"] = sketch.flatten().to_numpy().view(np.uint64).reshape(len(rows), SKETCH_WORDS)
    out["bits"] = np.bitwise_count(out["sketch"]).sum(axis=1, dtype=np.int64)
    met = rows.field("met")
    out["at"] = np.repeat(np.arange(len(rows)), met.value_lengths().to_numpy())
    out |= {c: met.flatten().field(c).to_numpy() for c in ("sig", "room")}
    return out


def crowded_pairs(crowded: DataFrame, sketches: DataFrame, percent: int, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Distinct (a, b, c_a, c_b) as of ``possible_pairs``, from rows (sig, node, n, room, component, crowd) of signatures that many
    sets hold.

    Near copies share hundreds of signatures, and a join by signature would meet each pair as often. Signatures of mostly
    the same sets have one crowd, and the sets of a crowd come in blocks: each two blocks meet in one row, in which a pair of sets is
    compared once. A row holds two blocks, so a crowd of any size is spread over rows."""
    members = crowded.groupBy("crowd", "node").agg(
        F.first("component").alias("component"), F.first("n").alias("n"), F.collect_list(F.struct("sig", "room")).alias("met"))
    members = write_table(members.join(sketches.select("node", "sketch"), "node"), "members", release=True)
    blocks = members.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / block_sets).alias("blocks"))
    packed = write_table(
        members.join(blocks, "crowd").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
        .groupBy("crowd", "block").agg(F.collect_list(F.struct(*BLOCK.split(", "))).alias("rows")), "blocks", release=True)
    meet = packed.select("crowd", F.col("block").alias("block_a"), F.col("rows").alias("one")).join(
        packed.select("crowd", F.col("block").alias("block_b"), F.col("rows").alias("two")), "crowd")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, two = (block_of(batch.column(c)[k].values) for c in (0, 1))
                a, b = fitting_pairs(one, two, percent)
                ends = one["node"][a], two["node"][b], one["component"][a], two["component"][b]
                first = ends[0] < ends[1]
                columns = [np.where(first, x, y) for i, j in ((0, 1), (2, 3)) for x, y in ((ends[i], ends[j]), (ends[j], ends[i]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "c_a", "c_b"])

    found = write_table(meet.filter("block_a <= block_b").select("one", "two").mapInArrow(work, "a long, b long, c_a long, c_b long"),
                        "crowded", release=True, batch_rows=1)
    for old in (members, packed):
        drop_table(old)
    return found.distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                    percent: int = PERCENT, listed: int = LISTED, batch_shingles: int = BATCH_SHINGLES,
                    group_entries: int = GROUP_ENTRIES, broadcast_ids: int = BROADCAST_IDS,
                    often_in_batch: int = OFTEN_IN_BATCH, hot_entries: int = HOT_ENTRIES,
                    triple_share: float = TRIPLE_SHARE, crowded: int = CROWDED) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, node and component.

    Words are runs of signs other than ASCII white space with A-Z lower-cased. A document's set holds its distinct
    shingles of ``words`` words; of a shorter text, all its words as one. Two documents are linked when
    100 * common >= percent * all. ``component_id`` is the smallest key reachable by links; documents without
    words have an empty set, a null node and their own key. Rows with a null key are compared like
    others, and have a null component where all are null. Equal sets share a node, so copies are compared once.

    First every signature's sets are compared with one of them, a star, and those in other components with stars drawn anew
    while many find links; then sets that share a signature and are still in different components are compared with each
    other, those of signatures that more than ``crowded`` sets hold block by block. So all links between components are found, while a group of near copies costs a few comparisons per member.
    """
    if percent < 50:
        raise ValueError("sets of very different sizes are not looked for: percent must be 50 or more")
    given = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    seen = write_table(survey(given, words, batch_shingles, often_in_batch), "survey", batch_rows=BATCH_ROWS)
    rows = seen.filter("what = 0").drop("what")
    count, total = rows.agg(F.count("node"), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = seen.filter("what = 1").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(listed).toPandas()
    frequent = Frequent(often["id"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64),
                        max(3.0, triple_share * count))
    groups = max(1, -(-total // (4 * group_entries)))
    met = write_table(shared_signatures(
        postings(given, frequent, groups, words, percent, batch_shingles, hot_entries), groups, percent), "met", release=True, batch_rows=BATCH_ROWS)
    shared = write_table(candidates(met, percent), "shared", release=True)
    drop_table(met)
    nodes = shared.select("node").distinct()

    # The sets of all nodes that met another, from one document each.
    wanted = write_table(rows.groupBy("node").agg(F.min("id").alias("id")).join(nodes, "node", "left_semi"), "wanted")
    ids = wanted.select("id").distinct()
    if small(ids, broadcast_ids):
        ids = F.broadcast(ids)
    asked = given.join(ids, given["id"].eqNullSafe(ids["id"]), "left_semi")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            found = {node: shingles.view(np.int64) for _, shingles, node in read_sets(iter([batch]), words)
                     if node is not None and node not in done}
            done.update(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64())),
                 pa.array([sketch_of(x) for x in found.values()], pa.list_(pa.int64()))], names=["node", "shingles", "sketch"])

    # A set may come once from each of several tasks if its key is repeated; a pair is then verified twice.
    sets = write_table(asked.mapInArrow(whole, "node long, shingles array<long>, sketch array<long>"), "sets", release=True, batch_rows=BATCH_ROWS)

    stars = possible_pairs(shared.select(
        F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("room").alias("room_a"),
        F.col("star").alias("b"), F.col("star_n").alias("n_b"), F.col("star_room").alias("room_b")), percent)
    links = write_table(verified(stars, sets, percent), "links")
    labels = components(links)

    # Signatures that still hold several components: all meet another star, drawn anew each round, as long as that helps.
    number, helps = 0, True
    while helps:
        number += 1
        open_ = open_signatures(shared, labels)
        links = write_table(verified(drawn_stars(open_, number, percent), sets, percent), "links", release=True)
        found, tried = links.count(), open_.select("node").distinct().count()
        if found:
            labels = joined_components(labels, links)
        drop_table(links)
        drop_table(open_)
        helps = found * FEW_LINKS > tried
    open_ = open_signatures(shared, labels)
    # A column per word, never null: the join reads them without looking into arrays.
    held = open_.groupBy("sig").agg(F.count(F.lit(1)).alias("times"), F.min(F.xxhash64("node")).alias("crowd"))
    crowds = write_table(open_.join(held.filter(F.col("times") > crowded).select("sig", "crowd"), "sig"), "crowds", release=True)
    spread = [F.coalesce(x, F.lit(0).cast("long")).alias(f"sketch_{k}") for k, x in enumerate(sketch_words("sketch"))]
    drawn = sets.select("node", *spread).dropDuplicates(["node"])
    few = held.filter(F.col("times") <= crowded).select("sig")
    drawn_open = write_table(open_.join(few, "sig", "left_semi").join(drawn, "node"), "open", release=True)
    drop_table(open_)
    open_ = drawn_open

    def side(end: str, sig: str) -> DataFrame:
        return open_.select(F.col("sig").alias(sig), F.col("component").alias(f"c_{end}"), F.col("node").alias(end),
                            F.col("n").alias(f"n_{end}"), F.col("room").alias(f"room_{end}"),
                            *(F.col(f"sketch_{k}").alias(f"sketch_{end}_{k}") for k in range(SKETCH_WORDS)))

    one, two = side("a", "sig"), side("b", "sig_b")
    in_a, in_b = ([F.col(f"sketch_{end}_{k}") for k in range(SKETCH_WORDS)] for end in "ab")
    meet = one.join(two, (F.col("sig") == F.col("sig_b")) & (F.col("c_a") < F.col("c_b"))
                    & enough(F.col("n_a"), F.col("n_b"), F.least("room_a", "room_b"), percent)
                    & words_allow(in_a, in_b, "n_a", "n_b", percent))
    pairs = possible_pairs(meet, percent)
    if not crowds.isEmpty():
        sketches = sets.join(crowds.select("node").distinct(), "node", "left_semi").select("node", "sketch").dropDuplicates(["node"])
        pairs = pairs.unionByName(crowded_pairs(crowds, sketches, percent)).distinct()
    pairs = write_table(pairs, "pairs", release=True)
    drop_table(crowds)
    drop_table(open_)
    if not pairs.isEmpty():
        involved = pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct()
        some = sets.join(F.broadcast(involved) if small(involved, broadcast_ids) else involved, "node", "left_semi")
        links = write_table(verified(pairs, some, percent), "links", release=True)
        labels = joined_components(labels, links)

    first = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("first_id"))
    first = first.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = first.groupBy("component").agg(F.min("first_id").alias("component_id"))
    placed_ids = first.select("node", "component").join(lowest, "component").select("node", "component", "component_id")
    out = rows.join(placed_ids, "node", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                      F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
                      "node", "component")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
                  broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: the one with the smallest key
    (null last), of several such rows one. Documents without words are alone and stay.

    What goes is anti-joined by key, so texts move only if that table is large; rows whose key is repeated
    are told apart by their sets.
    """
    found = write_table(near_duplicates(docs, key, text, words, percent), "found").select(
        F.col(f"`{key}`").alias("id"), "node", "component")
    first = found.filter("component IS NOT NULL").groupBy("component").agg(F.min_by(
        F.struct("id", "node"), F.struct(F.col("id").isNull(), "id", "node")).alias("first"))
    stay = first.select(F.col("first.id").alias("stay_id"), F.col("first.node").alias("stay_node"))
    times = found.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    repeated = write_table(times.filter("times > 1 OR id IS NULL").select("id"), "repeated")
    gone = found.filter("node IS NOT NULL").join(
        stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("node") == F.col("stay_node")), "left_anti")
    gone = write_table(gone.select("id").unionByName(repeated).distinct(), "gone")

    def listed(ids: DataFrame) -> DataFrame:
        ids = ids.select(F.col("id").alias("listed_id"))
        return F.broadcast(ids) if small(ids, broadcast_ids) else ids

    same = docs[f"`{key}`"].eqNullSafe(F.col("listed_id"))
    once = docs.join(listed(gone), same, "left_anti")
    if repeated.isEmpty():
        return once
    again = docs.join(listed(repeated), same, "left_semi")
    node, number = fresh(docs, "node", "number")
    schema = T.StructType([*docs.schema.fields, T.StructField(node, T.LongType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [node_of(shingle_set(t, words)) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=schema.names)

    again = again.mapInArrow(mark, schema)
    empty = again.filter(F.col(node).isNull())
    full = again.join(stay, F.col(f"`{key}`").eqNullSafe(F.col("stay_id")) & (F.col(node) == F.col("stay_node")), "left_semi")
    full = full.withColumn(number, F.row_number().over(
        Window.partitionBy(f"`{key}`", node).orderBy(text))).filter(F.col(number) == 1)
    return once.unionByName(empty.drop(node)).unionByName(full.drop(node, number))
