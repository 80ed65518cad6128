"""Class-based bigram language model: exchange clustering, then scores of whole texts.

Words are known by a 64-bit hash. Texts become chunks of local word numbers with the chunk's own vocabulary;
what the corpus knows of a word reaches a chunk once per chunk and word, by a join, so neither the vocabulary
nor the texts pass through one place.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count as count_up

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import fresh
from lexivec.sources.shared_tables import BATCH_ROWS, drop_table, session_settings, write_bucketed, write_table
from lexivec.sources.sorted_tables import with_total_before, write_in_order

CLASSES = 64
CLUSTERED = 2  # occurrences from which a word is clustered
FREQUENT = 0.0  # share of the tokens that a clustered word needs besides
TOLERANCE = 0.01  # a sweep that gains a smaller share of all gains ends the exchange
MOST_PARTS = 8  # a turn of one word in so many that still lowers the likelihood ends the exchange
BROADCAST_WORDS = 1 << 21  # classes of more words meet the bigrams in a shuffled join
RANGE_WORDS = 1 << 14  # words whose moves one task finds together
COMBINED = 1 << 20  # bigrams added up at once
HELD = 1 << 19  # neighbours of several chunks that are added up before they leave a task
TOGETHER = 256  # words whose gains are computed at once
CHUNK_TOKENS = 1 << 20
SLICE_TOKENS = 1 << 19  # tokens whose neighbours are counted together
SENT_WORDS = 1 << 22  # classes of more words come to the chunks by a join
BACKOFF = 50.0  # weight of the classes' own frequencies in the transitions
END = b"\n"  # never a word

CHUNK_SCHEMA = ("chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, tokens binary, "
                "words array<long>, train array<int>")


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    """Whether CRC-32 of the id as text falls into the fold; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def text_chunks(docs: DataFrame, folds: int, fold: int, key: str = "doc_id", text: str = "text",
                chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Rows of many documents: local word numbers (frequent words small), the words' hashes and how
    often each occurs in training documents. A document is its words and one end token."""

    def numbers() -> dict[bytes, int]:
        """Numbers its words as they are looked up; the end token is the first."""
        local = defaultdict(count_up(1).__next__)
        local[END] = 0
        return local

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        local = numbers()
        ids, sizes, tokens, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(tokens)
            held = np.array([held_out(d, folds, fold) for d in ids])
            by_use = np.argsort(-np.bincount(flat, minlength=len(local)), kind="stable")
            rank = np.empty(len(local), np.uint32)
            rank[by_use] = np.arange(len(local))
            flat = rank[flat]
            train = np.bincount(flat[~np.repeat(held, sizes)], minlength=len(local))
            hashes = np.fromiter(map(word_hash, local), np.int64, len(local))[by_use]
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 31) + number]), pa.array([ids], pa.list_(pa.int64())), pa.array([held.tolist()]),
                pa.array([sizes], pa.list_(pa.int32())), pa.array([flat.tobytes()], pa.binary()),
                pa.array([hashes]), pa.array([train.astype(np.int32)])],
                names=["chunk", "doc_ids", "held", "sizes", "tokens", "words", "train"])

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = body.encode().lower().split()
                found.append(END)
                tokens.append(np.fromiter(map(local.__getitem__, found), np.uint32, len(found)))
                ids.append(doc)
                sizes.append(len(found))
                total += len(found)
                if total >= chunk_tokens:
                    yield flush()
                    number += 1
                    local, ids, sizes, tokens, total = numbers(), [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col(f"`{key}`").cast("long"), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return rows.mapInArrow(read, CHUNK_SCHEMA)


def _plogp(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def objective(table: np.ndarray) -> float:
    """The part of the class bigram likelihood that depends on the classes."""
    return float(_plogp(table).sum() - _plogp(table.sum(axis=0)).sum() - _plogp(table.sum(axis=1)).sum())


def best_class(table: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, movable: int) -> int:
    """The class among the first ``movable`` in which a word raises the likelihood most.

    ``after`` and ``before`` count the classes that follow and precede the word.
    """
    rest = table.copy()
    rest[own] -= after
    rest[:, own] -= before
    rest = np.maximum(rest, 0)
    left, right = np.flatnonzero(before), np.flatnonzero(after)
    rows, cols = rest[:movable][:, right], rest[left][:, :movable]
    gain = (_plogp(rows + after[right]) - _plogp(rows)).sum(axis=1)
    gain += (_plogp(cols + before[left, None]) - _plogp(cols)).sum(axis=0)
    for sums, n in ((rest.sum(axis=1)[:movable], after.sum()), (rest.sum(axis=0)[:movable], before.sum())):
        gain -= _plogp(sums + n) - _plogp(sums)
    # Equal gains leave the word where it is.
    best = int(gain.argmax())
    return own if gain[own] >= gain[best] - 1e-9 else best


def best_classes(table: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray,
                 movable: int) -> np.ndarray:
    """``best_class`` of many words, each against the same table; a row of ``after`` and ``before`` per word."""
    every = np.arange(len(own))
    gain = np.zeros((len(own), movable))
    for counts, others, cells in ((after, before, table[:movable].T), (before, after, table[:, :movable])):
        word, cell = np.nonzero(counts)
        if not len(word):
            continue
        n = counts[word, cell]
        rest, entry = cells[cell], np.arange(len(word))
        rest[entry, own[word]] -= n
        same = np.flatnonzero(cell == own[word])
        rest[same] -= others[word[same], :movable]
        rest = np.maximum(rest, 0)
        # Most cells are the table's, whose logarithms are taken once.
        lost = _plogp(np.maximum(cells, 0))[cell]
        lost[entry, own[word]] = _plogp(rest[entry, own[word]])
        lost[same] = _plogp(rest[same])
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        gain[word[starts]] += np.add.reduceat(_plogp(rest + n[:, None]) - lost, starts)
    # A word that follows itself is taken from its own cell twice; the cell stays at 0 as in best_class.
    lacking = np.maximum(after[every, own] + before[every, own] - table[own, own], 0)
    for totals, counts, others in ((table.sum(axis=1), after, before), (table.sum(axis=0), before, after)):
        n = counts.sum(axis=1)
        sums = totals[:movable] - others[:, :movable]
        sums[every, own] += lacking - n
        gain -= _plogp(sums + n[:, None]) - _plogp(sums)
    best = gain.argmax(axis=1)
    return np.where(gain[every, own] >= gain[every, best] - 1e-9, own, best)


def classed_bigrams(bigrams: DataFrame, groups: DataFrame, words: int, classes: int,
                    broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(a, b, n, ca, cb): bigrams with both classes from ``groups`` (w, class); ``classes`` for other words."""
    out = bigrams
    for word in ("a", "b"):
        known = groups.select(F.col("w").alias(word), F.col("class").alias(f"c{word}"))
        out = out.join(F.broadcast(known) if words <= broadcast_words else known, word, "left")
    return out.select("a", "b", "n", *(F.coalesce(c, F.lit(classes)).cast("int").alias(c) for c in ("ca", "cb")))


def class_counts(classed: DataFrame, size: int) -> np.ndarray:
    """Counts of class after class; ``size`` squared numbers come to the driver."""
    table = np.zeros((size, size))
    for row in classed.groupBy("ca", "cb").agg(F.sum("n").alias("n")).collect():
        table[row["ca"], row["cb"]] = row["n"]
    return table


def class_table(bigrams: DataFrame, classes: np.ndarray, size: int) -> np.ndarray:
    """``class_counts`` of words whose classes are an array, the last for all others."""
    groups = class_rows(bigrams, classes[:-1])
    return class_counts(classed_bigrams(bigrams, groups, len(classes) - 1, int(classes[-1])), size)


def class_rows(bigrams: DataFrame, classes: np.ndarray) -> DataFrame:
    return bigrams.sparkSession.createDataFrame(list(enumerate(classes.tolist())), "w long, class int")


# The neighbouring classes of the words whose turn it is, a row per range of words. Cells up to the number of classes count what follows
# a word, those above what precedes it. Range ``TABLE`` has the counts of class after class instead.
NEIGHBOURS = "range long, w array<long>, own array<int>, cell array<int>, n array<long>"
TABLE = -1

# The same for the exchange itself: word, own class and cell as one number, ascending, and how often.
PACKED = "range long, keys binary, n binary"


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one, in order."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(n[order], starts)


def _keys(w: np.ndarray, own: np.ndarray, cell: np.ndarray, size: int) -> np.ndarray:
    return (w.astype(np.int64) * size + own) * (2 * size) + cell


def _of_keys(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rest, cell = np.divmod(keys, 2 * size)
    return *np.divmod(rest, size), cell


def _added(w: np.ndarray, own: np.ndarray, cell: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Equal (w, own, cell) as one, in order."""
    keys, n = _summed(_keys(w, own, cell, size), n)
    return *_of_keys(keys, size), n


def _numbers(n: np.ndarray) -> bytes:
    return n.astype(np.int32 if n.max(initial=0) < 1 << 31 else np.int64).tobytes()


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and numbers of all rows of a range."""
    keys = [np.frombuffer(x, np.int64) for x in rows["keys"].to_pylist()]
    n = [np.frombuffer(x, f"i{len(x) // max(1, len(k))}").astype(np.int64) if len(k) else k for k, x in zip(keys, rows["n"].to_pylist())]
    return np.concatenate(keys), np.concatenate(n)


def _neighbour_rows(w: np.ndarray, own: np.ndarray, cell: np.ndarray, n: np.ndarray, ranges: int,
                    table: np.ndarray, packed: bool = False) -> pa.RecordBatch:
    if packed:
        keys = _keys(w, own, cell, math.isqrt(len(table)))
        owner = np.zeros(len(w), np.int64)
        if ranges > 1 and len(w):
            owner = w % ranges
            order = np.argsort(owner.astype(np.uint16) if ranges <= 1 << 16 else owner, kind="stable")
            keys, n, owner = keys[order], n[order], owner[order]
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))[:len(owner)]
        met = np.flatnonzero(table)
        pieces = [(int(owner[i]), keys[i:j], n[i:j]) for i, j in zip(cuts, np.append(cuts[1:], len(keys)))]
        pieces.append((TABLE, met, table[met]))
        return pa.RecordBatch.from_arrays(
            [pa.array([r for r, _, _ in pieces], pa.int64()), pa.array([k.astype(np.int64).tobytes() for _, k, _ in pieces], pa.binary()),
             pa.array([_numbers(x) for _, _, x in pieces], pa.binary())], names=["range", "keys", "n"])
    order = np.argsort(w % ranges, kind="stable")
    owner = (w % ranges)[order]
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))[:len(owner)]
    met = np.flatnonzero(table)
    ends = pa.array(np.concatenate((starts, [len(order), len(order) + len(met)])).astype(np.int32))
    none = np.zeros(len(met), np.int64)
    columns = [(np.append(x[order], more), kind) for x, more, kind in (
        (w, none, np.int64), (own, none, np.int32), (cell, met, np.int32), (n, table[met], np.int64))]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.append(owner[starts], TABLE)), *(pa.ListArray.from_arrays(ends, pa.array(x.astype(kind))) for x, kind in columns)],
        names=["range", "w", "own", "cell", "n"])


def bigram_neighbours(bigrams: DataFrame, words: int, classes: int):
    """Neighbour rows from a table of bigrams (a, b, n), for ``exchange_words``."""
    size, ranges = classes + 1, max(1, -(-words // RANGE_WORDS))

    def count(groups: DataFrame, turn: int, parts: int, packed: bool = False) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def flush() -> pa.RecordBatch:
                entries = _added(*(np.concatenate(x) for x in zip(*held)), size)
                return _neighbour_rows(*entries, ranges, table, packed)

            held, rows, table = [], 0, np.zeros(size * size, np.int64)
            for batch in batches:
                a, b, n, ca, cb = (batch.column(c).to_numpy() for c in ("a", "b", "n", "ca", "cb"))
                np.add.at(table, ca.astype(np.int64) * size + cb, n)
                for w, own, cell in ((a, ca, cb), (b, cb, ca + size)):
                    moves = (w < words) & (w % parts == turn % parts)
                    held.append((w[moves], own[moves], cell[moves], n[moves]))
                    rows += int(moves.sum())
                if rows >= COMBINED:
                    yield flush()
                    held, rows, table = [], 0, np.zeros(size * size, np.int64)
            if held:
                yield flush()

        return classed_bigrams(bigrams, groups, words, classes).mapInArrow(pack, PACKED if packed else NEIGHBOURS)

    return count


def counted_neighbours(flat: np.ndarray, w: np.ndarray, group: np.ndarray, turn: int, parts: int,
                       classes: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The neighbours (w, own, cell, n) of training tokens, given by local words with their numbers (-1: not clustered) and
    classes, and the counts of class after class. Every document closes with the end token, which precedes a first word."""
    size = classes + 1
    moving = (w >= 0) & (w % parts == turn % parts)
    table, keys, counts = np.zeros(size * size, np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a in range(0, len(flat), SLICE_TOKENS):
        part = flat[a:a + SLICE_TOKENS]
        here = group[part]
        before = np.append(group[flat[a - 1]], here[:-1])
        after = np.append(here[1:], group[flat[(a + len(part)) % len(flat)]])
        table += np.bincount(before * size + here, minlength=size * size)
        at = np.flatnonzero(moving[part])
        word = part[at].astype(np.int64) * (2 * size)
        found = np.concatenate((word + after[at], word + before[at] + size))
        found.sort()
        starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))[:len(found)]
        keys.append(found[starts])
        counts.append(np.diff(starts, append=len(found)))
    found, n = _summed(np.concatenate(keys), np.concatenate(counts))
    spot, cell = found // (2 * size), found % (2 * size)
    return (w[spot], group[spot], cell, n), table


def neighbour_entries(flat: np.ndarray, w: np.ndarray, group: np.ndarray, turn: int, parts: int, classes: int, ranges: int,
                      packed: bool = False) -> pa.RecordBatch:
    """``counted_neighbours`` as neighbour rows."""
    entries, table = counted_neighbours(flat, w, group, turn, parts, classes)
    return _neighbour_rows(*entries, ranges, table, packed)


def numbered_chunks(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """``chunk, w, tokens``: the training tokens of a chunk and the number of each of its words (-1: not clustered).
    ``places`` (chunk, spot, w) names the words; tokens stay in their bucket."""

    def number(chunk: pa.Table, reply: pa.Table) -> pa.Table:
        names = ["chunk", "w", "tokens"]
        if not chunk.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=names)
        row = {c: chunk[c].combine_chunks()[0] for c in chunk.column_names}
        flat = np.frombuffer(row["tokens"].as_buffer(), np.uint32)
        spots = reply["spot"].to_numpy()
        w = np.full(max(int(flat.max(initial=0)), int(spots.max(initial=0))) + 1, -1)
        w[spots] = reply["w"].to_numpy()
        flat = flat[~np.repeat(row["held"].values.to_numpy(zero_copy_only=False), row["sizes"].values.to_numpy())]
        return pa.table([pa.array([row["chunk"].as_py()]), pa.array([w.tobytes()], pa.binary()),
                         pa.array([flat.tobytes()], pa.binary())], names=names)

    left = chunks.select("chunk", "held", "sizes", "tokens")
    return (left.groupBy("chunk").cogroup(places.select(F.col("chunk").alias("for_chunk"), "spot", "w").groupBy("for_chunk"))
            .applyInArrow(number, "chunk long, w binary, tokens binary"))


def chunk_neighbours(numbered: DataFrame, places: DataFrame, words: int, classes: int, sent_words: int = SENT_WORDS):
    """Neighbour rows from the chunks themselves, for ``exchange_words``: a chunk adds up its neighbours per word and
    class, so pairs of words are never written. The classes of at most ``sent_words`` words are sent to every
    task as one array; those of more come to each chunk for its own words by a join."""
    ranges = max(1, -(-words // RANGE_WORDS))

    def read(row: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return (np.frombuffer(row["tokens"].combine_chunks()[0].as_buffer(), np.uint32),
                np.frombuffer(row["w"].combine_chunks()[0].as_buffer(), np.int64))

    def by_array(groups: DataFrame, turn: int, parts: int, packed: bool = False) -> DataFrame:
        table = groups.toArrow()
        known = np.full(words + 1, classes, np.int16)
        known[table["w"].to_numpy()] = table["class"].to_numpy()
        sent = numbered.sparkSession.sparkContext.broadcast(known)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def flush() -> pa.RecordBatch:
                return _neighbour_rows(*_added(*(np.concatenate(x) for x in zip(*held)), classes + 1), ranges, table, packed)

            held, size, table = [], 0, 0
            for batch in batches:
                for k in range(batch.num_rows):
                    flat, w = read(pa.table(batch.slice(k, 1)))
                    entries, counts = counted_neighbours(flat, w, sent.value[w].astype(np.int64), turn, parts, classes)
                    held.append(entries)
                    size, table = size + len(entries[0]), table + counts
                    if size >= HELD:
                        yield flush()
                        held, size, table = [], 0, 0
            if held:
                yield flush()

        return numbered.select("w", "tokens").mapInArrow(pack, PACKED if packed else NEIGHBOURS)

    def by_join(groups: DataFrame, turn: int, parts: int, packed: bool = False) -> DataFrame:
        def pack(chunk: pa.Table, reply: pa.Table) -> pa.Table:
            def group_of(w: np.ndarray) -> np.ndarray:
                group = np.full(len(w), classes)
                group[reply["spot"].to_numpy()] = reply["class"].to_numpy()
                return group

            if not chunk.num_rows:
                return pa.Table.from_batches([neighbour_entries(*(np.empty(0, np.int64),) * 3, turn, parts, classes, ranges, packed)])
            flat, w = read(chunk)
            return pa.Table.from_batches([neighbour_entries(flat, w, group_of(w), turn, parts, classes, ranges, packed)])

        replies = places.join(groups, "w").select(F.col("chunk").alias("for_chunk"), "spot", "class")
        return numbered.groupBy("chunk").cogroup(replies.groupBy("for_chunk")).applyInArrow(pack, PACKED if packed else NEIGHBOURS)

    by_array.batch_rows = 1  # a chunk at a time
    return by_array if words <= sent_words else by_join


def table_of(neighbours: DataFrame, size: int) -> np.ndarray:
    """Counts of class after class from packed rows; ``size`` squared numbers come to the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for batch in batches:
            if batch.num_rows:
                cells, n = _unpacked(pa.table(batch))
                np.add.at(table, cells, n)
        met = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(table[met])], names=["cell", "n"])

    cells = neighbours.filter(F.col("range") == TABLE).select("keys", "n").mapInArrow(add, "cell long, n long")
    table = np.zeros(size * size)
    for row in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[row["cell"]] = row["n"]
    return table.reshape(size, size)


def better_classes(neighbours: DataFrame, table: np.ndarray, classes: int) -> DataFrame:
    """(w, best): the words whose turn it is and that another class suits better. The sums of a range of words meet in
    one group."""
    size = classes + 1
    sent = neighbours.sparkSession.sparkContext.broadcast(table)

    def move(rows: pa.Table) -> pa.Table:
        keys, n = _summed(*_unpacked(rows))
        w, own, cell = _of_keys(keys, size)
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))[:len(w)]
        found, place = w[first], np.repeat(np.arange(len(first)), np.diff(first, append=len(w)))
        best = np.empty(len(found), np.int64)
        for at in range(0, len(found), TOGETHER):
            some = slice(*np.searchsorted(place, (at, at + TOGETHER)))
            seen = np.zeros((min(TOGETHER, len(found) - at), 2 * size))
            seen[place[some] - at, cell[some]] = n[some]
            best[at:at + TOGETHER] = best_classes(
                sent.value, own[first[at:at + TOGETHER]], seen[:, :size], seen[:, size:], classes)
        moved = best != own[first]
        return pa.table([pa.array(found[moved]), pa.array(best[moved].astype(np.int32))], names=["w", "best"])

    return neighbours.filter(F.col("range") != TABLE).groupBy("range").applyInArrow(move, "w long, best int")


def exchange_words(count: Callable[[DataFrame, int, int], DataFrame], dealt: DataFrame, words: int, classes: int = CLASSES,
                   half_sweeps: int | None = None, tolerance: float = TOLERANCE) -> tuple[DataFrame, np.ndarray]:
    """Exchange clustering from the classes ``dealt`` (w, class): the written classes and the class table. ``count`` gives
    the neighbour rows of classes, turn and parts; it is handed ``count.batch_rows`` rows at a time, if it says so.

    By turns, every second word moves to the class that raises the likelihood most while the others stand
    still. Words that move together may spoil each other's gain: a turn that lowers the likelihood is
    undone, and from then on half as many move at once. It ends when a turn of all words has gained less than
    ``tolerance`` of all gains so far (or when one word in ``MOST_PARTS`` at a time still lowers the likelihood, or after
    ``half_sweeps`` turns, if given). Words that are not in ``dealt`` keep one class of their own. Only class tables reach the driver.
    """
    size, batch_rows = classes + 1, getattr(count, "batch_rows", 0)
    groups = write_table(dealt, "classes")
    turn, parts, gains = 0, 2, []
    seen = write_table(count(groups, turn, parts, True), "neighbours", release=True, batch_rows=batch_rows)
    table = table_of(seen, size)
    start = objective(table)
    while words and (half_sweeps is None or turn < half_sweeps):
        proposal = write_table(groups.join(better_classes(seen, table, classes), "w", "left").select(
            "w", F.coalesce("best", "class").alias("class")), "classes", release=True)
        drop_table(seen)
        turn += 1
        seen = write_table(count(proposal, turn, parts, True), "neighbours", release=True, batch_rows=batch_rows)
        changed = table_of(seen, size)
        if objective(changed) < objective(table):
            drop_table(proposal)
            drop_table(seen)
            parts, gains = 2 * parts, []
            if parts > MOST_PARTS:
                return groups, table
            seen = write_table(count(groups, turn, parts, True), "neighbours", release=True, batch_rows=batch_rows)
            continue
        drop_table(groups)
        gains.append(objective(changed) - objective(table))
        groups, table = proposal, changed
        if len(gains) >= parts and sum(gains[-parts:]) <= tolerance * (objective(table) - start):
            break
    drop_table(seen)
    return groups, table


def exchange(bigrams: DataFrame, counts: np.ndarray, classes: int = CLASSES,
             half_sweeps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``exchange_words`` of few words, dealt out by frequency: the class of each and, last, of all others."""
    words = len(counts)
    current = np.full(words + 1, classes, np.int64)
    current[np.argsort(-counts, kind="stable")] = np.arange(words) % classes
    groups, table = exchange_words(
        bigram_neighbours(bigrams, words, classes), class_rows(bigrams, current[:-1]), words, classes, half_sweeps)
    for row in groups.collect():
        current[row["w"]] = row["class"]
    drop_table(groups)
    return current, table


@dataclass
class ClassModel:
    """Log10 probabilities. The class after all others stands for every unknown word."""

    transitions: np.ndarray  # from class, to class
    mass: np.ndarray  # discounted count of each class
    discount: float
    tokens: int
    types: int

    def emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        known = counts > 0
        share = np.where(known, counts - self.discount, 1.0) / np.where(known, self.mass[classes], 1.0)
        return np.log10(share)


def smoothed(table: np.ndarray, sizes: np.ndarray, counts: np.ndarray, types: np.ndarray, once: int, twice: int,
             backoff: float = BACKOFF) -> ClassModel:
    """Absolute discounting: every known word gives ``discount`` of its count to the unknown, and the
    transitions fall back on the classes' own frequencies."""
    discount = once / (once + 2 * twice) if once and twice else 0.5
    mass = np.append(counts - discount * types, discount * types.sum())
    total = max(counts.sum(), 1)
    own = mass / total if counts.sum() else np.append(np.zeros(len(counts)), 1.0)
    kept = np.divide(mass[:-1], counts, out=np.zeros(len(counts)), where=counts > 0)
    wide = np.zeros((len(mass), len(mass)))
    wide[:-1, :-1] = table * kept
    wide[:-1, -1] = (table * (1 - kept)).sum(axis=1)
    with np.errstate(divide="ignore"):
        log = np.log10((wide + backoff * own) / (wide.sum(axis=1, keepdims=True) + backoff))
    return ClassModel(log, mass, discount, int(counts.sum()), int(types.sum()))


def score_documents(docs: DataFrame, folds: int = 7, fold: int = 2, key: str = "doc_id", text: str = "text",
                    classes: int = CLASSES, frequent_share: float = FREQUENT, half_sweeps: int | None = None,
                    chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Learns from the documents outside a fold and scores all: key, held_out, n_tokens, n_known,
    train_tokens, base_score (add-one unigrams) and score (class bigrams), in log10.

    Words are runs of bytes other than ASCII white space with A-Z lower-cased; a document ends with one
    end token. Null and empty texts are the end token alone. Repeated rows are learned from and
    scored each; other columns are not read. Without training documents every token is unknown and scores 0.

    All counts cover all training documents. Words that occur at least ``CLUSTERED`` times and have at least
    ``frequent_share`` of the tokens are clustered; the others form one class. Words met once are that class because
    they are what unknown words are like: its transitions tell where new words come up.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with session_settings(docs.sparkSession, {BATCH_ROWS: "1000"}):
        chunks = write_bucketed(text_chunks(docs, folds, fold, key, text, chunk_tokens), "chunk", buckets, "chunks")
    local = chunks.select(F.inline(F.arrays_zip("words", "train")))
    vocabulary = write_in_order(local.groupBy("words").agg(F.sum("train").alias("n")).filter("n > 0"),
                                F.desc("n"), "words", label="vocabulary")
    types, tokens, once, twice = vocabulary.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    common = F.col("n") >= max(float(CLUSTERED), frequent_share * tokens)
    words = vocabulary.filter(common).count()
    ranked = with_total_before(vocabulary, F.lit(1), "before").select(
        "words", "n", (F.col("before") + F.col("row")).alias("w"))
    asked = chunks.select("chunk", F.posexplode("words").alias("spot", "words"))
    places = write_table(asked.join(ranked.filter(common), "words").select("chunk", "spot", "w"), "places", release=True)
    dealt = ranked.filter(common).select("w", (F.col("w") % classes).cast("int").alias("class"))
    numbered = write_bucketed(numbered_chunks(chunks, places), "chunk", buckets, "numbered")
    groups, table = exchange_words(chunk_neighbours(numbered, places, words, classes), dealt, words, classes, half_sweeps)
    drop_table(places)
    drop_table(numbered)
    found = F.broadcast(groups) if words <= BROADCAST_WORDS else groups
    known = ranked.join(found, "w", "left").select(
        "words", "n", F.coalesce("class", F.lit(classes)).cast("int").alias("class"))
    members, in_class = np.zeros(classes + 1, np.int64), np.zeros(classes + 1, np.int64)
    for row in known.groupBy("class").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("n")).collect():
        members[row["class"]], in_class[row["class"]] = row["types"], row["n"]
    model = smoothed(table, members, in_class, members, once, twice)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    replies = asked.join(known, "words").select(F.col("chunk").alias("for_chunk"), "spot", "n", "class")
    (out,) = fresh(docs.select(), key)
    schema = (f"`{out}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")

    def score(chunk: pa.Table, reply: pa.Table) -> pa.Table:
        model = sent.value
        names = [out, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not chunk.num_rows:
            return pa.table({n: [] for n in names})
        row = {c: chunk[c].combine_chunks()[0] for c in chunk.column_names}
        flat = np.frombuffer(row["tokens"].as_py(), np.uint32)
        sizes = row["sizes"].values.to_numpy().astype(np.int64)
        counts = np.zeros(int(flat.max()) + 1, np.int64)
        group = np.full(len(counts), len(model.mass) - 1, np.int64)
        spots = reply["spot"].to_numpy()
        counts[spots], group[spots] = reply["n"].to_numpy(), reply["class"].to_numpy()
        base = np.log10((counts + 1) / (model.tokens + model.types + 1))
        emitted = model.emission(counts, group)
        starts = np.cumsum(sizes) - sizes
        order = group[flat]
        previous = np.empty_like(order)
        previous[1:] = order[:-1]
        # A text begins after an end token, which closes every document.
        previous[starts] = order[starts + sizes - 1]
        logs = emitted[flat] + model.transitions[previous, order]
        return pa.table([
            row["doc_ids"].values, row["held"].values, pa.array(sizes),
            pa.array(np.add.reduceat((counts > 0)[flat].astype(np.int64), starts)),
            pa.array(np.full(len(sizes), model.tokens, np.int64)),
            pa.array(np.add.reduceat(base[flat], starts)), pa.array(np.add.reduceat(logs, starts))], names=names)

    left = chunks.select("chunk", "doc_ids", "held", "sizes", "tokens")
    return left.groupBy("chunk").cogroup(replies.groupBy("for_chunk")).applyInArrow(score, schema)
