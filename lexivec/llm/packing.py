"""Packing of token pieces into sequences by a configuration linear program.

The program has a variable per configuration (how many pieces of each length share a sequence).
It is solved on the histogram of lengths, which has at most ``capacity`` rows however large the
corpus, by multiplicative weights; a knapsack dynamic program prices the configurations. What rounding
leaves over is put by best fit into the gaps and into new sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexivec.llm.encoders import WordEncoder, encoder
from lexivec.sources.shared_tables import write_table

ROUNDS = 60
STEP = 0.1
NEAR_BEST = 0.02
BUCKET_PIECES = 1 << 13
BATCH_TEXTS = 256
BATCH_ROWS = 1000  # texts handed to Python at a time

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int,
                 key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32 and,
    ``with_ids``, the ids. A document is its ids and ``end_id``; a null text counts as empty. Other
    columns are not read; repeated rows stay."""
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(WordEncoder, path)
        for batch in batches:
            out: list[tuple] = []
            docs_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first in range(0, len(texts), BATCH_TEXTS):
                some_ids = coder.encode_many(texts[first:first + BATCH_TEXTS])
                for doc, ids in zip(docs_of[first:], some_ids):
                    packed = np.append(ids.astype("<u4"), np.uint32(end_id))
                    for n, at in enumerate(range(0, len(packed), capacity)):
                        some = packed[at:at + capacity]
                        out.append((doc, n, at, len(some), zlib.crc32(some.tobytes()), some.astype(np.int32) if with_ids else None))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            if with_ids:
                names, kinds = [*names, "ids"], [*kinds, pa.list_(pa.int32())]
            cols = [pa.array([r[k] for r in out], type=t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(pieces, schema)


def best_fillings(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value within each capacity 0..capacity, and the length taken last
    (0: one token stays free)."""
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(lengths, c, "right"))
        best[c] = best[c - 1]
        if k:
            gains = best[c - lengths[:k]] + values[:k]
            at = int(np.argmax(gains))
            if gains[at] > best[c]:
                best[c], taken[c] = gains[at], lengths[at]
    return best, taken


def filling(taken: np.ndarray, capacity: int) -> list[int]:
    out = []
    while capacity > 0:
        if taken[capacity]:
            out.append(int(taken[capacity]))
            capacity -= int(taken[capacity])
        else:
            capacity -= 1
    return out


def solve_configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int,
                         rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """A fractional covering of the counts: configuration (descending lengths) to its amount.

    Each round prices all lengths with their weights in one dynamic program. Of the configurations
    "this length and the best filling of the rest" those worth nearly the most get a step that
    covers at most ``STEP`` of any length's count. Weights fall exponentially with the share covered, so what
    is uncovered becomes dear. Covered lengths leave the program.
    """
    where = {int(n): k for k, n in enumerate(lengths)}
    covered, amounts = np.zeros(len(lengths)), {}
    for _ in range(rounds):
        open_ = covered < 1
        if not open_.any():
            break
        left = lengths[open_]
        weights = left / capacity * np.exp(-covered[open_])
        best, taken = best_fillings(weights, left, capacity)
        worth = weights + best[capacity - left]
        # Anchors that no good configuration holds are taken too: they must be covered all the same.
        order = np.argsort(-worth, kind="stable")
        chosen = [k for k in order if worth[k] >= (1 - NEAR_BEST) * worth[order[0]]]
        chosen += [k for k in order if 2 * left[k] > capacity and worth[k] < (1 - NEAR_BEST) * worth[order[0]]]
        for k in chosen:
            config = tuple(sorted([int(left[k]), *filling(taken, capacity - int(left[k]))], reverse=True))
            kinds, copies = np.unique(config, return_counts=True)
            spots = [where[int(n)] for n in kinds]
            room = ((1 - covered[spots]) * counts[spots] / copies).min()
            step = min(room, (STEP * counts[spots] / copies).min())
            if step > 0:
                amounts[config] = amounts.get(config, 0.0) + float(step)
                covered[spots] += copies * step / counts[spots]
    return amounts


def round_configurations(amounts: dict[tuple[int, ...], float], lengths: np.ndarray, counts: np.ndarray,
                         capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of configurations that hold every piece exactly once.

    Amounts are rounded down with what is lost carried on to the next, within the counts left. Pieces
    left over go, longest first, into the fullest sequences with room, equal sequences at once.
    """
    left = {int(n): int(c) for n, c in zip(lengths, counts)}
    groups: dict[tuple[int, ...], int] = {}
    carried = 0.0
    for config in sorted(amounts, key=lambda c: (sum(c) - capacity, c), reverse=True):
        carried += amounts[config]
        need: dict[int, int] = {}
        for n in config:
            need[n] = need.get(n, 0) + 1
        times = min(int(carried + 1e-9), *(left[n] // k for n, k in need.items()))
        if times > 0:
            groups[config] = groups.get(config, 0) + times
            carried -= times
            for n, k in need.items():
                left[n] -= times * k
    gaps: list[int] = []  # sorted
    by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(config: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(config)
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append((config, times))

    for config, times in groups.items():
        put(config, times)
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                if todo >= each:
                    put((n,) * each, todo // each)
                if todo % each:
                    put((n,) * (todo % each), 1)
                break
            gap = gaps[at]
            config, times = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(at)
            used = min(times, todo)
            if used < times:
                put(config, times - used)
            put((*config, n), used)
            todo -= used
    return [g for held in by_gap.values() for g in held if g[1]]


def places(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length the rows (first rank, sequences, first sequence, offset): of the pieces of that
    length, those ranked from ``first rank`` on fill one slot of consecutive sequences."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for config, times in sorted(groups):
        offset = 0
        for n in config:
            rows.setdefault(n, []).append((ranks.get(n, 0), times, sequence, offset))
            ranks[n] = ranks.get(n, 0) + times
            offset += n
        sequence += times
    return {n: np.asarray(r, dtype=np.int64) for n, r in rows.items()}


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``: a number from 0 within the length. Equal lengths are dealt to buckets by a hash
    of the row, so a common length is many groups; the buckets' counts give their first ranks."""
    total = pieces.count()
    buckets = max(1, -(-total // BUCKET_PIECES))
    order = [c for c in pieces.columns if c != "length"]
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy(*order)
    rows = rows.withColumn("within", F.row_number().over(within) - 1)
    return rows.join(firsts, ["length", "bucket"]).select(
        *pieces.columns, (F.col("first") + F.col("within")).alias("rank"))


def pack(pieces: DataFrame, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (written, with ``length`` from 1 to ``capacity``) plus sequence_id and offset.

    The driver sees the histogram only, and sends back a table of configurations whose size
    depends on ``capacity`` and ``rounds``, not on the number of pieces. An empty table stays empty.
    """
    found = pieces.groupBy("length").count().orderBy("length").collect()  # at most `capacity` rows
    lengths = np.asarray([r["length"] for r in found], dtype=np.int64)
    counts = np.asarray([r["count"] for r in found], dtype=np.int64)
    amounts = solve_configurations(lengths, counts, capacity, rounds) if len(found) else {}
    table = places(round_configurations(amounts, lengths, counts, capacity))
    rows = ranked(pieces)
    kept = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    sent = pieces.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            sequences, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for n in np.unique(sizes):
                at = sizes == n
                rows_of = sent.value[int(n)]
                spot = rows_of[np.searchsorted(rows_of[:, 0], ranks[at], "right") - 1]
                sequences[at] = spot[:, 2] + ranks[at] - spot[:, 0]
                offsets[at] = spot[:, 3]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequences), pa.array(offsets)], names=schema.names)

    return rows.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenizes, cuts and packs: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(write_table(token_pieces(docs, path, capacity, end_id), "pieces", batch_rows=BATCH_ROWS), capacity)
