"""Passages that stand elsewhere too, found by sorting suffixes block by block.

A byte goes if a string of ``min_bytes`` that covers it starts at another place as well, in the same text or
another one. Two suffixes share that many bytes iff they are neighbours, or next to neighbours of that kind, in the
suffix array; so it is enough to bring suffixes with equal heads together.

1. *Cover sample.* ``cover`` is a difference cover modulo ``v``: whatever two positions are, some shift below ``v`` takes
   both to sampled positions. Hence two suffixes that agree in ``min_bytes`` bytes lead, after at most ``v - 1`` bytes, to
   two sampled windows of ``min_bytes - v + 1`` bytes that agree. About an eighth of all positions are sampled.
   Their windows are ranked bucket by bucket; what the next step needs of a rank is whether it is shared.
2. *Blocks of suffixes.* A suffix that reaches no window of a shared rank differs from all others early on and leaves
   without being sorted. The others go, as fingerprints of their heads, to buckets, and one bucket after
   another is sorted. Suffixes that tie there, and reached a window of a shared rank, are repeated.
3. Every text then marks the bytes that its repeated suffixes' heads cover.

Texts never leave their part: a table bucketed by part is read once per step, and only numbers are shuffled, each once
per part that holds it, so a passage in a third of all texts costs one number per part. Parts (about ``PART_BYTES``) and buckets
(the session's shuffle partitions times ``BUCKETS_PER_PARTITION``) bound what a task holds at once. Copies of a whole text are put
together first, and are known to be repeated.

Fingerprints have 64 bits beside the bucket's, so texts of ``n`` bytes expect about ``n * n / 2 ** 65 / buckets`` wrong ties
(fewer than 1e-5 for a gigabyte), and a wrong tie counts only for a suffix that reached a shared window.

Defined cases: a null text is empty; texts shorter than ``min_bytes`` keep everything; repeated rows are copies of each other
and lose everything if long enough, whatever their key; keys may be null; other columns stay as they are. Offsets are bytes of
UTF-8, so a cut may fall inside a character and ``kept`` is binary. A text longer than a part is a part of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import fresh
from lexivec.sources.shared_tables import write_bucketed, write_table

MIN_BYTES = 200
PART_BYTES = 1 << 23
BUCKETS_PER_PARTITION = 2
SLICE = 1 << 15  # positions whose windows are read together, so that numbers stay in the cache
# Perfect difference sets. Every difference modulo the number comes up once.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}
LEAST_BYTES = 18

PART_ROWS = "part long, keys array<string>, lengths array<long>, copies array<long>, data binary"
SENT_ROWS = "bucket long, part long, numbers binary"
MARK_ROWS = "part long, bucket long, marks binary"
CUT_ROWS = "key string, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"


def cover_for(min_bytes: int) -> tuple[int, np.ndarray]:
    """The modulus and the set: the largest that leaves windows of three fifths of the length."""
    modulus = max(v for v in COVERS if 5 * v <= 2 * min_bytes)
    return modulus, np.array(COVERS[modulus])


def fingerprints(data: bytes, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """64 bits of each string of ``size`` (8 or more) bytes of ``data`` that starts at a place in ``at``."""
    words = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    steps = [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]
    out = np.empty(len(at), np.uint64)
    for low in range(0, len(at), SLICE):
        spots, h = at[low:low + SLICE], out[low:low + SLICE]
        h[:] = seed
        for step in steps:
            h ^= words[spots + step]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return out


def bucket_of(numbers: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the number: the upper half decides."""
    return ((numbers >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Part:
    """The texts of one part, one behind the other, and their sampled windows and suffixes."""

    def __init__(self, lengths: np.ndarray, data: bytes, min_bytes: int):
        self.data, self.min_bytes = data, min_bytes
        self.lengths = np.asarray(lengths, np.int64)
        self.modulus, cover = cover_for(min_bytes)
        self.window = min_bytes - self.modulus + 1
        sampled = np.zeros(len(data) + self.modulus, bool)
        for c in cover:
            sampled[c::self.modulus] = True
        self.starts = np.cumsum(self.lengths) - self.lengths
        for start, length in zip(self.starts.tolist(), self.lengths.tolist()):
            sampled[start + max(0, length - self.window + 1):start + length] = False
        self.samples = np.flatnonzero(sampled[:len(data)])

    def windows(self) -> np.ndarray:
        """Fingerprints of the sampled windows, the lower half of which is sent."""
        return fingerprints(self.data, self.samples, self.window, 0x5851F42D4C957F2D)

    def suffixes(self, shared: np.ndarray) -> np.ndarray:
        """Starts that reach a sampled window with a shared rank and have ``min_bytes`` before their text ends."""
        reach = np.zeros(len(self.data) + 1, np.int32)
        spots = self.samples[shared]
        np.add.at(reach, np.maximum(spots - self.modulus + 1, 0), 1)
        reach[spots + 1] -= 1
        fit = np.cumsum(reach[:-1]) > 0
        for start, length in zip(self.starts.tolist(), self.lengths.tolist()):
            fit[start + max(0, length - self.min_bytes + 1):start + length] = False
        return np.flatnonzero(fit)

    def heads(self, spots: np.ndarray) -> np.ndarray:
        return fingerprints(self.data, spots, self.min_bytes, 0x14057B7EF767814F)

    def covered(self, spots: np.ndarray) -> np.ndarray:
        """Which bytes the heads at these starts cover; none reaches over its text's end."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        edge[spots] += 1
        edge[spots + self.min_bytes] -= 1
        return np.cumsum(edge[:-1]) > 0


class Numbers:
    """The distinct numbers of a part in order, and what the buckets' marks say of them."""

    def __init__(self, numbers: np.ndarray, buckets: int, kind: str):
        self.distinct, self.places, counts = np.unique(numbers, return_inverse=True, return_counts=True)
        self.twice, self.kind = counts > 1, kind
        owner = bucket_of(self.distinct, buckets)
        self.buckets, firsts = np.unique(owner, return_index=True)
        self.ends = np.append(firsts, len(owner))

    def rows(self, part: int) -> pa.RecordBatch:
        low = (self.distinct & np.uint64(0xFFFFFFFF)).astype("<u4") if self.kind == "<u4" else self.distinct
        sent = [low[a:b].tobytes() for a, b in zip(self.ends[:-1], self.ends[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.buckets, pa.int64()), pa.array(np.full(len(sent), part), pa.int64()), pa.array(sent, pa.binary())],
            names=["bucket", "part", "numbers"])

    def shared(self, marks: dict[int, bytes]) -> np.ndarray:
        """Per number given: does it stand elsewhere, here or in another part?"""
        met = self.twice.copy()
        for bucket, a, b in zip(self.buckets.tolist(), self.ends[:-1], self.ends[1:]):
            if bucket in marks:
                met[a:b] |= np.unpackbits(np.frombuffer(marks[bucket], np.uint8), count=b - a).astype(bool)
        return met[self.places]


def packed_parts(texts: DataFrame, part_bytes: int) -> DataFrame:
    """Rows of ``text`` and ``copies`` put together in parts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        held: list[tuple[str, int, int, bytes]] = []
        size = 0

        def full() -> pa.RecordBatch:
            keys, lengths, copies, data = map(list, zip(*held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([keys], pa.list_(pa.string())), pa.array([lengths], pa.list_(pa.int64())),
                 pa.array([copies], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.binary())],
                names=["part", "keys", "lengths", "copies", "data"])

        for batch in batches:
            for text, copies in zip(batch.column(0), batch.column(1).to_pylist()):
                data = text.as_py().encode()
                if held and size + len(data) > part_bytes:
                    yield full()
                    held, size, part = [], 0, part + 1
                held.append((hashlib.sha256(data).hexdigest(), len(data), copies, data))
                size += len(data)
        if held:
            yield full()

    return texts.select("text", "copies").mapInArrow(pack, PART_ROWS)


def marked(sent: DataFrame, kind: str) -> DataFrame:
    """Sorts one bucket after another; per part, a bit for each number sent that another part sent too."""

    def sort(bucket: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, kind) for x in bucket.column("numbers").to_pylist()]
        numbers = np.concatenate(rows)
        order = np.argsort(numbers, kind="stable")
        ordered = numbers[order]
        tie = ordered[1:] == ordered[:-1]
        met = np.zeros(len(numbers), bool)
        met[1:] |= tie
        met[:-1] |= tie
        marks = np.empty(len(numbers), bool)
        marks[order] = met
        ends = np.cumsum([0, *map(len, rows)])
        bits = [np.packbits(marks[a:b]).tobytes() if marks[a:b].any() else None for a, b in zip(ends[:-1], ends[1:])]
        out = pa.table({"part": bucket.column("part"), "bucket": bucket.column("bucket"), "marks": pa.array(bits, pa.binary())})
        return out.filter(pa.compute.is_valid(out.column("marks")))

    return sent.groupBy("bucket").applyInArrow(sort, MARK_ROWS)


def _by_bucket(rows: pa.Table) -> dict[int, bytes]:
    return dict(zip(rows.column("bucket").to_pylist(), rows.column("marks").to_pylist()))


def _texts_of(row: pa.Table, min_bytes: int) -> Part:
    return Part(np.array(row.column("lengths")[0].as_py()), row.column("data")[0].as_py(), min_bytes)


def sampled_windows(parts: DataFrame, buckets: int, min_bytes: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = pa.table(batch.slice(k, 1))
                yield Numbers(_texts_of(row, min_bytes).windows(), buckets, "<u4").rows(row.column("part")[0].as_py())

    return parts.select("part", "lengths", "data").mapInArrow(send, SENT_ROWS)


def suffix_heads(parts: DataFrame, windows: DataFrame, buckets: int, min_bytes: int) -> DataFrame:
    def send(row: pa.Table, marks: pa.Table) -> pa.Table:
        if not row.num_rows:
            return pa.table(pa.RecordBatch.from_pylist([], row_schema))
        texts = _texts_of(row, min_bytes)
        shared = Numbers(texts.windows(), buckets, "<u4").shared(_by_bucket(marks))
        heads = texts.heads(texts.suffixes(shared))
        return pa.Table.from_batches([Numbers(heads, buckets, "<u8").rows(row.column("part")[0].as_py())])

    row_schema = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("numbers", pa.binary())])
    return (parts.select("part", "lengths", "data").groupBy("part").cogroup(windows.groupBy("part"))
            .applyInArrow(send, SENT_ROWS))


def cut_parts(parts: DataFrame, marks: DataFrame, buckets: int, min_bytes: int) -> DataFrame:
    """``marks`` has those of windows (kind 0) and of suffixes (kind 1)."""
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    schema = pa.schema([("key", pa.string()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])

    def cut(row: pa.Table, marks: pa.Table) -> pa.Table:
        if not row.num_rows:
            return schema.empty_table()
        texts = _texts_of(row, min_bytes)
        own = [_by_bucket(marks.filter(pa.compute.equal(marks.column("kind"), k))) for k in (0, 1)]
        spots = texts.suffixes(Numbers(texts.windows(), buckets, "<u4").shared(own[0]))
        spots = spots[Numbers(texts.heads(spots), buckets, "<u8").shared(own[1])]
        gone, data = texts.covered(spots), np.frombuffer(texts.data, np.uint8)
        spans, kept = [], []
        for start, length, copies in zip(texts.starts, texts.lengths, row.column("copies")[0].as_py()):
            out = gone[start:start + length] if copies == 1 else np.ones(length, bool)
            edges = np.flatnonzero(np.diff(out, prepend=False, append=False)).tolist()
            spans.append([{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2])])
            kept.append(data[start:start + length][~out].tobytes())
        return pa.Table.from_arrays([pa.array(row.column("keys")[0].as_py(), pa.string()), pa.array(texts.lengths),
                                     pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], schema=schema)

    return parts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(cut, CUT_ROWS)


def cut_texts(docs: DataFrame, text: str = "text", min_bytes: int = MIN_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per distinct text of at least ``min_bytes`` bytes: ``key`` (its SHA-256 in hex), ``n_bytes``, ``spans`` (the removed
    runs, in order) and ``kept`` (the remaining bytes)."""
    if min_bytes < LEAST_BYTES:
        raise ValueError(f"passages of fewer than {LEAST_BYTES} bytes are not looked for")
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = partitions * BUCKETS_PER_PARTITION
    texts = (docs.select(F.col(text).alias("text")).filter(F.octet_length("text") >= min_bytes)
             .groupBy("text").agg(F.count(F.lit(1)).alias("copies")))
    parts = write_bucketed(packed_parts(texts, part_bytes), "part", partitions, "parts")
    windows = write_table(marked(sampled_windows(parts, buckets, min_bytes), "<u4"), "windows", release=True)
    heads = write_table(marked(suffix_heads(parts, windows, buckets, min_bytes), "<u8"), "suffixes", release=True)
    both = windows.withColumn("kind", F.lit(0)).unionByName(heads.withColumn("kind", F.lit(1)))
    return cut_parts(parts, both, buckets, min_bytes)


def per_document(docs: DataFrame, cut: DataFrame, text: str = "text", other: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` without its text, plus ``n_bytes`` and the columns of ``cut`` (those of a text's ``key``). Texts too short for
    ``cut`` take the columns ``other``, which may use ``key``. A column of ``docs`` that has a made column's name is left out."""
    other = other or {}
    made = [c for c in cut.columns if c not in ("key", "n_bytes")]
    taken = {c.lower() for c in (*made, "key", "n_bytes", text)}
    kept = [c for c in docs.columns if c.lower() not in taken]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*kept, F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("key"))
    found, = fresh(rows.join(cut.select(*made).limit(0)), "found")
    joined = rows.join(cut.select("key", *made).withColumn(found, F.lit(True)), "key", "left")
    return joined.select(*kept, "n_bytes", "key", *(
        (F.when(F.col(found), F.col(c)).otherwise(other[c]) if c in other else F.col(c)).alias(c) for c in made))
