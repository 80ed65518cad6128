"""Byte-level BPE encoding and decoding, with tree concatenation of long texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.llm.common import fresh
from lexivec.llm.encoders import ByteEncoder, encoder

LONG_CHARS = 1 << 15
FIRST_WINDOW = 64  # bytes of each side in the first window around a join

# Between these signs the tokenizer always cuts before the space.
SAFE_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")

Finish = Callable[[np.ndarray, ByteEncoder], tuple]
IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])


def plain_ids(ids: np.ndarray, _: ByteEncoder) -> tuple:
    return (ids.astype(np.int32),)


def _cuts(text: bytes) -> list[int]:
    return [m.start() for m in SAFE_CUT.finditer(text)]


def _one_word(coder: ByteEncoder, text: str) -> bool:
    return len(coder.tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1


def join_encodings(coder: ByteEncoder, left: tuple[bytes, np.ndarray], right: tuple[bytes, np.ndarray]):
    """The encoding of ``left + right`` from the encodings of both.

    A window around the join is encoded anew and doubled until it agrees with the tokens of both
    sides: on each side the agreement must reach past a place where the tokenizer always cuts,
    or, where the whole window is one unsplit word, over one token. (A sequence of BPE tokens is
    the encoding of a word exactly if each two neighbours are the encoding of their own text, so
    one common token on each side proves the seam.) A window that covers all is exact as it is.
    """
    (a, a_ids), (b, b_ids) = left, right
    a_ends = np.cumsum([len(coder.bytes[i]) for i in a_ids]) if len(a_ids) else np.zeros(0, np.int64)
    b_ends = np.cumsum([len(coder.bytes[i]) for i in b_ids]) if len(b_ids) else np.zeros(0, np.int64)
    near = max((len(s) for s in coder.special), default=1) - 1
    crossing = any(s in a[-near:] + b[:near] for s in coder.special) if near > 0 else False
    size = FIRST_WINDOW
    while True:
        # The window starts at the end of token i - 1 of the left side and ends with token j - 1 of the right.
        i = int(np.searchsorted(a_ends, max(0, len(a) - size), "right"))
        while i and (at := int(a_ends[i - 1])) < len(a) and a[at] & 0xC0 == 0x80:
            i -= 1
        start = int(a_ends[i - 1]) if i else 0
        j = int(np.searchsorted(b_ends, min(size, len(b)), "left")) + 1
        j = min(j, len(b_ids))
        while j < len(b_ids) and b[int(b_ends[j - 1])] & 0xC0 == 0x80:
            j += 1
        stop = int(b_ends[j - 1]) if j else 0
        text = (a[start:] + b[:stop]).decode("utf-8")
        window = coder.encode(text).astype(np.uint32)
        if i == 0 and j == len(b_ids):
            return a + b, window
        ends = np.cumsum([len(coder.bytes[t]) for t in window])
        tail, head = a_ids[i:], b_ids[:j]
        n = min(len(tail), len(window))
        same = int(np.argmin(np.append(tail[:n] == window[:n], False)))
        m = min(len(head), len(window))
        back = int(np.argmin(np.append((head[len(head) - m:] == window[len(window) - m:])[::-1], False)))
        agreed = int(ends[same - 1]) if same else 0
        rest = len(text.encode()) - (int(ends[len(window) - back - 1]) if back < len(window) else 0)
        left_ok = i == 0 or any(0 < c <= agreed for c in _cuts(a[start:]))
        right_ok = j == len(b_ids) or any(stop - rest <= c for c in _cuts(b[:stop]))
        if not (left_ok and right_ok) and not crossing and (i == 0 or same) and (j == len(b_ids) or back):
            # Inside one unsplit word; the sides' own neighbours must belong to it as well.
            before = a[max(0, start - 8):start].decode("utf-8", "ignore")[-1:]
            after = b[stop:stop + 8].decode("utf-8", "ignore")[:1]
            left_ok = right_ok = "'" not in before + text + after and _one_word(coder, before + text + after)
        if left_ok and right_ok:
            return a + b, np.concatenate([a_ids[:i], window, b_ids[j:]])
        size *= 2


def tree_concatenation(coder: ByteEncoder, parts: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
    """Joins neighbours level by level until one encoding is left."""
    while len(parts) > 1:
        joined = [join_encodings(coder, parts[k], parts[k + 1]) for k in range(0, len(parts) - 1, 2)]
        parts = joined + parts[len(parts) & ~1:]
    return parts[0][1]


def encode_texts(docs: DataFrame, path: str, text: str = "text", finish: Finish = plain_ids,
                 made: T.StructType = IDS, long_chars: int = LONG_CHARS) -> DataFrame:
    """``docs`` without ``text``, plus the columns that ``finish`` makes of each row's token ids.

    A null text counts as empty. Columns of ``docs`` with the name of a made column are replaced;
    repeated rows stay. Texts up to ``long_chars`` are encoded where they are read. Longer ones are cut into
    parts of that many code points, equal texts once; the parts are encoded as rows of their own,
    spread over the cluster, and joined per text by ``tree_concatenation``. Only long texts are shuffled.
    """
    new = {f.name.lower() for f in made}
    carry = [c for c in docs.columns if c != text and c.lower() not in new]
    body, digest, part, ids = fresh(docs, "body", "digest", "part", "part_ids")
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(body))
    short = rows.filter(F.length(body) <= long_chars)
    fields = [f for f in rows.schema.fields if f.name != body]

    def columns(batch_ids: list[np.ndarray]) -> list[pa.Array]:
        coder = encoder(ByteEncoder, path)
        values = [finish(x, coder) for x in batch_ids]
        types = [pa.list_(pa.int32()) if isinstance(f.dataType, T.ArrayType) else None for f in made]
        return [pa.array([v[k] for v in values], type=t or _arrow(made[k].dataType)) for k, t in enumerate(types)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ByteEncoder, path)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 256):
                some = batch.slice(at, 256)
                texts = some.column(body).to_pylist()
                out = columns(coder.encode_many(texts))
                names = [*(f.name for f in fields), *(f.name for f in made)]
                yield pa.RecordBatch.from_arrays([*(some.column(f.name) for f in fields), *out], names=names)

    done = short.mapInArrow(encode, T.StructType(fields + list(made)))

    long = rows.filter(F.length(body) > long_chars).withColumn(digest, F.sha2(body, 256))
    parts = (long.select(digest, F.posexplode(F.regexp_extract_all(
        F.col(body), F.lit(f"(?s).{{1,{long_chars}}}"), F.lit(0))).alias(part, body))
        .groupBy(digest, part).agg(F.first(body).alias(body)))

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ByteEncoder, path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                found = [x.astype(np.uint32).tobytes() for x in coder.encode_many(some.column(body).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(found, pa.binary())], names=[*some.schema.names, ids])

    encoded = parts.mapInArrow(encode_part, T.StructType([*parts.schema.fields, T.StructField(ids, T.BinaryType())]))

    def merge(table: pa.Table) -> pa.Table:
        coder = encoder(ByteEncoder, path)
        ordered = table.sort_by(part)
        leaves = [(t.encode(), np.frombuffer(x, np.uint32))
                  for t, x in zip(ordered[body].to_pylist(), ordered[ids].to_pylist())]
        out = columns([tree_concatenation(coder, leaves)])
        return pa.table([pa.array(ordered[digest].to_pylist()[:1]), *out],
                        names=[digest, *(f.name for f in made)])

    whole = encoded.groupBy(digest).applyInArrow(
        merge, T.StructType([T.StructField(digest, T.StringType()), *made]))
    joined = long.drop(body).join(whole, digest)
    return done.unionByName(joined.select(*done.columns))


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text that each row's ids stand for; null for null."""
    schema = T.StructType([f for f in rows.schema.fields if f.name != out] + [T.StructField(out, T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ByteEncoder, path)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(ids).to_pylist()]
            kept = [f.name for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, out])

    return rows.mapInArrow(decode, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
