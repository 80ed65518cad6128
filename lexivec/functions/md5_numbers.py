"""The first 52 bits of the MD5 of many short texts at once, in numpy.

A draw needs the head of a digest only. Texts of up to ``ONE_BLOCK`` bytes, which are all that keys and
numbers make, are worked on side by side; longer ones go through ``hashlib`` one by one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed values of MD5 (RFC 1321).
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SINES = tuple(int(abs(math.sin(k + 1)) * (1 << 32)) for k in range(64))
TURNS = tuple(tuple((np.array([n], np.uint32), np.array([32 - n], np.uint32)) for n in some)
              for some in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)))
WORD_OF = tuple((k, 5 * k + 1, 3 * k + 5, 7 * k)[k // 16] % 16 for k in range(64))
ONE_BLOCK = 55
# Texts worked on together.
TOGETHER = 1 << 15
HEAD_HEX = 13


def texts_of(parts: list[pa.Array | str]) -> pa.Array:
    """The parts of each row joined by ``|``, nulls left out, as ``concat_ws`` does."""
    if not any(isinstance(part, pa.Array) for part in parts):
        raise ValueError("no column to draw by")
    columns = []
    for part in parts:
        if isinstance(part, pa.Array) and not (pa.types.is_string(part.type) or pa.types.is_large_string(part.type)):
            if not pa.types.is_integer(part.type):
                raise TypeError(f"draws are made of integers and strings, not {part.type}: cast to string first")
            part = part.cast(pa.string())
        columns.append(part)
    return pc.binary_join_element_wise(*columns, "|", null_handling="skip")


def blocks_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts of up to ``ONE_BLOCK`` bytes, padded with zeros, as columns of 16 little-endian words; and their lengths."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    padded = pc.ascii_rpad(texts, 64, "\0")
    rows = np.frombuffer(padded.buffers()[2] or b"", np.uint32, len(sizes) * 16, padded.offset * 64)
    return np.ascontiguousarray(rows.reshape(-1, 16).T), sizes


def closed_blocks(blocks: np.ndarray, sizes: np.ndarray, ends: list[bytes]) -> np.ndarray:
    """For every end side by side the blocks with the end, the end mark and the length in bits."""
    n = len(sizes)
    out = np.tile(blocks, (1, len(ends)))
    for k, end in enumerate(ends):
        part, rows = out[:, k * n:(k + 1) * n], np.arange(n)
        for place, byte in enumerate(end + b"\x80"):
            at = sizes + place
            part[at >> 2, rows] |= (byte << ((at & 3) << 3)).astype(np.uint32)
        part[14] = (sizes + len(end)) * 8
    return out


def heads(words: np.ndarray) -> np.ndarray:
    """First 52 bits of the digests of columns of 16 words, as int64."""
    out = np.empty(words.shape[1], np.int64)
    for start in range(0, words.shape[1], TOGETHER):
        part = words[:, start:start + TOGETHER]
        low, high = part.min(axis=1).tolist(), part.max(axis=1).tolist()
        # A word that all texts share is added to the sine.
        fixed = [x if x == y else None for x, y in zip(low, high)]
        added = np.array([(sine + (fixed[word] or 0)) & 0xFFFFFFFF for sine, word in zip(SINES, WORD_OF)], np.uint32)[:, None]
        a, b, c, d = (np.full(part.shape[1], v, np.uint32) for v in START)
        f, t = np.empty_like(a), np.empty_like(a)
        for k in range(64):
            if k < 16:
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif k < 32:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif k < 48:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            np.add(f, a, out=f)
            if fixed[WORD_OF[k]] is None:
                np.add(f, part[WORD_OF[k]], out=f)
            np.add(f, added[k], out=f)
            up, down = TURNS[k // 16][k % 4]
            np.left_shift(f, up, out=t)
            np.right_shift(f, down, out=f)
            np.bitwise_or(t, f, out=t)
            np.add(t, b, out=a)  # the place of the old a, which is used up
            a, b, c, d = d, a, b, c
        a += np.uint32(START[0])
        b += np.uint32(START[1])
        # Hex digits come byte by byte, the lowest first.
        out[start:start + TOGETHER] = (a.byteswap().astype(np.int64) << 20) | (b.byteswap() >> np.uint32(12))
    return out


def one_by_one(texts: list[bytes]) -> np.ndarray:
    return np.array([int(hashlib.md5(text, usedforsecurity=False).hexdigest()[:HEAD_HEX], 16) for text in texts], np.int64)


def md5_numbers(texts: pa.Array) -> np.ndarray:
    """Per text the integer of the first 13 hex digits of its MD5."""
    return md5_numbers_after(texts, [""])[:, 0]


def md5_numbers_after(texts: pa.Array, ends: list[str]) -> np.ndarray:
    """``md5_numbers`` of every text followed by every end, a column per end."""
    out = np.empty((len(texts), len(ends)), np.int64)
    encoded = [end.encode() for end in ends]
    fits = pc.binary_length(texts).to_numpy(zero_copy_only=False) <= ONE_BLOCK - max(map(len, encoded), default=0)
    short = texts if fits.all() else texts.filter(pa.array(fits))
    blocks, sizes = blocks_of(short)
    out[fits] = heads(closed_blocks(blocks, sizes, encoded)).reshape(len(ends), -1).T
    if not fits.all():
        longer = [text.encode() for text in texts.filter(pa.array(~fits)).to_pylist()]
        for n, end in enumerate(encoded):
            out[~fits, n] = one_by_one([text + end for text in longer])
    return out
