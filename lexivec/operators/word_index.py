"""Ids of words as arrays: what a Python worker holds of a vocabulary that is too large for a dictionary.

A word takes its bytes and 24 more, about a tenth of what it takes in a dictionary. Words are found by a 64-bit hash
of their bytes and compared with what is found, so equal hashes do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Odd factors of the places of a word's bytes follow from this one; any would do.
PLACE_FACTOR = np.uint64(0x9E3779B97F4A7C15)
# Leading bits of a hash by which its words are listed.
MIN_GUIDE_BITS, MAX_GUIDE_BITS = 8, 22


def spread_bits(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """One 64-bit number per string; no nulls."""
    words = words.cast(pa.large_string())
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64, n + 1, words.offset * 8)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    factors = spread_bits((np.arange(int(sizes.max()), dtype=np.uint64) + np.uint64(1)) * PLACE_FACTOR) | np.uint64(1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * factors.take(place))))
    return spread_bits(sums[starts + sizes] - sums[starts] + sizes.astype(np.uint64))


@dataclass(frozen=True)
class WordIndex:
    """``words`` and ``ids`` in the order of ``hashes``. ``guide`` is the first place of each value of a hash's leading bits."""

    words: pa.Array
    ids: np.ndarray
    hashes: np.ndarray
    guide: np.ndarray

    def find(self, words: pa.Array) -> np.ndarray:
        """The id of each string, -1 for unknown ones and nulls."""
        found = np.full(len(words), -1, self.ids.dtype)
        asked = np.flatnonzero(words.is_valid().to_numpy(zero_copy_only=False))
        if not len(self.ids) or not len(asked):
            return found
        words = words.take(pa.array(asked)).cast(self.words.type)
        hashes = word_hashes(words)
        shift = np.uint64(64 - (len(self.guide) - 1).bit_length() + 1)
        lead = (hashes >> shift).astype(np.int64)
        at, end = self.guide.take(lead).astype(np.int64), self.guide.take(lead + 1)
        open_ones = np.flatnonzero(at < end)
        while len(open_ones):
            here = self.hashes.take(at[open_ones])
            same = np.flatnonzero(here == hashes[open_ones])
            hits = open_ones[same]
            equal = pc.equal(self.words.take(pa.array(at[hits])), words.take(pa.array(hits))).to_numpy(zero_copy_only=False)
            found[asked[hits[equal]]] = self.ids[at[hits[equal]]]
            later = here <= hashes[open_ones]  # beyond, hashes are larger
            later[same[equal]] = False
            open_ones = open_ones[later]
            at[open_ones] += 1
            open_ones = open_ones[at[open_ones] < end[open_ones]]
        return found


def word_index(words: pa.Array, ids: np.ndarray) -> WordIndex:
    """``words`` are distinct and not null."""
    hashes = word_hashes(words)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    bits = min(MAX_GUIDE_BITS, max(MIN_GUIDE_BITS, int(len(words)).bit_length()))
    leads = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    guide = np.searchsorted(leads, np.arange((1 << bits) + 1)).astype(np.int32)
    return WordIndex(words.take(pa.array(order)), np.asarray(ids)[order], hashes, guide)
