"""A vocabulary as runs of equal counts.

Word ids follow descending counts, so words of one count are neighbours. What hierarchical softmax, negative
sampling and subsampling need to know of a word follows from its count and its place among the words
of that count. The table of distinct counts is therefore all that leaves Spark: ``n`` of them take at least
``n * n / 2`` words of text, so a text of 10^12 words has at most 1.5 million.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: negative words are drawn in proportion to count ** NEGATIVE_POWER.
NEGATIVE_POWER = 0.75
MAX_RUNS = 1 << 24
# A guide says in which run a draw falls if its cell of the unit line holds no bound.
GUIDE_CELLS = 1 << 16


@dataclass(frozen=True)
class CountRuns:
    """``counts`` descending; run ``r`` owns the word ids ``firsts[r]`` up to ``firsts[r + 1]``."""

    counts: np.ndarray
    firsts: np.ndarray

    @property
    def words(self) -> int:
        return int(self.firsts[-1])

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.firsts)

    def run_of(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, ids, side="right") - 1

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        return self.counts[self.run_of(ids)]

    def keep(self, sample: float, total: int) -> np.ndarray:
        """Per run the chance that a center is kept: 1 or more means always."""
        ratio = sample * float(total) / np.maximum(self.counts, 1)
        return np.sqrt(ratio) + ratio


class NegativeLine:
    """The unit line cut into an interval per word, in id order, as wide as the word's share of all
    ``count ** NEGATIVE_POWER``. Words of one run have equal widths, so only run bounds are kept."""

    def __init__(self, runs: CountRuns):
        mass = runs.counts.astype(np.float64) ** NEGATIVE_POWER
        total = float((mass * runs.sizes).sum())
        self.runs, self.width = runs, mass / total
        self.bounds = np.concatenate(([0.0], np.cumsum(mass * runs.sizes) / total))
        # Cell bounds are exact in binary, so a draw lies between those of its cell.
        self.guide = np.searchsorted(self.bounds[1:-1], np.arange(GUIDE_CELLS + 1) / GUIDE_CELLS, side="right")

    def run_at(self, u: np.ndarray) -> np.ndarray:
        cell = np.clip((u * GUIDE_CELLS).astype(np.int64), 0, GUIDE_CELLS - 1)
        run = self.guide.take(cell)
        open_ones = np.nonzero(self.guide.take(cell + 1) != run)
        run[open_ones] = np.searchsorted(self.bounds[1:-1], u[open_ones], side="right")
        return run

    def word_at(self, u: np.ndarray) -> np.ndarray:
        run = self.run_at(u)
        first, last = self.runs.firsts[run], self.runs.firsts[run + 1] - 1
        return np.clip(first + ((u - self.bounds[run]) / self.width[run]).astype(np.int64), first, last)

    def others(self, u: np.ndarray, centers: np.ndarray) -> np.ndarray:
        """Words at ``u`` (one row per center) on the line without the center's own interval."""
        run = self.runs.run_of(centers)
        own = self.width[run]
        low = (self.bounds[run] + (centers - self.runs.firsts[run]) * own)[:, None]
        u = u * (1 - own)[:, None]
        drawn = self.word_at(np.where(u >= low, u + own[:, None], u))
        # Rounding can still land on the center's edge; step to a neighbour.
        return np.where(drawn == centers[:, None], np.where(drawn > 0, drawn - 1, 1), drawn)


def runs_of(counts: np.ndarray) -> CountRuns:
    """From the counts of all words in id order."""
    counts = np.asarray(counts, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], counts[1:] != counts[:-1]))) if len(counts) else np.zeros(0, np.int64)
    return CountRuns(counts[starts], np.append(starts, len(counts)).astype(np.int64))


def count_histogram(vocab: DataFrame) -> DataFrame:
    """``cnt, words``: how many words have each count."""
    return vocab.groupBy("cnt").agg(F.count(F.lit(1)).alias("words"))


def count_runs(vocab: DataFrame) -> CountRuns:
    """One row per distinct count comes to the driver."""
    rows = count_histogram(vocab).orderBy(F.desc("cnt")).limit(MAX_RUNS + 1).toArrow()
    if rows.num_rows > MAX_RUNS:
        raise ValueError(f"more than {MAX_RUNS} distinct counts: raise min_count or set max_vocab_size")
    sizes = rows["words"].to_numpy()
    return CountRuns(rows["cnt"].to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))
