"""The vocabulary table ``word, cnt, word_id`` and the per-word columns derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.operators.count_runs import NEGATIVE_POWER
from lexivec.sources.corpus import explode_tokens
from lexivec.sources.shared_tables import drop_table, write_table
from lexivec.sources.sorted_tables import with_total_before, write_in_order

# Rows per window partition of the two-level running sum.
BLOCK_ROWS = 65536


def word_counts(tokens: DataFrame) -> DataFrame:
    """``word, cnt`` over the ``tokens`` column. Counts are combined before the shuffle, so a
    very frequent word arrives as one row per map task."""
    return explode_tokens(tokens).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def min_count_filter(counts: DataFrame, min_count: int) -> DataFrame:
    return counts.filter(F.col("cnt") >= min_count)


def rank_vocabulary(counts: DataFrame) -> DataFrame:
    """Adds ``word_id``: 0 for the most frequent word, equal counts in word order.

    The id is the place in its partition of a range sort plus the sizes of the partitions before,
    so no task sees the whole vocabulary.
    """
    ordered = write_in_order(counts, F.desc("cnt"), "word", label="sorted-words")
    started = with_total_before(ordered, F.lit(1), "start")
    word_id = (F.col("start") + F.col("row")).cast("int")
    ranked = write_table(started.select("word", "cnt", word_id.alias("word_id")), "vocabulary")
    drop_table(ordered)
    return ranked


def cap_vocabulary(ranked: DataFrame, max_size: int, min_count: int) -> DataFrame:
    """Keeps words above a count threshold when there are more than ``max_size`` words.

    The threshold is the smallest one, from ``min_count + 1`` up, that leaves at most
    ``max_size`` words. Words of equal count stay or go together, so fewer may remain.
    """
    if max_size == 0:
        return ranked
    first_over = ranked.filter(F.col("word_id") == max_size).select("cnt").first()
    if first_over is None:
        return ranked
    return ranked.filter(F.col("cnt") > max(first_over["cnt"], min_count + 1))


def train_word_total(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.sum("cnt").alias("total"))


def keep_probability(vocab: DataFrame, sample: float) -> DataFrame:
    """``word_id, keep``: sqrt(s/f) + s/f for relative frequency f. 1 or more: always kept."""
    total = float(train_word_total(vocab).first()["total"] or 0)
    ratio = F.lit(sample * total) / F.col("cnt")
    return vocab.select("word_id", (F.sqrt(ratio) + ratio).alias("keep"))


def unigram_distribution(vocab: DataFrame) -> DataFrame:
    """``word_id, p, lo, hi``: the negative-sampling distribution as adjacent intervals.

    The running sum has two levels: totals of blocks of ids first, then a window inside each
    block, so no window holds more than ``BLOCK_ROWS`` words. The result is written, so that every
    use sees the same bounds to the last bit.
    """
    mass = vocab.select("word_id", F.pow("cnt", F.lit(NEGATIVE_POWER)).alias("mass"),
                        F.floor(F.col("word_id") / BLOCK_ROWS).alias("block"))
    totals = mass.groupBy("block").agg(F.sum("mass").alias("block_mass"))
    by_block = Window.orderBy("block")
    blocks = totals.select(
        "block",
        F.coalesce(F.sum("block_mass").over(by_block.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0.0)).alias("before"),
        F.sum("block_mass").over(Window.partitionBy()).alias("z"))
    # A block ends exactly where the next one starts, so no draw falls between two words.
    blocks = blocks.withColumn(
        "after", F.coalesce(F.lead("before").over(by_block), F.col("z")))
    inside = Window.partitionBy("block").orderBy("word_id")
    upto = F.sum("mass").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    below = F.sum("mass").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    ends_block = F.lead("word_id").over(inside).isNull()
    rows = mass.join(F.broadcast(blocks), "block")
    return write_table(rows.select(
        "word_id", (F.col("mass") / F.col("z")).alias("p"),
        ((F.col("before") + F.coalesce(below, F.lit(0.0))) / F.col("z")).alias("lo"),
        (F.when(ends_block, F.col("after")).otherwise(F.col("before") + upto)
         / F.col("z")).alias("hi")), "distribution")
