"""Negative samples as tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions.draws import BITS, Draw, md5_draw, to_unit
from lexivec.functions.md5_numbers import md5_numbers_after, texts_of
from lexivec.operators.lookup import BROADCAST_LIMIT_BYTES, lookup_join, table_bytes

BELOW_ONE = 1.0 - 2.0**-53
# What an interval takes in a ``Line``, with its share of the guide.
LINE_BYTES = 48
# Rows drawn for at a time.
SLICE_ROWS = 1 << 16


@dataclass(frozen=True)
class Line:
    """Intervals as arrays in the order of the line. ``guide`` counts the intervals that end at or before the start of each of
    evenly wide cells, so a value in a cell without an end needs no search. ``by_id`` are the places of ``ids`` in order."""

    ids: np.ndarray
    p: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    guide: np.ndarray
    by_id: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.guide) - 1

    def at(self, u: np.ndarray) -> np.ndarray:
        """Place of the interval ``[lo, hi)`` that holds each value, -1 for none."""
        cell = np.clip((u * self.cells).astype(np.int64), 0, self.cells - 1)
        place = self.guide.take(cell).astype(np.int64)
        open_ones = np.flatnonzero(self.guide.take(cell + 1) != place)
        place[open_ones] = np.searchsorted(self.hi, u.take(open_ones), side="right")
        inside = place < len(self.ids)
        place[~inside] = 0
        return np.where(inside & (u >= self.lo.take(place)), place, -1)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Place of the interval of each id, -1 for unknown ones."""
        at = np.searchsorted(self.ids, ids, sorter=self.by_id)
        place = self.by_id.take(at, mode="clip")
        return np.where(self.ids.take(place) == ids, place, -1)


def line_of(intervals: DataFrame) -> Line:
    """From ``word_id, p, lo, hi``, whose intervals do not overlap."""
    table = intervals.select("word_id", "p", "lo", "hi").toArrow()
    ids, p, lo, hi = (table[name].to_numpy() for name in ("word_id", "p", "lo", "hi"))
    order = np.lexsort((hi, lo))
    ids, p, lo, hi = ids[order], p[order], lo[order], hi[order]
    cells = 1 << max(10, int(2 * len(ids)).bit_length())
    guide = np.searchsorted(hi, np.arange(cells + 1) / cells, side="right").astype(np.int32)
    return Line(ids, p, lo, hi, guide, np.argsort(ids, kind="stable"))


def fits_in_arrays(intervals: DataFrame, limit: int) -> bool:
    return intervals.count() * LINE_BYTES <= limit


def target_column(line: Line, value: Column | str, spark) -> Column:
    """``word_id`` of the interval that holds ``value``, or null."""
    side = spark.sparkContext.broadcast(line)

    @F.arrow_udf("int")
    def interval_at(value: pa.Array) -> pa.Array:
        place = side.value.at(value.cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False))
        return pa.array(side.value.ids.take(place), pa.int32(), mask=place < 0) if len(side.value.ids) else pa.nulls(len(place), pa.int32())

    return interval_at.asNondeterministic()(value)


def interval_join(draws: DataFrame, intervals: DataFrame, value: str = "u",
                  limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Adds ``word_id`` of the interval ``[lo, hi)`` holding ``value``.

    Intervals that fit in every worker as arrays are searched in place. Of more, the unit line is cut into as many cells as there are
    words, and each interval is listed under the cells it touches: at most twice as many rows as words, and an equality
    join instead of a comparison with every interval. Draws are uniform, so cells fill evenly.
    """
    if fits_in_arrays(intervals, limit):
        target = target_column(line_of(intervals), value, draws.sparkSession)
        return draws.withColumn("target", target).filter(F.col("target").isNotNull())
    cells = max(intervals.count(), 1)
    last = F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1))
    listed = intervals.select(
        F.explode(F.sequence(F.floor(F.col("lo") * cells), last)).alias("cell"),
        F.col("word_id").alias("target"), "lo", "hi")
    # Never null, and said so: Spark would otherwise draw twice, once to test for null.
    cell = F.floor(F.coalesce(F.col(value).cast("double"), F.lit(-1.0)) * cells)
    keyed = draws.withColumn("cell", F.coalesce(cell, F.lit(-1).cast("bigint")))
    side = F.broadcast(listed) if table_bytes(intervals) * 2 <= limit else listed
    inside = (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi"))
    return keyed.join(side, "cell").filter(inside).drop("cell", "lo", "hi")


def other_targets(line: Line, place: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Places hit by integer draws (a row per center, whose own interval is at ``place``) on the line without that interval."""
    p, lo, hi = (column.take(place)[:, None] for column in (line.p, line.lo, line.hi))
    squeezed = (draws * 2.0**-BITS) * (1 - p)
    # The bounds only matter to rounding: they keep a draw out of the center's own interval.
    below = np.minimum(squeezed, lo * BELOW_ONE)
    above = np.minimum(np.maximum(squeezed + p, hi), BELOW_ONE)
    u = np.where((squeezed >= lo) & (hi < 1), above, below)
    return line.at(u.ravel()).reshape(u.shape)


def target_lists(line: Line, negative: int, seed: int, epoch: int, keys: Sequence[str], spark) -> Column:
    """Per row the ``negative`` targets, null for a center that has none."""
    side, ends = spark.sparkContext.broadcast(line), [str(n + 1) for n in range(negative)]

    def some_targets(center: pa.Array, keys: Sequence[pa.Array]) -> pa.Array:
        known = side.value
        place = known.places(center.fill_null(-1).to_numpy(zero_copy_only=False)) if len(known.ids) else np.full(len(center), -1)
        drawn = (place >= 0) & (known.p.take(place, mode="clip") < 1) if len(known.ids) else place >= 0
        chosen = pa.array(drawn)
        # What the draws of a row have in common is put into text once.
        texts = texts_of([str(seed), str(epoch), *(k.filter(chosen) for k in keys), "neg", ""])
        hit = other_targets(known, place[drawn], md5_numbers_after(texts, ends)).ravel()
        flat = pa.array(known.ids.take(hit), pa.int32(), mask=hit < 0) if len(hit) else pa.array([], pa.int32())
        offsets = np.concatenate(([0], np.cumsum(drawn * negative))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(~drawn))

    @F.arrow_udf("array<int>")
    def targets_md5(center: pa.Array, *keys: pa.Array) -> pa.Array:
        return pa.concat_arrays([some_targets(center.slice(a, SLICE_ROWS), [k.slice(a, SLICE_ROWS) for k in keys])
                                 for a in range(0, max(1, len(center)), SLICE_ROWS)])

    return targets_md5.asNondeterministic()("center", *keys)


def negative_samples(rows: DataFrame, distribution: DataFrame, negative: int, seed: int,
                     epoch: int, keys: Sequence[str], draw: Draw = md5_draw,
                     limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Adds ``draw`` (1..negative) and ``target``, never the row's own ``center``.

    The center's interval is taken out of the unit line before the draw, which gives the same
    distribution as drawing again until another word comes up. A vocabulary of one word has no
    negatives.

    A distribution that fits in every worker as arrays is drawn from in place; a larger one is joined, to the centers and
    then to the draws.
    """
    if draw is md5_draw and negative > 0 and fits_in_arrays(distribution, limit):
        targets = target_lists(line_of(distribution), negative, seed, epoch, keys, rows.sparkSession)
        drawn = rows.withColumn("targets", targets).select(*rows.columns, F.posexplode("targets").alias("draw", "target"))
        return drawn.filter(F.col("target").isNotNull()).withColumn("draw", F.col("draw") + 1)
    own = distribution.select(F.col("word_id").alias("center"),
                              F.col("p").alias("own_p"), F.col("lo").alias("own_lo"),
                              F.col("hi").alias("own_hi"))
    # What the draws of a row have in common is put into text once.
    drawn = (lookup_join(rows, own, "center", keys, limit=limit).filter("own_p < 1")
             .withColumn("place", F.concat_ws("|", *keys, F.lit("neg")))
             .withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(negative)))))
    unit = to_unit(draw(seed, epoch, "place", F.col("draw").cast("string")))
    squeezed = unit * (1 - F.col("own_p"))
    # The bounds only matter to rounding: they keep a draw out of the center's own interval.
    below = F.least(F.col("u"), F.col("own_lo") * BELOW_ONE)
    above = F.least(F.greatest(F.col("u") + F.col("own_p"), F.col("own_hi")), F.lit(BELOW_ONE))
    shifted = (F.col("u") >= F.col("own_lo")) & (F.col("own_hi") < 1)
    u = F.coalesce(F.when(shifted, above).otherwise(below), F.lit(0.0))
    placed = drawn.withColumn("u", squeezed).withColumn("u", u)
    return interval_join(placed.drop("own_p", "own_lo", "own_hi", "place"), distribution, "u",
                         limit).drop("u")


def neg_training_rows(pairs: DataFrame, distribution: DataFrame, negative: int, seed: int,
                      epoch: int, keys: Sequence[str], draw: Draw = md5_draw,
                      limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``keys, context, center, draw, target, label``: per pair the center with label 1 and
    ``negative`` draws with label 0."""
    columns = [*keys, "context", "center", "draw", "target", "label"]
    if draw is md5_draw and negative > 0 and fits_in_arrays(distribution, limit):
        # The pairs are made once: the center comes before its negatives in one list.
        targets = target_lists(line_of(distribution), negative, seed, epoch, keys, pairs.sparkSession)
        every = F.concat(F.array("center"), F.coalesce("targets", F.array().cast("array<int>")))
        rows = (pairs.withColumn("targets", targets).select(*pairs.columns, F.posexplode(every).alias("draw", "target"))
                .filter(F.col("target").isNotNull()))
        return rows.withColumn("label", (F.col("draw") == 0).cast("int")).select(columns)
    positive = (pairs.withColumn("draw", F.lit(0)).withColumn("target", F.col("center"))
                .withColumn("label", F.lit(1)))
    negatives = negative_samples(pairs, distribution, negative, seed, epoch, keys, draw, limit)
    return positive.select(columns).unionByName(
        negatives.withColumn("label", F.lit(0)).select(columns))
