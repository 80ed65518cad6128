"""Training examples: a center word and the known words around it.

All of it happens inside the row of a sentence chunk. There is no shuffle and no self-join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions.draws import BITS, Draw, md5_draw, to_unit
from lexivec.functions.md5_numbers import md5_numbers, texts_of
from lexivec.operators.lookup import BROADCAST_LIMIT_BYTES, lookup_join

# Places drawn for at a time.
SLICE_PLACES = 1 << 18


def center_rows(sentences: DataFrame, window: int, *keys: str, carry: Sequence[str] = ()) -> DataFrame:
    """``keys, pos, center, left, right``: one row per position with up to ``window`` ids on each side. The windows are
    cut row by row, and only if they are read. Of the arrays ``carry`` each row gets its place's element."""
    rows = sentences.select(*keys, "ids", *carry, F.posexplode("ids").alias("pos", "center"))
    w = F.lit(window)
    left = F.slice("ids", F.greatest(F.col("pos") - w, F.lit(0)) + 1, F.least("pos", w))
    return rows.select(*keys, "pos", "center", left.alias("left"), F.slice("ids", F.col("pos") + 2, w).alias("right"),
                       *[F.get(name, "pos").alias(name) for name in carry])


def dynamic_radius(window: int, seed: int, epoch: int, keys: Sequence[str],
                   draw: Draw = md5_draw) -> Column:
    """Uniform in 1..window."""
    return (F.lit(window) - F.pmod(draw(seed, epoch, *keys, F.lit("win")), F.lit(window))).cast("int")


def subsample_draw(seed: int, epoch: int, keys: Sequence[str], draw: Draw = md5_draw) -> Column:
    return to_unit(draw(seed, epoch, *keys, F.lit("sub")))


def keep_by_center(keep: DataFrame) -> DataFrame:
    return keep.select(F.col("word_id").alias("center"), "keep")


def subsample_centers(rows: DataFrame, keep: DataFrame, seed: int, epoch: int,
                      keys: Sequence[str], draw: Draw = md5_draw,
                      limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Drops center positions of frequent words at random. A dropped word stays in the contexts
    of its neighbours."""
    drawn = lookup_join(rows, keep_by_center(keep), "center", keys, limit=limit)
    return drawn.filter(subsample_draw(seed, epoch, keys, draw) <= F.col("keep")).drop("keep")


def trim_left(left: Column, radius: Column) -> Column:
    n = F.least(F.size(left), radius)
    return F.slice(left, F.size(left) - n + 1, n)


def trimmed(rows: DataFrame) -> DataFrame:
    """Cuts the windows to ``radius``; ``ctx`` runs left to right without the center."""
    left = trim_left(F.col("left"), F.col("radius"))
    right = F.slice("right", F.lit(1), F.col("radius"))
    return (rows.withColumn("n_left", F.size(left)).withColumn("ctx", F.concat(left, right))
            .drop("left", "right"))


def drawn_places(seed: int, epoch: int, tag: str, n: pa.Array, keys: Sequence[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per some sentences of ``n`` places each their numbers of places and ``md5_draw`` of every place, end to end."""
    sizes = n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first] - sizes[first]
        stop = max(first + 1, int(np.searchsorted(ends, before + SLICE_PLACES, side="right")))
        some = sizes[first:stop]
        owner = pa.array(np.repeat(np.arange(first, stop), some))
        pos = pa.array(np.arange(len(owner)) - np.repeat(np.cumsum(some) - some, some))
        yield some, md5_numbers(texts_of([str(seed), str(epoch), *(k.take(owner) for k in keys), pos, tag]))
        first = stop


def lists_of(sizes: Sequence[np.ndarray], values: Sequence[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1)
    flat = pa.array(np.concatenate(values), kind) if values else pa.array([], kind)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)


def radius_lists(window: int, seed: int, epoch: int, n: Column, keys: Sequence[str]) -> Column:
    """``dynamic_radius`` of all ``n`` places of a sentence."""

    @F.arrow_udf("array<int>")
    def radius_md5(n: pa.Array, *keys: pa.Array) -> pa.Array:
        parts = [(some, (window - draws % window).astype(np.int32)) for some, draws in drawn_places(seed, epoch, "win", n, keys)]
        return lists_of([p[0] for p in parts], [p[1] for p in parts], pa.int32())

    return radius_md5.asNondeterministic()(n, *keys)


def subsample_lists(seed: int, epoch: int, n: Column, keys: Sequence[str]) -> Column:
    """``subsample_draw`` of all ``n`` places of a sentence."""

    @F.arrow_udf("array<double>")
    def subsample_md5(n: pa.Array, *keys: pa.Array) -> pa.Array:
        parts = [(some, draws * 2.0**-BITS) for some, draws in drawn_places(seed, epoch, "sub", n, keys)]
        return lists_of([p[0] for p in parts], [p[1] for p in parts], pa.float64())

    return subsample_md5.asNondeterministic()(n, *keys)


def training_examples(sentences: DataFrame, window: int, seed: int, epoch: int,
                      keys: Sequence[str], keep: DataFrame | None = None,
                      draw: Draw = md5_draw, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``keys, pos, center, radius, n_left, ctx``. Centers without any neighbour are left out."""
    spot, sentences = [*keys, "pos"], sentences.filter(F.size("ids") > 1)
    if draw is not md5_draw:
        rows = center_rows(sentences, window, *keys)
        if keep is not None:
            rows = subsample_centers(rows, keep, seed, epoch, spot, draw, limit)
        return trimmed(rows.withColumn("radius", dynamic_radius(window, seed, epoch, spot, draw)))
    # All draws of a sentence are made together, before its places become rows.
    n = F.size("ids")
    lists = {"radius": radius_lists(window, seed, epoch, n, keys)}
    if keep is not None:
        lists["unit"] = subsample_lists(seed, epoch, n, keys)
    rows = center_rows(sentences.select(*keys, "ids", *[c.alias(name) for name, c in lists.items()]), window, *keys, carry=tuple(lists))
    if keep is not None:
        rows = lookup_join(rows, keep_by_center(keep), "center", spot, limit=limit)
        rows = rows.filter(F.col("unit") <= F.col("keep")).drop("keep", "unit")
    return trimmed(rows)


def context_offset(k: Column, n_left: Column) -> Column:
    """Distance from the center of the k-th context word."""
    return F.when(k < n_left, k - n_left).otherwise(k - n_left + 1)


def context_words() -> Column:
    """``k, context`` from ``ctx``. Spark would test a bare column for emptiness before all joins, and draw the radius
    once more, several times over, to do so; an expression it leaves alone."""
    return F.posexplode(F.concat("ctx")).alias("k", "context")


def context_pairs(examples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, pos, off, center, context``: one row per (context, center) pair."""
    rows = examples.select(*keys, "pos", "center", "n_left", context_words())
    off = context_offset(F.col("k"), F.col("n_left"))
    return rows.select(*keys, "pos", off.alias("off"), "center", "context")


def concat_slots(examples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, pos, center, slot, context`` with slot = off + radius. The window starts at slot 0
    whatever the radius; the center's own slot stays empty."""
    rows = examples.select(*keys, "pos", "center", "radius", "n_left", context_words())
    slot = context_offset(F.col("k"), F.col("n_left")) + F.col("radius")
    return rows.select(*keys, "pos", "center", slot.alias("slot"), "context")
