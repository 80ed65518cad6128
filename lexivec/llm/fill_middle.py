"""Fill-in-the-middle: texts cut at two random unit borders, with their parts put in another order.

A unit is a run of A-Z letters or a single other code point. Where a unit starts in the text is
found in an indexable skip list: every link of a lane carries how many units and how many code points it
passes, so a border's rank is reached by going down the lanes while adding widths.

Each row is worked on by itself. Defined cases: a null text is an empty one; an empty text, and one that holds
a marker, stays ``plain``; a null key counts as an empty string in the draw; repeated rows give equal
rows; columns other than key and text are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKERS = ("<P>", "<S>", "<M>")
ROWS = 512  # texts written out at a time

MADE = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType())])


class UnitList:
    """Indexable skip list over the units of a text.

    Node ``i`` is the border before unit ``i``. All nodes are in the bottom lane; a quarter of a lane's
    nodes, by a hash of their number, are in the next one, and node 0 is in all. ``lanes`` holds,
    bottom first, per link the units and the code points it passes and its node's place in the lane below.
    """

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        letters = (points | 32) - np.uint32(97) < 26
        opens = np.ones(len(points), bool)
        opens[1:] = ~(letters[1:] & letters[:-1])
        starts = np.flatnonzero(opens)
        self.units, self.points = len(starts), len(points)
        nodes = np.arange(self.units)
        draw = (nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
        width = np.ones(self.units, np.int64)
        length = np.diff(starts, append=self.points)
        self.lanes = [(width, length, nodes)]
        while len(width) > 4:
            up = draw & np.uint64(3) == 0
            up[0] = True
            below = np.flatnonzero(up)
            if len(below) == len(width):
                break
            width, length = np.add.reduceat(width, below), np.add.reduceat(length, below)
            draw = draw[below] >> np.uint64(2)
            self.lanes.append((width, length, below))

    def point_of(self, rank: int) -> int:
        """The code points before the border with that rank, 0 to ``units``."""
        units = points = at = 0
        for width, length, below in reversed(self.lanes):
            while at < len(width) and units + width[at] <= rank:
                units += int(width[at])
                points += int(length[at])
                at += 1
            if units == rank:
                return points
            at = int(below[at])
        return points


def draws(seed: str, key: object) -> list[int]:
    """Four numbers of 32 bits from the digest of ``seed:key``."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4)]


def rearranged(text: str, key: object, seed: str, formed: int, spm: int,
               markers: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    units = UnitList(text)
    first, second, form, kind = draws(seed, key)
    if not text or any(m in text for m in markers) or form % 100 >= formed:
        return units.units, "plain", None, None, text
    low, high = sorted((first % (units.units + 1), second % (units.units + 1)))
    start, stop = units.point_of(low), units.point_of(high)
    prefix, middle, suffix = text[:start], text[start:stop], text[stop:]
    p, s, m = markers
    if kind % 100 < spm:
        return units.units, "spm", start, stop - start, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return units.units, "psm", start, stop - start, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", formed: int = 90,
                   spm: int = 20, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """Per row: the key, ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and
    ``output``. ``formed`` of 100 texts change their form, ``spm`` of 100 of these put the suffix first.
    The key must not have the name of a made column.
    """
    if key.lower() in {f.name for f in MADE}:
        raise ValueError(f"column {key} would be made twice")
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("output"))
    schema = T.StructType([rows.schema[0], *MADE])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                made = [rearranged(x, k, seed, formed, spm, markers)
                        for k, x in zip(some.column(0).to_pylist(), some.column(1).to_pylist())]
                n, form, start, size, output = map(list, zip(*made))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(start, pa.int64()),
                     pa.array(size, pa.int64()), pa.array(output, some.schema.field(1).type)], names=schema.names)

    return rows.mapInArrow(cut, schema)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made from. As it held no marker, and no marker can overlap another's start,
    the first match of each is where it was put."""
    p, s, m = markers

    def part(opening: str, closing: str | None) -> Column:
        start = F.locate(opening, output) + len(opening)
        if closing is None:
            return F.substr(output, start)
        return F.substr(output, start, F.locate(closing, output) - start)

    psm = F.concat(part(p, s), part(m, None), part(s, m))
    spm = F.concat(part(p, m), part(m, None), part(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
