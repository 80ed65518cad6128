"""Uniform draws computed from the identity of a row.

A draw depends only on its arguments, so it is the same whatever the partitioning, and a task
that is run again repeats it.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexivec.functions.md5_numbers import md5_numbers, texts_of

BITS = 52

Draw = Callable[..., Column]


def md5_expression(seed: int, epoch: int, *parts: Column | str) -> Column:
    """``md5_draw`` as a column expression: for few rows, or wide ones, which need not pass a Python worker."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), *parts)
    number = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return F.coalesce(number, F.lit(0).cast("bigint"))  # never null, and Spark can see it


def md5_draw(seed: int, epoch: int, *parts: Column | str) -> Column:
    """Integer in [0, 2^52): the first 13 hex digits of the MD5 of all parts, joined by ``|``. Any SQL engine can repeat it.
    ``parts`` are integers and strings. Made in numpy, a batch at a time: expressions take several times as long."""

    @F.arrow_udf("bigint")
    def md5(*columns: pa.Array) -> pa.Array:
        return pa.array(md5_numbers(texts_of([str(seed), str(epoch), *columns])))

    # Drawn once: as a function of nothing but its arguments it would be copied to wherever it is read.
    return F.coalesce(md5.asNondeterministic()(*parts), F.lit(0).cast("bigint"))  # never null, and Spark can see it


def xxhash_draw(seed: int, epoch: int, *parts: Column | str) -> Column:
    """Integer in [0, 2^52) from xxHash64, several times cheaper than MD5."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(epoch), *parts), 64 - BITS)


def to_unit(draw: Column) -> Column:
    """Maps an integer draw to [0, 1)."""
    return draw * F.lit(2.0**-BITS)  # exact, and unlike a quotient never null
