"""Joins of a large row set to a per-word table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.sources.shared_tables import write_table

# A per-word table up to this size is broadcast.
BROADCAST_LIMIT_BYTES = 128 << 20
# A word in more than one of this many rows is spread over several join keys.
HOT_SHARE = 10_000


def table_bytes(table: DataFrame) -> int:
    """Size of the rows of ``table``, measured from its values."""
    width: Column = F.lit(16)
    for field in table.schema:
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
        elif isinstance(field.dataType, T.ArrayType):
            single = isinstance(field.dataType.elementType, (T.IntegerType, T.FloatType))
            width = width + F.coalesce(F.size(field.name), F.lit(0)) * (4 if single else 8) + 16
        else:
            width = width + 8
    return table.agg(F.sum(width.cast("bigint")).alias("bytes")).first()["bytes"] or 0


def hot_words(rows: DataFrame, on: str) -> DataFrame:
    """``on, salts``: the values of ``on`` in more than 1/``HOT_SHARE`` of the rows, with the
    number of parts to cut each into. There are at most ``HOT_SHARE`` of them."""
    counts = write_table(rows.filter(F.col(on).isNotNull()).groupBy(on).agg(
        F.count(F.lit(1)).alias("n")), "row-counts")
    total = counts.agg(F.sum("n").alias("total")).first()["total"] or 0
    return (counts.filter(F.col("n") * HOT_SHARE > total)
            .select(on, F.ceil(F.col("n") * HOT_SHARE / total).cast("int").alias("salts")))


def lookup_join(rows: DataFrame, table: DataFrame, on: str, spread: Sequence[str],
                how: str = "inner", limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Joins ``rows`` to ``table``, which has one row per value of ``on``.

    A small table is broadcast. A larger one is joined by shuffle, and a frequent word does not
    land in one task: the frequent words are counted first (combined before the shuffle), each
    gets several salted copies of its table row, and each of its rows picks one by a hash of the
    ``spread`` columns. No join key then holds more than 1/``HOT_SHARE`` of the rows, whether the
    table knows the word or not; rows without a word are spread as well.
    """
    if table_bytes(table) <= limit:
        return rows.join(F.broadcast(table), on, how)
    hot = F.broadcast(hot_words(rows, on))
    parts = F.when(F.col(on).isNull(), HOT_SHARE).otherwise(F.coalesce("salts", F.lit(1)))
    salt = F.pmod(F.xxhash64(*spread), parts).cast("int")
    salted = rows.join(hot, on, "left").withColumn("salt", salt).drop("salts")
    copies = (table.join(hot, on, "left")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
              .drop("salts"))
    return salted.join(copies, [on, "salt"], how).drop("salt")
