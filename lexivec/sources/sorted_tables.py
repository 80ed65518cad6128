"""Written tables in a total order, for ranks and running sums over any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.sources.shared_tables import write_table

# monotonically_increasing_id: partition number above, row number below.
ROW_BITS = 33


def write_in_order(df: DataFrame, *order: Column | str, label: str) -> DataFrame:
    """``df`` sorted, plus ``part`` and ``row``: the sort partition and the place in it.

    The sort is a range partitioning, so no task holds more than its share of the rows. They are
    written once, because positions are only meaningful within one layout.
    """
    slot = F.col("slot")
    ordered = df.orderBy(*order).withColumn("slot", F.monotonically_increasing_id())
    return write_table(ordered, label).select(
        *df.columns, F.shiftright(slot, ROW_BITS).alias("part"),
        slot.bitwiseAND((1 << ROW_BITS) - 1).alias("row"))


def with_total_before(ordered: DataFrame, amount: Column, name: str, *groups: str) -> DataFrame:
    """Adds the sum of ``amount`` over the earlier partitions, per group. The table joined for
    it has one row per partition and group in it."""
    totals = ordered.groupBy(*groups, "part").agg(F.sum(amount).alias("amount"))
    earlier = (Window.partitionBy(*groups).orderBy("part")
               .rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(*groups, "part", F.coalesce(F.sum("amount").over(earlier), F.lit(0)).alias(name))
    return ordered.join(F.broadcast(starts), [*groups, "part"])
