"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small(table: DataFrame, max_rows: int, *texts: str, max_chars: int = 1 << 25) -> bool:
    """True if the table has at most so many rows and characters, hence may be broadcast."""
    chars = sum((F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in texts), F.lit(0))
    rows, size = table.agg(F.count(F.lit(1)), chars).first()
    return rows <= max_rows and size <= max_chars
