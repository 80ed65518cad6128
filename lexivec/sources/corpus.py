"""Corpus sources: a column of token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.functions.tokens import word_tokens


def corpus_tokens(df: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """``keys`` plus ``tokens``; reads only the columns it needs."""
    return df.select(*keys, word_tokens(text_col).alias("tokens"))


def enough_partitions(scan: DataFrame) -> DataFrame:
    """Spreads a table read in fewer partitions than there are cores. A large table is read in
    more and stays as it is, without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def check_token_column(schema: T.StructType, input_col: str, output_col: str | None = None) -> None:
    """Raises unless ``input_col`` is ``array<string>`` and ``output_col`` is a new name."""
    if input_col not in schema.fieldNames():
        raise ValueError(f"column {input_col} does not exist")
    kind = schema[input_col].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType)):
        raise TypeError(f"column {input_col} must be array<string> but is {kind.simpleString()}")
    if output_col is not None and output_col in schema.fieldNames():
        raise ValueError(f"output column {output_col} already exists")


def explode_tokens(df: DataFrame, *keys: str, tokens: str = "tokens") -> DataFrame:
    """One row per non-null token: ``keys``, ``pos`` and ``word``."""
    rows = df.select(*keys, F.posexplode(tokens).alias("pos", "word"))
    return rows.filter(F.col("word").isNotNull())
