"""Model tables ``word, word_id, vector, count, norm``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions.vectors import l2_norm
from lexivec.operators.vocabulary import rank_vocabulary


def join_vectors_counts(vectors: DataFrame, counts: DataFrame) -> DataFrame:
    """``word, vector, count`` of the words both tables have."""
    return vectors.join(counts, "word").select("word", "vector", "count")


def with_norms(rows: DataFrame) -> DataFrame:
    return rows.withColumn("norm", l2_norm(F.col("vector")))


def vector_sizes(rows: DataFrame) -> tuple[int, int | None, int | None]:
    """Number of rows and the smallest and largest vector length."""
    size = F.size("vector")
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("low"),
                   F.max(size).alias("high")).first()
    return row["n"], row["low"], row["high"]


def model_from_tables(vectors: DataFrame, counts: DataFrame) -> DataFrame:
    """A model from ``word, vector`` and ``word, count``; ids by falling count, then word."""
    rows = join_vectors_counts(vectors, counts)
    words, low, high = vector_sizes(rows)
    if words == 0 or not low:
        raise ValueError("the vectors must not be empty")
    if low != high:
        raise ValueError(f"vectors differ in length: {low} and {high}")
    ranked = rank_vocabulary(rows.select("word", F.col("count").alias("cnt")))
    ids = ranked.select("word", "word_id")
    return with_norms(rows.join(ids, "word").select("word", "word_id", "vector", "count"))


def get_vectors(model: DataFrame) -> DataFrame:
    return model.select("word", "vector")


def get_vocab(model: DataFrame) -> DataFrame:
    return model.select("word", "count")
