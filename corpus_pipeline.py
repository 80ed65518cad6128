"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm import packing, shingle_join, site_quality, surrogates
from lexivec.llm.queries import SURROGATE_KEY, tokenizer_path
from lexivec.sources.shared_tables import write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
CAPACITY = 4096


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-aware classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return site_quality.judge_quality(docs, labels).filter("keep").select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return shingle_join.one_per_group(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates; ``n_chars`` follows the new text."""
    out = surrogates.replace_personal_data(docs, SURROGATE_KEY, entities=None)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of ``CAPACITY`` tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), CAPACITY)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("PII", pii),
    ("best-fit packing", best_fit_packing),
]

# Learned evidence, keyed permutations and a linear program are not SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = write_table(docs, name.replace(" ", "-"))
    return docs
