"""Document fingerprints by winnowing, in column expressions.

Grams of GRAM words are hashed by rotating and xoring the word hashes; in each window of WINDOW grams the
smallest hash is chosen, the rightmost of equal ones, with its position. Two texts that share
GRAM + WINDOW - 1 words in a row share a chosen hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import fresh
from lexivec.sources.sorted_tables import with_total_before, write_in_order

GRAM = 4  # both are powers of two, reached by doubling
WINDOW = 8
SPACE = " \t\n\x0b\x0c\r"
POSITIONS = (1 << 32) - 1


def _rotated(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def _follow(width: int):
    return lambda x, y: F.coalesce(_rotated(x, width).bitwiseXOR(y), x)


def with_fingerprint(rows: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``rows`` plus ``out``: the chosen grams in order, each hash * 2^32 + (2^32 - 1 - position).

    Words are runs of signs other than ASCII white space; positions count words from 0. A null or empty
    text has an empty fingerprint; one with fewer words than a gram is one gram; fewer grams than a
    window are one window. Each step is a column of its own, so that none is computed twice.
    """
    words, grams, n, best = fresh(rows, "words", "grams", "n", "best")
    trimmed = F.btrim(F.col(text), F.lit(SPACE))
    rows = rows.withColumn(words, F.when(F.length(trimmed) > 0, F.split(trimmed, "[ \\t-\\r]+"))
                           .otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn(grams, F.when(
        F.size(words) < gram, F.transform(F.slice(words, 1, 1), lambda _: F.xxhash64(words))
    ).otherwise(F.transform(words, lambda w: F.xxhash64(w))))
    rows = rows.withColumn(n, F.greatest(F.size(words) - gram + 1, F.least(F.size(words), F.lit(1)))).drop(words)
    width = 1
    while width < gram:
        # The gram of twice the width: this one rotated, and the one that follows it.
        rows = rows.withColumn(grams, F.zip_with(
            grams, F.slice(grams, width + 1, F.greatest(F.size(grams), F.lit(1))),
            _follow(width)))
        width *= 2
    # Cut what was hashed beyond the last whole gram; number the grams so that a minimum is the rightmost.
    rows = rows.withColumn(best, F.transform(F.slice(grams, 1, F.col(n)), lambda x, i: (
        F.shiftleft(F.shiftrightunsigned(x, 33), 32) + (F.lit(POSITIONS) - i)))).drop(grams)
    width = 1
    while width < window:
        rows = rows.withColumn(best, F.zip_with(
            best, F.slice(best, width + 1, F.greatest(F.size(best), F.lit(1))), lambda x, y: F.least(x, y)))
        width *= 2
    whole = F.greatest(F.col(n) - window + 1, F.least(F.col(n), F.lit(1)))
    return rows.withColumn(out, F.array_distinct(F.slice(best, 1, whole))).drop(best, n)


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 32).cast("int")))


def chosen(fingerprint: Column) -> Column:
    """The fingerprint as structs (hash, position)."""
    return F.transform(fingerprint, lambda x: F.struct(
        F.shiftright(x, 32).alias("hash"),
        (F.lit(POSITIONS) - x.bitwiseAND(F.lit(POSITIONS))).alias("position")))


def written(fingerprint: Column) -> Column:
    """The fingerprint as text: ``position:hash`` with the hash in hexadecimal, separated by spaces."""
    return F.array_join(F.transform(chosen(fingerprint), lambda x: F.concat(
        x.position.cast("string"), F.lit(":"), F.hex(x.hash))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Common share of two sets of hashes; 1 for two empty ones."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def neighbours(keys: DataFrame) -> DataFrame:
    """Of distinct rows (id, version, chars): the key of each (own_...), and key and chars of the row before it
    (before_...) in descending order of id (null last), then version; before the first comes the last. The order is
    a range sort."""
    ordered = write_in_order(keys, F.desc_nulls_last("id"), "version", label="order")
    ranked = with_total_before(ordered, F.lit(1), "before").withColumn("rank", F.col("before") + F.col("row"))
    total = keys.sparkSession.createDataFrame([(ordered.count(),)], "total long")
    ranked = ranked.crossJoin(F.broadcast(total))  # one row
    ahead = ranked.select(F.pmod(F.col("rank") + 1, "total").alias("rank"), *[
        c.alias(f"before_{name}") for name, c in joinable().items()], F.col("chars").alias("before_chars"))
    return ranked.select("rank", *[c.alias(f"own_{name}") for name, c in joinable().items()]).join(ahead, "rank").drop("rank")


def joinable() -> dict[str, Column]:
    """``id`` and ``version`` as columns without nulls, so that joins and groups share one partitioning."""
    return {"id": F.coalesce("id", F.lit(0)), "missing": F.col("id").isNull(), "version": F.col("version")}


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: id, chars, the edited text, the fingerprints of the text, of the edited text and (hashes only) of
    the next document.

    The next document is the one that follows in descending order of the key; after the last comes the first. The edited
    text has its last floor(chars / 3) code points replaced by as many first ones of the next document, or all of it.
    A null text is empty. Rows equal in key and text are one document in this order and come out as often
    as they came in; a null key comes last. Other columns are not read.

    Whole texts are shuffled once, with their fingerprints; to its predecessor goes what it needs of a text.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("version", F.xxhash64("text"))
    order = neighbours(rows.select("id", "version", F.length("text").alias("chars")).distinct())
    base = with_fingerprint(rows, "text", "fingerprint")
    own, before = [f"own_{name}" for name in joinable()], [f"before_{name}" for name in joinable()]
    # Both joins below read the same columns, so that Spark shuffles them once.
    base = base.select(*[c.alias(f"key_{name}") for name, c in joinable().items()], "text", "fingerprint")

    def keyed(names: list[str]) -> Column:
        return reduce(Column.__and__, (F.col(f"key_{key}") == F.col(c) for key, c in zip(joinable(), names)))

    met = base.join(order, keyed(own))
    heads = met.select(
        *before, F.substr("text", F.lit(1), F.floor(F.col("before_chars") / 3).cast("int")).alias("head"),
        hashes(F.col("fingerprint")).alias("next_hashes"))
    heads = heads.groupBy(*before).agg(F.first("head").alias("head"), F.first("next_hashes").alias("next_hashes"))
    joined = base.join(heads, keyed(before))
    chars = F.length("text")
    joined = joined.select(F.when(~F.col("key_missing"), F.col("key_id")).alias("id"), chars.alias("chars"), "fingerprint", "next_hashes", F.concat(
        F.substr("text", F.lit(1), chars - F.floor(chars / 3).cast("int")), "head").alias("edited"))
    return with_fingerprint(joined, "edited", "edited_fingerprint")
