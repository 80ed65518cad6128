"""Draws made in numpy equal those that SQL makes of the MD5 of the same text."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexivec.functions.draws import md5_draw, md5_expression, xxhash_draw
from lexivec.functions.md5_numbers import TOGETHER, md5_numbers, md5_numbers_after, texts_of
from lexivec.operators import contexts, negatives
from lexivec.operators import vocabulary as voc


def head(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def test_numbers_of_texts_of_any_length():
    texts = ["", *("x" * n for n in range(1, 130)), "für", "名前|1", *(str(n * 7919) for n in range(TOGETHER))]
    assert md5_numbers(pa.array(texts)).tolist() == [head(t) for t in texts]
    assert md5_numbers(pa.array(texts).slice(50, 70)).tolist() == [head(t) for t in texts[50:120]]
    got = md5_numbers_after(pa.array(texts[:140]), ["1", "10", ""])
    assert got.tolist() == [[head(t + end) for end in ("1", "10", "")] for t in texts[:140]]
    assert md5_numbers(pa.array([], pa.string())).tolist() == []


def test_parts_are_joined_as_by_concat_ws():
    parts = ["42", pa.array([-5, None, 7]), pa.array(["a", "b", None])]
    assert texts_of(parts).to_pylist() == ["42|-5|a", "42|b", "42|7"]
    with pytest.raises(TypeError, match="cast to string"):
        texts_of([pa.array([0.5])])


def test_draw_equals_sql(spark):
    rows = spark.range(300).select("id", (F.col("id") % 7 - 3).cast("int").alias("off"))
    text = F.concat_ws("|", F.lit("42"), F.lit("1"), "id", "off", F.lit("neg"))
    want = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    for form in (md5_draw, md5_expression):
        got = rows.select(form(42, 1, "id", "off", F.lit("neg")).alias("got"), want.alias("want"))
        assert got.filter("got != want or got is null").count() == 0


def test_examples_draw_as_their_columns_do(spark):
    chunks = spark.createDataFrame([(d, c, [(d * 7 + i) % 9 for i in range(1 + d % 40)]) for d in range(60) for c in range(2)],
                                   "doc_id bigint, chunk int, ids array<int>")
    keep = spark.createDataFrame([(i, i / 8) for i in range(9)], "word_id int, keep double")
    spot = ("doc_id", "chunk", "pos")
    rows = contexts.center_rows(chunks.filter(F.size("ids") > 1), 4, "doc_id", "chunk")
    plain = contexts.trimmed(contexts.subsample_centers(rows, keep, 9, 2, spot).withColumn(
        "radius", contexts.dynamic_radius(4, 9, 2, spot)))
    got = contexts.training_examples(chunks, 4, 9, 2, ("doc_id", "chunk"), keep)
    assert set(got.columns) == set(plain.columns)
    assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    other = contexts.training_examples(chunks, 4, 9, 2, ("doc_id", "chunk"), keep, xxhash_draw)
    assert other.count() > 0 and set(other.columns) == set(got.columns)


def test_places_are_drawn_in_slices(spark, monkeypatch):
    n, keys = pa.array([3, 0, None, 9, 2], pa.int32()), [pa.array([1, 2, 3, 4, 5])]
    whole = [(s.tolist(), d.tolist()) for s, d in contexts.drawn_places(1, 1, "win", n, keys)]
    monkeypatch.setattr(contexts, "SLICE_PLACES", 4)
    parts = [(s.tolist(), d.tolist()) for s, d in contexts.drawn_places(1, 1, "win", n, keys)]
    assert len(whole) == 1 and len(parts) > 1
    assert [sum((p[k] for p in parts), []) for k in (0, 1)] == list(whole[0])


def distribution(spark):
    counts = [(f"w{i}", max(5, 4000 // (i + 1))) for i in range(700)]
    return voc.unigram_distribution(voc.rank_vocabulary(spark.createDataFrame(counts, "word string, cnt bigint"))).cache()


def test_arrays_and_joins_draw_the_same_negatives(spark):
    line = distribution(spark)
    pairs = spark.range(3000).select("id", (F.col("id") % 11 - 5).cast("int").alias("off"), (F.col("id") % 703).cast("int").alias("center"),
                                     (F.col("id") % 13).cast("int").alias("context"))
    for form in (negatives.negative_samples, negatives.neg_training_rows):
        in_place, joined = (form(pairs, line, 5, 3, 2, ("id", "off"), limit=limit) for limit in (1 << 27, 0))
        assert set(in_place.columns) == set(joined.columns)
        assert sorted(in_place.select(joined.columns).collect()) == sorted(joined.collect())
    draws = spark.range(5000).select("id", (F.col("id") / 4999.0 * 1.02 - 0.01).alias("u"))
    found = [sorted(negatives.interval_join(draws, line, "u", limit).select("id", "target").collect()) for limit in (1 << 27, 0)]
    assert found[0] == found[1] and 4800 < len(found[0]) < 5000


def test_pairs_of_negatives_are_made_once(spark):
    line, seen = distribution(spark), spark.sparkContext.accumulator(0)

    @F.udf("int")
    def center(n):
        seen.add(1)
        return int(n) % 5

    pairs = spark.range(40).select("id", center.asNondeterministic()("id").alias("center"), F.lit(1).alias("context"))
    assert negatives.neg_training_rows(pairs, line, 5, 3, 2, ("id",)).groupBy("target", "label").count().agg(
        F.sum("count")).first()[0] == 240
    assert seen.value == 40


def test_line_without_words_and_values_outside(spark):
    line = negatives.line_of(spark.createDataFrame([(7, .25, .25, .5), (9, .5, .5, 1.0)], "word_id int, p double, lo double, hi double"))
    assert line.at(np.array([.1, .25, .49, .5, .99, 1.0, -1.0])).tolist() == [-1, 0, 0, 1, 1, -1, -1]
    assert line.places(np.array([9, 7, 8])).tolist() == [1, 0, -1]
