import random

import pytest
from pyspark.sql import functions as F

from lexivec.functions.draws import md5_draw, to_unit
from lexivec.operators import vocabulary as voc
from lexivec.operators import lookup
from lexivec.operators.lookup import lookup_join
from lexivec.functions.tokens import word_tokens
from lexivec.sources.dictionary import read_dictionary, write_dictionary


def vocab_of(spark, counts):
    rows = spark.createDataFrame(list(counts.items()), "word string, cnt bigint")
    return voc.rank_vocabulary(rows)


def test_ids_follow_counts_then_words(spark):
    rng = random.Random(1)
    counts = {f"w{i:04d}": rng.randint(1, 30) for i in range(500)}
    got = {r["word"]: r["word_id"] for r in vocab_of(spark, counts).collect()}
    order = sorted(counts, key=lambda w: (-counts[w], w))
    assert got == {w: i for i, w in enumerate(order)}


def loop_cap(counts, size, min_count):
    kept, threshold = dict(counts), min_count + 1
    while len(kept) > size:
        kept = {w: n for w, n in kept.items() if n > threshold}
        threshold += 1
    return kept


@pytest.mark.parametrize("size", [1, 3, 10, 50, 200])
def test_cap_equals_raising_the_threshold(spark, size):
    rng = random.Random(size)
    counts = {f"w{i}": min(rng.randint(5, 40), 30) for i in range(120)}
    got = voc.cap_vocabulary(vocab_of(spark, counts), size, 5).collect()
    assert {r["word"]: r["cnt"] for r in got} == loop_cap(counts, size, 5)


def test_cap_can_drop_everything(spark):
    assert voc.cap_vocabulary(vocab_of(spark, {"a": 9, "b": 9}), 1, 5).count() == 0


def test_keep_probability(spark):
    rows = spark.createDataFrame([(0, 15304), (1, 329137 - 15304)], "word_id int, cnt bigint")
    keep = {r["word_id"]: r["keep"] for r in voc.keep_probability(rows, 1e-3).collect()}
    assert keep[0] == pytest.approx(0.168157885228, abs=1e-12)


def test_distribution(spark):
    rows = voc.unigram_distribution(vocab_of(spark, {"a": 8, "b": 4, "c": 1})).orderBy("word_id").collect()
    assert [r["p"] for r in rows] == pytest.approx([0.55407, 0.329452, 0.116479], abs=1e-6)
    assert [r["hi"] for r in rows] == pytest.approx([0.55407, 0.883521, 1.0], abs=1e-6)


def test_distribution_has_no_gaps_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(voc, "BLOCK_ROWS", 7)
    counts = {f"w{i:03d}": 1 + i % 9 for i in range(100)}
    rows = voc.unigram_distribution(vocab_of(spark, counts)).orderBy("word_id").collect()
    assert rows[0]["lo"] == 0.0 and rows[-1]["hi"] == 1.0
    assert all(a["hi"] == pytest.approx(b["lo"], abs=1e-15) for a, b in zip(rows, rows[1:]))
    edges = [(a["hi"], b["lo"]) for a, b in zip(rows, rows[1:])]
    assert all(a == b for a, b in edges)


def test_dictionary(spark, tmp_path):
    path = tmp_path / "dic.txt"
    path.write_text("apple 7\npear 3 extra\napple 2\n")
    got = {r["word"]: r["cnt"] for r in read_dictionary(spark, str(path)).collect()}
    assert got == {"apple": 9, "pear": 3}


@pytest.mark.parametrize("line", ["apple", "apple many", ""])
def test_dictionary_line_without_count_fails(spark, tmp_path, line):
    path = tmp_path / "dic.txt"
    path.write_text(f"pear 3\n{line}\n")
    with pytest.raises(Exception, match="without a count"):
        read_dictionary(spark, str(path)).collect()


def test_draws(spark):
    row = spark.range(2).select(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("42"), "id")), 1, 13), 16, 10)
                                .cast("bigint").alias("u")).orderBy("id").collect()
    assert [r["u"] / 2**52 for r in row] == [0.7199947120487595, 0.6500066954935639]
    unit = spark.range(2000).select(to_unit(md5_draw(1, 2, "id")).alias("u"))
    low, high, mean = unit.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.03


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup_equals_broadcast(spark, how, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_SHARE", 40)
    words = ["hot"] * 3000 + [f"w{i % 50}" for i in range(500)] + ["unknown"] * 900 + [None] * 5
    rows = spark.createDataFrame(list(enumerate(words)), "pos bigint, word string")
    table = rows.filter("word is not null and word != 'unknown'").select("word").distinct().withColumn(
        "tag", F.concat(F.lit("t"), "word"))
    plain = lookup_join(rows, table, "word", ("pos",), how).select("pos", "word", "tag")
    salted = lookup_join(rows, table, "word", ("pos",), how, limit=0).select("pos", "word", "tag")
    assert sorted(plain.collect(), key=str) == sorted(salted.collect(), key=str)


def test_tokens_of_any_script_stay_whole(spark):
    row = spark.createDataFrame([("Für ÉA, e\u0301t\u0301 名前! x1_y\u0308",)], "text string")
    got = row.select(word_tokens("text").alias("t")).first()["t"]
    assert got == ["für", "éa", "e\u0301t\u0301", "名前", "x1", "y\u0308"]


def test_dictionary_counts_beyond_32_bits(spark, tmp_path):
    path = str(tmp_path / "dic")
    write_dictionary(spark.createDataFrame([("a", 3_000_000_000)], "word string, cnt long"), path)
    assert [tuple(r) for r in read_dictionary(spark, path).collect()] == [("a", 3_000_000_000)]
