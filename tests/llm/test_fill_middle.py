"""Cuts fall on unit borders, and every output leads back to its text."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexivec.llm import fill_middle
from lexivec.llm.queries import QUERIES


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    name = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(name[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), "<S>" + suf + "<P>" + pre + "<M>" + mid
    return n, "psm", len(pre), len(mid), "<P>" + pre + "<S>" + suf + "<M>" + mid


def odd_texts():
    rng = random.Random(5)
    signs = ["a", "Z", "word", " ", "\n", "é", "ß", "漢", "😀", "́", "<", "P", ">", "S", "M", "0", "\x00", " "]
    made = ["".join(rng.choice(signs) for _ in range(rng.choice([1, 2, 5, 40, 700]))) for _ in range(300)]
    return [None, "", "a", "1", "<P>", "x<S>y", "<", "a" * 5000, " " * 5000, "ab " * 100_000, *made, *made[:3]]


@pytest.mark.parametrize("text", ["", "x", "x y", "a1 b2 " * 50, "é😀 word" * 400])
def test_every_rank_is_found(text):
    units, found = re.findall("[A-Za-z]+|[^A-Za-z]", text), fill_middle.UnitList(text)
    assert found.units == len(units)
    assert [found.point_of(r) for r in range(len(units) + 1)] == [len("".join(units[:r])) for r in range(len(units) + 1)]


def test_lanes_thin_out():
    sizes = [len(lane[0]) for lane in fill_middle.UnitList("a " * 50_000).lanes]
    assert sizes[0] == 100_000 and len(sizes) > 6 and all(b < 0.5 * a for a, b in zip(sizes[:5], sizes[1:]))


def test_rows_against_brute_force(spark):
    texts = odd_texts()
    rows = [(None if i == 7 else i, t, "extra", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    made = fill_middle.fill_in_middle(docs)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((repr((i, *brute(i, t), t or "")) for i, t, _, _ in rows))
    assert sorted(repr(tuple(r)) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_other_parameters(spark):
    docs = spark.createDataFrame([("k", "a b c d")] * 2, "name string, body string")
    out = fill_middle.fill_in_middle(docs, "name", "body", "9", 100, 100, ("[1]", "[2]", "[3]")).collect()
    assert len(out) == 2 and out[0] == out[1] and out[0]["form"] == "spm" and out[0]["output"].startswith("[2]")
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs.withColumnRenamed("name", "Form"), "Form", "body")


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.fill_in_middle(empty).count() == 0


def test_query_gives_texts_back(spark, sf):
    got = QUERIES["op13_fill_middle"](spark, sf).select("doc_id", "restored_sha256")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("restored_sha256"))
    assert got.exceptAll(docs).count() == 0 and got.count() == docs.count()
