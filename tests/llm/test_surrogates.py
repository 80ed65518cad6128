"""Surrogates keep kind, format, script and gender; equal stays equal, different stays different."""

import re

import pytest

from lexivec.llm import surrogates as s
from pyspark.sql import functions as F

KEY = b"key"


@pytest.mark.parametrize("size", [2, 3, 10, 16, 97, 1000])
def test_permutation(size):
    for key in (b"a", b"b"):
        step = s.Permutation(key, "t", size)
        image = [step(x) for x in range(size)]
        assert sorted(image) == list(range(size)) and all(x != y for x, y in enumerate(image))
    assert s.Permutation(b"a", "t", 1)(0) == 0


def test_all_values_of_a_shape_stay_distinct():
    for make in (lambda k: ("phone", f"+1 (2{k:02d}) 555-01{k:02d}"), lambda k: ("ip", f"10.{k}.7.{255 - k}"),
                 lambda k: ("email", f"user.{k:02d}@mail1.example.com"), lambda k: ("card", f"{4000_0000_0000_0000 + k * 7919}"),
                 lambda k: ("secret", f"{k:032x}"), lambda k: ("ssn", f"{100 + k}-12-{1000 + k}")):
        values = [make(k) for k in range(100)]
        made = [s.surrogate(KEY, *v) for v in values]
        assert len(set(made)) == 100 and all(m != v[1] for m, v in zip(made, values))
        for (kind, old), new in zip(values, made):
            assert re.sub(r"\d", "0", old) == re.sub(r"\d", "0", new) or kind in ("email", "secret")
            found = s.PATTERN.fullmatch(new)
            assert found and {"sep": "card"}.get(found.lastgroup, found.lastgroup) == kind


def test_formats():
    assert s.luhn("4111111111111111") and s.luhn(s.surrogate(KEY, "card", "4111111111111111"))
    assert not s.luhn(s.surrogate(KEY, "card", "4111111111111112"))
    assert re.fullmatch(r"[a-z]+\.\d\d@mail3\.example\.com", s.surrogate(KEY, "email", "someone.42@mail3.example.com"))
    new = s.surrogate(KEY, "email", "A.b@Corp-x.co.uk")
    assert re.fullmatch(r"[A-Z]\.[a-z]@[A-Z][a-z]{3}-[a-z]\.[a-z]{2}\.uk", new)
    assert re.fullmatch(r"\+49 \(\d\d\) \d{4}-\d{4}", s.surrogate(KEY, "phone", "+49 (30) 1234-5678"))
    assert re.fullmatch(r"\d{2}\.\d\.\d{3}\.\d", s.surrogate(KEY, "ip", "10.0.255.1"))


def test_persons():
    find = s.Replacer(KEY).replace
    text, spans = find("Mr. John Smith and Frau Müller met Mary Smith, Господин Иван Петров, Mr Smith and Miss 王小明.")
    assert [k for k, *_ in spans] == ["person"] * 6
    assert all(text[a:a + n] == v for _, a, n, v in spans)
    man, frau, woman, russian, alone, chinese = (v for *_, v in spans)
    assert man.split()[1] in s.GIVEN["m", "latin"] and woman.split()[0] in s.GIVEN["f", "latin"]
    assert man.split()[2] == woman.split()[1] == alone.split()[1] != "Smith"  # one family, one surrogate
    assert frau.startswith("Frau ") and russian.split()[1] in s.GIVEN["m", "cyrillic"]
    assert re.fullmatch("[А-Яа-яё]+", russian.split()[2]) and re.fullmatch("Miss [一-龥]{3}", chinese)
    assert "Smith" not in text and "Петров" not in text


def test_what_is_left_alone():
    for text in ("", "plain words", "version 1.2.3.4.5", "12345678901234567890123", "+1 ", "a@b", "3.14", "Mr", "Mary had a lamb",
                 "1234567890123456789x", "x@y.z1"):
        assert s.Replacer(KEY).replace(text) == (text, [])


def test_rows(spark):
    value = "bob.11@mail2.example.com"
    rows = [(1, f"to {value} and {value}.", 5), (1, f"to {value} and {value}.", 5), (2, None, 6), (None, "", 7),
            (3, "a" * 200_000 + f" {value} " + "+1 (017) 555-7713 " * 2000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, entities int").repartition(2)
    got = {(r.doc_id, (r.text or "")[:3]): r for r in s.replace_personal_data(docs, "key").collect()}
    out = s.Replacer(b"key").of("email", value)
    assert got[1, "to "].text == f"to {out} and {out}." and [e.kind for e in got[1, "to "].entities] == ["email"] * 2
    assert got[2, ""].text is None and got[2, ""].entities is None and got[None, ""].entities == []
    long = got[3, "aaa"]
    assert len(long.entities) == 2001 and out in long.text and value not in long.text and "(017) 555-7713" not in long.text
    kept = s.replace_personal_data(docs, "key", entities=None)
    assert kept.dtypes == docs.dtypes and kept.count() == 5
    pairs = s.surrogate_pairs(docs, "key")
    assert pairs.count() == 2 and s.collisions(pairs).count() == 0
    twice = pairs.unionByName(spark.createDataFrame([("email", "other", out)], pairs.schema))
    assert [r.surrogate for r in s.collisions(twice).collect()] == [out]
    assert s.replace_personal_data(docs.limit(0), "key").count() == 0


def test_no_value_is_left_in_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pairs = s.surrogate_pairs(docs, "k")
    assert s.collisions(pairs).count() == 0 and pairs.count() > 10
    values = [r.value for r in pairs.collect() if r.kind in ("email", "card", "secret")]
    texts = [r.text for r in s.replace_personal_data(docs, "k").select("text").collect()]
    assert not any(v in t for t in texts for v in values)
    assert docs.select(F.sum(F.length("text"))).first()[0] == sum(map(len, texts))


@pytest.mark.parametrize("value", [
    "AKIA" + "QWERTYUIOPASDFGH", "٤١١١ ١١١١ ١١١١ ١١١١", "+٤٩ (٣٠) ٥٥٥-٠١٢٣", "١٢٣-٤٥-٦٧٨٩", "٠٢٣-٤٥-٦٧٨٩", "a" * 32, "F" * 40,
    "a.b@example.org", "10.0.0.1", "Frau Weber", "Mr. Weber", "Alice Weber"])
def test_every_match_has_a_hint(value):
    text = f"about {value} here"
    assert s.PATTERN.search(text)[0] == value and s.HINT.search(text)
    new, spans = s.Replacer(KEY).replace(text)
    assert len(spans) == 1 and value not in new


def in_script(text, zero):
    return "".join(chr(ord(zero) + int(c)) if c.isascii() and c.isdigit() else c for c in text)


@pytest.mark.parametrize("value", ["123-456-7890", "+49 (30) 1234-5678", "4111 1111 1111 1111", "123-45-6789", "023-45-6789"])
def test_digits_keep_their_script(value):
    """The same number in several scripts is several values with surrogates of their own, in their scripts."""
    zeros = "0\u0660\u06f0\u0966\uff10"
    kind = s.PATTERN.fullmatch(value)
    kind = {"sep": "card"}.get(kind.lastgroup, kind.lastgroup)
    made = [s.surrogate(KEY, kind, in_script(value, z)) for z in zeros]
    mixed = value[:-1] + in_script(value[-1], zeros[1])
    made.append(s.surrogate(KEY, kind, mixed))
    assert len(set(made)) == len(made)
    for z, new in zip(zeros, made):
        assert {chr(s.zero_of(c)) for c in new if c.isdecimal()} <= {z, "0"} and new != in_script(value, z)
        assert [c.isdecimal() for c in new] == [c.isdecimal() for c in value]
    assert s.zero_of(made[-1][-1]) == ord(zeros[1])


def test_addresses_keep_their_script():
    values = ["1.2.3.4", "\u0661.2.3.4", "1.2.3.\u0664", "\u0661.\u0662.\u0663.\u0664"]
    made = [s.surrogate(KEY, "ip", v) for v in values]
    assert len(set(made)) == 4
    for old, new in zip(values, made):
        assert [c == "." or s.zero_of(c) for c in old] == [c == "." or s.zero_of(c) for c in new]
