"""Sequences of known sentences meet ordered rules."""

import random
import textwrap

from lexivec.llm import licenses as lic

GRANT, NOTICE = lic.SENTENCES["mit-grant"], lic.SENTENCES["mit-notice"]


def found(rows):
    return sorted((str(r.doc_id), r.license, r.sentence_ids, r.first_sentence, r.last_sentence) for r in rows.collect())


def test_scan(spark):
    rows = [
        (1, "Intro words.\nReleased under the MIT License.\nMore text"),
        (2, "RELEASED  under the mit license"),
        (3, f"The MIT License (MIT)\n\n{GRANT}\n\n{NOTICE}\nend"),
        (4, f"{GRANT} Something between. {NOTICE}"),
        (5, "Licensed under the Apache License, Version 2.0.### More. Licensed%%% under$$$ CC*** BY-NC 4.0.&&&"),
        (6, "Not released under the MIT License at all."),
        (7, None), (8, ""), (9, "..."), (None, "All rights reserved."),
        (10, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."),
        (11, "Licensed under CC BY 4.0."), (11, "Licensed under CC BY 4.0."),
        (12, "word " * 200_000 + ". Licensed under CC BY 4.0.")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, pos int, license string")
    tables = lic.license_tables(spark)
    want = sorted([
        ("1", "MIT", "released-mit", 1, 1), ("2", "MIT", "released-mit", 0, 0),
        ("3", "MIT", "mit-title mit-grant mit-notice", 0, 3), ("4", "MIT", "mit-grant", 0, 1),
        ("5", "Apache-2.0", "licensed-apache-2", 0, 0), ("5", "CC-BY-NC-4.0", "licensed-cc-by-nc-4", 2, 2),
        ("None", "LicenseRef-all-rights-reserved", "all-rights", 0, 0),
        ("10", "CC-BY-NC-4.0", "licensed-cc-by-nc-4", 0, 0), ("10", "CC-BY-NC-4.0", "licensed-cc-by-nc-4", 1, 1),
        ("11", "CC-BY-4.0", "licensed-cc-by-4", 0, 0), ("12", "CC-BY-4.0", "licensed-cc-by-4", 1, 1)])
    got = found(lic.scan_licenses(docs, *tables))
    # A colon ends a sentence, so the grant counts as the sentences of its parts.
    parts = spark.createDataFrame([(GRANT,)], "t string").select(lic.sentence_parts(lic.F.col("t")).alias("p")).first()["p"]
    shift = len(parts) - 1
    want = [(d, l, s, a, b + (shift - 1 if "grant" in s else 0)) for d, l, s, a, b in want]
    assert got == sorted(want)
    out = lic.scan_licenses(docs, *tables, broadcast_sentences=0)
    assert found(out) == got and "Python" not in out._jdf.queryExecution().toString()
    assert lic.scan_licenses(docs.limit(0), *tables).count() == 0
    assert lic.scan_licenses(docs, tables[0].limit(0), tables[1]).count() == 0


def wrap(text, width, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_wrapped_sentences(spark):
    free, hope, bsd = (lic.SENTENCES[s] for s in ("gpl-free", "gpl-hope", "bsd-grant"))
    rows = [
        (1, f"The MIT License (MIT)\n\n{wrap(GRANT, 78)}\n\n{wrap(NOTICE, 78)}\n"),
        (2, f"/*\n{wrap(free, 70, ' * ')}\n *\n{wrap(hope, 70, ' * ')}\n */"),
        (3, f"# All rights reserved.\r\n#\r\n{wrap(bsd, 75, '# ')}".replace("\r\n", "\n").replace("\n", "\r\n")),
        (4, f"Copyright 2020 Somebody\n{wrap(GRANT, 40, '// ')}"),
        (5, GRANT.replace(" ", "\n")),
        (6, wrap(GRANT, 70).replace("\n", "\n\n", 1)),
        (7, wrap(GRANT, 70).replace("\n", " more\n", 1)),
        (8, f"{wrap(free, 60)} {wrap(hope, 60)}\n\n" * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [("1", "MIT", "mit-title mit-grant mit-notice"), ("2", "GPL-3.0-or-later", "gpl-free gpl-hope"),
            ("3", "BSD", "all-rights bsd-grant"), ("4", "MIT", "mit-grant"), ("5", "MIT", "mit-grant"),
            ("8", "GPL-3.0-or-later", "gpl-free gpl-hope"), ("8", "GPL-3.0-or-later", "gpl-free gpl-hope")]
    sentences, rules = lic.license_tables(spark)
    got = found(lic.scan_licenses(docs, sentences, rules))
    assert [r[:3] for r in got] == want
    # Every line keeps its number.
    assert [r[3:] for r in got if r[0] in "45"] == [(1, len(textwrap.wrap(GRANT, 40))), (0, GRANT.count(" "))]
    assert found(lic.scan_licenses(docs, sentences, rules, broadcast_sentences=0, listed=0)) == got
    # Known sentences may be wrapped as well.
    folded = sentences.withColumn("sentence", lic.F.regexp_replace("sentence", " the ", "\nthe\n"))
    assert found(lic.scan_licenses(docs, folded, rules)) == got


def test_lines_are_those_of_sentence_parts(spark):
    rng = random.Random(6)
    texts = [("".join(rng.choice(["a", "B", " ", "\n", ".", ";", "*", ")", "\r", "-"]) for _ in range(40)),) for _ in range(400)]
    rows = spark.createDataFrame(texts, "t string").select(
        lic.sentence_parts(lic.F.col("t")).alias("a"), lic.wrapped_lines(lic.F.col("t")).alias("b")).collect()
    assert all(r.a == [x.line for x in r.b] for r in rows)


def test_every_rule_is_made_of_known_sentences():
    assert {s for _, ids in lic.RULES for s in ids} <= set(lic.SENTENCES)
