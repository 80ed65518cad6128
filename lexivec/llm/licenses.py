"""License scans: known sentences become identifiers, identifier sequences meet ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm.common import ascii_lower, small

BROADCAST_SENTENCES = 1 << 18
LISTED_BEGINNINGS = 1 << 16  # beginnings of known sentences in a plan; with more, every line may begin one

# Sentences of public licenses and notices, with the identifier of each.
SENTENCES = {
    "released-mit": "Released under the MIT License.",
    "licensed-mit": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                 "and associated documentation files (the \"Software\"), to deal in the Software without "
                 "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
                 "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
                 "Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or "
                  "substantial portions of the Software.",
    "licensed-apache-2": "Licensed under the Apache License, Version 2.0.",
    "apache-2-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
                       "file except in compliance with the License.",
    "apache-2-copy": "You may obtain a copy of the License at",
    "apache-2-link": "http://www.apache.org/licenses/LICENSE-2.0",
    "work-gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
                "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "licensed-cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "licensed-cc-by-4": "Licensed under CC BY 4.0.",
    "licensed-cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                 "provided that the following conditions are met:",
    "all-rights": "All rights reserved.",
}
# Ordered sentence identifiers of each rule.
RULES = [
    ("MIT", ["released-mit"]), ("MIT", ["licensed-mit"]), ("MIT", ["mit-grant"]),
    ("MIT", ["mit-title", "mit-grant"]), ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice"]),
    ("Apache-2.0", ["licensed-apache-2"]), ("Apache-2.0", ["apache-2-header"]),
    ("Apache-2.0", ["apache-2-header", "apache-2-copy", "apache-2-link"]),
    ("GPL-3.0-only", ["work-gpl-3"]), ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("CC-BY-NC-4.0", ["licensed-cc-by-nc-4"]), ("CC-BY-4.0", ["licensed-cc-by-4"]),
    ("CC-BY-SA-4.0", ["licensed-cc-by-sa-4"]), ("BSD", ["bsd-grant"]),
    ("BSD", ["all-rights", "bsd-grant"]), ("LicenseRef-all-rights-reserved", ["all-rights"]),
]

# A sentence ends at a line break, or at end marks with any symbols after them and white space.
BREAKS = r"\n|[.!?:;]+[^\p{L}\p{N}\s]*\s"
# The same without single line breaks: those, with any symbols around them, may stand inside a sentence.
ENDS = r"\n[^\p{L}\p{N}\n]*\n|[.!?:;]+[^\p{L}\p{N}\s]*\s"
SYMBOLS = r"[^\p{L}\p{N}]+"


def sentence_parts(text: Column) -> Column:
    """Normalised sentences in order: A-Z lower-cased, runs of other signs one space; none empty.
    A colon or semicolon ends one too, so a rule sentence with one inside is a sequence."""
    parts = F.split(ascii_lower(text), BREAKS)
    clean = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, SYMBOLS, " ")))
    return F.filter(clean, lambda s: s != "")


def wrapped_lines(text: Column) -> Column:
    """The parts of ``sentence_parts`` with the number of their paragraph piece: (piece, line). Lines with the
    same number have neither an end mark nor a blank line between them."""
    lines = F.transform(F.split(ascii_lower(text), ENDS), lambda s, i: F.transform(
        F.split(s, "\n"), lambda x: F.struct(i.alias("piece"), F.trim(F.regexp_replace(x, SYMBOLS, " ")).alias("line"))))
    return F.filter(F.flatten(lines), lambda x: x.line != "")


def license_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The sentences (sentence_id, sentence) and rules (license, sentence_ids) of this module."""
    sentences = spark.createDataFrame(list(SENTENCES.items()), "sentence_id string, sentence string")
    rules = spark.createDataFrame(RULES, "license string, sentence_ids array<string>")
    return sentences, rules


def known_parts(sentences: DataFrame) -> DataFrame:
    """(sentence_id, part, parts, sentence): a known sentence may hold several parts. Line breaks are white space."""
    whole = F.regexp_replace("sentence", r"\s+", " ")
    split = sentences.dropna().select("sentence_id", sentence_parts(whole).alias("all"))
    return split.filter(F.size("all") > 0).select(
        "sentence_id", F.size("all").alias("parts"), F.posexplode("all").alias("part", "known"))


def beginnings(parts: DataFrame, most: int = LISTED_BEGINNINGS) -> list[str] | None:
    """The first words, one or more, of the known parts; None if they are too many to list."""
    words = F.split("known", " ")
    # Counted by words before the beginnings are made.
    if parts.agg(F.coalesce(F.sum(F.size(words)), F.lit(0))).first()[0] > most:
        return None
    first = F.transform(words, lambda _, i: F.array_join(F.slice(words, 1, i + 1), " "))
    return [r["first"] for r in parts.select(F.explode(first).alias("first")).distinct().collect()]


def candidates(rows: DataFrame, parts: DataFrame, *keep: str, listed: int = LISTED_BEGINNINGS) -> DataFrame:
    """(*keep, pos, stop, known) of the text ``t``: each line and end-marked part by its number, and the joined
    consecutive lines from ``pos`` to before ``stop`` that a known part may be wrapped into."""
    longest, words = parts.agg(F.coalesce(F.max(F.length("known")), F.lit(0)),
                               F.coalesce(F.max(F.size(F.split("known", " "))), F.lit(0))).first()
    # Exploded, so that the lines are made once and not for every use of them.
    rows = rows.select(*keep, F.explode(F.array(wrapped_lines(F.col("t")))).alias("lines")).filter(F.size("lines") > 0)
    lines = F.col("lines")
    spots = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), (i + 1).alias("stop"), x.line.alias("known")))
    if words > 1:
        first = beginnings(parts, listed)

        def begun(x: Column, i: Column) -> Column:
            on = F.get(lines, i + 1).piece == x.piece
            return on if first is None else on & x.line.isin(first)

        def ends(i: Column) -> Column:  # no more lines than the longest known part has words
            return F.filter(F.sequence(i + 2, F.least(i + words, F.size(lines))),
                            lambda end: F.get(lines, end - 1).piece == F.get(lines, i).piece)

        starts = F.filter(F.transform(lines, lambda x, i: F.when(begun(x, i), i)), lambda i: i.isNotNull())
        joined = F.transform(starts, lambda i: F.transform(ends(i), lambda end: F.struct(
            i.alias("pos"), end.alias("stop"),
            F.array_join(F.transform(F.slice(lines, i + 1, end - i), lambda x: x.line), " ").alias("known"))))
        spots = F.concat(spots, F.filter(F.flatten(joined), lambda s: F.length(s.known) <= longest))
    return rows.select(*keep, F.inline(spots))


def scan_licenses(docs: DataFrame, sentences: DataFrame, rules: DataFrame,
                  key: str = "doc_id", text: str = "text",
                  broadcast_sentences: int = BROADCAST_SENTENCES, listed: int = LISTED_BEGINNINGS) -> DataFrame:
    """One row per license found: key, license, sentence_ids, first and last sentence (from 0).

    Sentences are normalised on both sides and compared whole; every line counts as one, and a known sentence may
    also be wrapped over consecutive lines, with symbols such as comment marks around the breaks, but without a
    blank line inside. A rule fits where its identifiers
    follow each other without another sentence between them. A match inside a longer one is
    left out. Null and empty texts hold nothing. Rows with equal key and text are reported
    once. Other columns of ``docs`` are not read.

    Texts are cut in the row and only sentences go on; they meet the known ones by equality
    (broadcast when the known table is small, else a join whose hot keys Spark splits), so what is
    shuffled is what was recognised.
    """
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    rows = rows.select("k", F.xxhash64("t").alias("version"), F.length("t").alias("chars"), "t")
    parts = known_parts(sentences)
    rows = candidates(rows, parts, "k", "version", "chars", listed=listed)
    lookup = F.broadcast(parts) if small(parts, broadcast_sentences, "known") else parts
    seen = rows.join(lookup, "known")
    doc = ("k", "version", "chars")
    # The parts of one sentence stand in a row: each begins where the one before stops.
    at = seen.groupBy(*doc, "sentence_id", "parts").agg(F.collect_set(F.struct("part", "pos", "stop")).alias("at"))

    def end(first: Column) -> Column:
        return F.when(F.col("parts") == 1, first.stop).otherwise(F.aggregate(
            F.sequence(F.lit(1), F.col("parts") - 1), first.stop,
            lambda stop, part: F.coalesce(F.get(F.transform(F.filter(
                F.col("at"), lambda x: (x.pos == stop) & (x.part == part)), lambda x: x.stop), F.lit(0)), F.lit(-1))))

    whole = at.select(*doc, F.explode(F.transform(F.filter("at", lambda x: x.part == 0), lambda x: F.struct(
        x.pos.alias("start"), end(x).alias("stop"), "sentence_id"))).alias("s")).filter("s.stop >= 0")
    spots = whole.groupBy(*doc).agg(F.sort_array(F.collect_set("s")).alias("spots"))
    ordered = rules.dropna().filter(F.size("sentence_ids") > 0)
    first = ordered.select("license", "sentence_ids", F.col("sentence_ids")[0].alias("first_id"))
    if small(first, broadcast_sentences):
        first = F.broadcast(first)
    begun = (spots.select(*doc, "spots", F.explode("spots").alias("s"))
             .join(first, F.col("s.sentence_id") == F.col("first_id")))
    # From the end of one sentence to the end of the next identifier that starts there; -1: none.
    stop = F.aggregate(
        F.slice("sentence_ids", 2, F.size("sentence_ids")), F.col("s.stop"),
        lambda end, want: F.coalesce(F.get(F.transform(F.filter(
            F.col("spots"), lambda x: (x.start == end) & (x.sentence_id == want)),
            lambda x: x.stop), F.lit(0)), F.lit(-1)))
    matched = begun.select(*doc, F.struct(
        F.col("s.start").alias("first"), (stop - 1).alias("last"), "license", "sentence_ids").alias("m"))
    matched = matched.filter("m.last >= 0").groupBy(*doc).agg(F.collect_set("m").alias("all"))
    maximal = F.filter("all", lambda m: ~F.exists("all", lambda o: (
        (o.first <= m.first) & (o.last >= m.last) & ((o.last - o.first) > (m.last - m.first)))))
    return matched.select("k", F.explode(maximal).alias("m")).select(
        F.col("k").alias(key), "m.license", F.array_join("m.sentence_ids", " ").alias("sentence_ids"),
        F.col("m.first").alias("first_sentence"), F.col("m.last").alias("last_sentence"))
