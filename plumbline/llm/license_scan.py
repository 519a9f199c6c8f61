"""License statements: named phrases, and text blocks that hold most of a template's words.

DataFrame functions only. One read turns each text into words, finds the phrases' places, and
keeps of each block of ``block`` words (a new one begins every half block, so a statement of up
to half a block lies in one whole) the distinct words that any template has. Over these an exact
set-similarity join is made:

1. Template words are ordered by how many blocks of the corpus have them, the rarest first.
2. A block that holds at least ``need`` of a template's words shares one of the template's first
   size - need + 1 words, which also is among the block's own first size - need + 1. They are
   joined on that word, if both are long enough and enough words are left after it in both.
3. Candidates are verified by counting the words they share.

Templates are few, so what is broadcast is bounded by them: one row per template and prefix word.

A null text counts as empty. Repeated rows are reported once a row, a null id is an id like any
other, an empty table gives an empty result, and other columns of the input are not read, whatever their
names. Templates that a block holds alike are all reported, of a word as frequent as another the first
in order of text comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Statements that public licenses ask for or begin with, and their labels.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "to deal in the software without restriction",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Words of a block, and per cent of a template's words that a block must hold.
BLOCK, PERCENT = 200, 90
_PLACES = "array<struct<at: int, label: string>>"


def _sets(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, list[str], int]]:
    """(label, distinct words, how many of them a block must hold) of each template."""
    words = [(label, sorted(set(text.split()))) for label, text in templates]
    return [(label, w, -(-PERCENT * len(w) // 100)) for label, w in words]


def _places(words: Column, phrase: str, label: str) -> Column:
    """Where the phrase's words stand one after another."""
    first, *rest = phrase.split()

    def here(i: Column) -> Column:
        found = F.get(words, i) == first
        for k, word in enumerate(rest, 1):
            found = found & (F.get(words, i + k) == word)
        return found

    enough = (F.size(words) > len(rest)) & F.array_contains(words, first)
    places = F.filter(F.sequence(F.lit(0), F.size(words) - len(rest) - 1), here)
    named = F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
    return F.when(enough, named).otherwise(F.array().cast(_PLACES))


def _blocks(words: Column, known: list[str], least: int, block: int) -> Column:
    """Of each block, its distinct words that templates have, where they are at least ``least``."""
    half = block // 2
    begins = F.sequence(F.lit(0), F.greatest(F.size(words) - half - 1, F.lit(0)), F.lit(half))
    held = F.transform(begins, lambda i: F.array_distinct(F.filter(F.slice(words, i + 1, block), lambda w: w.isin(known))))
    return F.filter(held, lambda b: F.size(b) >= least)


def _array(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def _candidates(blocks: DataFrame, sets: list[tuple[str, list[str], int]], order: list[str]) -> DataFrame:
    """(doc_id, text_key, label, shared, size, need): blocks and templates that share a prefix word and may share enough."""
    place = {w: i for i, w in enumerate(order)}
    prefixes = []
    for number, (label, words, need) in enumerate(sets):
        ordered = sorted(words, key=place.get)
        prefixes += [(w, number, label, i, len(words), need, ordered) for i, w in enumerate(ordered[: len(words) - need + 1])]
    columns = "word string, number int, label string, place int, size int, need int, template array<string>"
    prefix_rows = blocks.sparkSession.createDataFrame(prefixes, columns)
    least = min(need for _, _, need in sets)
    # the order of the first array is kept: a block's words by rarity
    ordered = blocks.withColumn("held", F.array_intersect(_array(order), "held")).withColumn("m", F.size("held"))
    head = ordered.select("*", F.posexplode(F.slice("held", F.lit(1), F.col("m") - (least - 1))).alias("i", "word"))
    met = head.join(F.broadcast(prefix_rows), "word").filter("m >= need AND i <= m - need")
    return met.filter(1 + F.least(F.col("m") - F.col("i"), F.col("size") - F.col("place")) - 1 >= F.col("need"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: tuple[tuple[str, str], ...] = TEMPLATES, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, the phrases' places (first word and label), the labels of the
    templates its blocks hold, and the largest share of such a template that a block holds."""
    sets = _sets(templates)
    known = sorted({w for _, words, _ in sets for w in words})
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(body, 256).alias("text_key"), F.translate(body, UPPER, LOWER).alias("lowered"))
    rows = rows.select("doc_id", "text_key", F.regexp_extract_all("lowered", F.lit(WORD), F.lit(0)).alias("words"))
    words = F.col("words")
    rows = rows.select(
        "doc_id",
        "text_key",
        F.size(words).cast("long").alias("n_words"),
        F.array_sort(F.concat(*(_places(words, phrase, label) for phrase, label in PHRASES))).alias("places"),
        _blocks(words, known, 1, block).alias("blocks"),
    )
    rows = settle(rows)
    blocks = rows.select("doc_id", "text_key", F.explode("blocks").alias("held"))
    # as many rows as templates have words
    counted = dict(blocks.select(F.explode("held").alias("word")).groupBy("word").count().collect())
    order = sorted(known, key=lambda w: (counted.get(w, 0), w))
    least = min(need for _, _, need in sets)
    met = _candidates(blocks.filter(F.size("held") >= least), sets, order)
    shared = F.size(F.array_intersect("held", "template"))
    met = met.withColumn("shared", shared).filter("shared >= need")
    per_text = met.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("label")).alias("held_labels"), F.max(F.col("shared") / F.col("size")).alias("containment"))
    per_text = settle(per_text).withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))
    # a row without a block that is long enough needs no join
    longest = F.coalesce(F.array_max(F.transform("blocks", F.size)), F.lit(0))
    columns = ["doc_id", "n_words", "places"]
    joined = rows.filter(longest >= least).drop("blocks").join(per_text, same, "left").select(*columns, "held_labels", "containment")
    others = rows.filter(longest < least).select(*columns, F.lit(None).cast("array<string>").alias("held_labels"), F.lit(None).cast("double").alias("containment"))
    both = joined.unionByName(others)
    return both.select(*columns, F.coalesce("held_labels", F.array().cast("array<string>")).alias("held_labels"), F.coalesce("containment", F.lit(0.0)).alias("containment"))


def digest(found: DataFrame) -> DataFrame:
    """The registered query's columns. A named phrase makes the score 1."""
    starts, base = F.transform("places", lambda p: p["at"]), F.transform("places", lambda p: p["label"])
    labels = F.array_sort(F.array_union(base, "held_labels"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.col("containment")).alias("score"),
    )


def _phrase_sql(phrase: str, label: str) -> str:
    words = phrase.split()
    here = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words, 1))
    return f"SELECT r, i, '{label}' AS label FROM (SELECT r, w, unnest(range(len(w))) AS i FROM d) WHERE {here}"


def _templates_sql() -> str:
    rows = (f"('{label}', {words!r}, {len(words)}, {need})" for label, words, need in _sets(TEMPLATES))
    return "VALUES " + ", ".join(rows)


#: DuckDB SQL for the registered query, of ``documents``.
SQL = f"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
p AS ({" UNION ALL ".join(_phrase_sql(*p) for p in PHRASES)}),
b AS (SELECT r, w[i + 1 : i + {BLOCK}] AS held FROM (
    SELECT r, w, unnest(range(0, greatest(len(w) - {BLOCK // 2} - 1, 0) + 1, {BLOCK // 2})) AS i FROM d)),
t(label, words, size, need) AS ({_templates_sql()}),
h AS (
    SELECT r, label, max(shared / size) AS containment
    FROM (SELECT r, label, size, need, len(list_distinct(list_intersect(held, words))) AS shared FROM b CROSS JOIN t) WHERE shared >= need GROUP BY r, label),
pr AS (SELECT r, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY r),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM p UNION SELECT r, label FROM h) GROUP BY r),
hr AS (SELECT r, max(containment) AS containment FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, CASE WHEN n > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END AS score
FROM d LEFT JOIN pr USING (r) LEFT JOIN al USING (r) LEFT JOIN hr USING (r)
"""
