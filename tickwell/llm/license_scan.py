"""License scans by diagonal voting. DataFrame operations only.

All rolling pairs of words of every text are hashed and joined to the positions of the same pairs in license
templates. A pair at word i of the text and at position p of the template votes for the diagonal i - p, the place
where the template would begin. Votes are summed by (text, template, diagonal); diagonals with enough votes that
are at most `drift` apart are merged, so that a few words put in or left out don't break a place; and the place is
verified by the words themselves: joined pairs are compared as words, and the template's words that are covered by
them must make up the template's least share. Phrases are templates that must be covered whole on one diagonal, so
their places are exactly where their words stand consecutively.

Positions of the templates are counted on the driver, where they come from; while they are at most `broadcast_rows`
they are broadcast, beyond that joined by a shuffle. Texts are never shuffled: a row of the join holds a row number
and two integers, and votes are summed map-side before they meet by text.

Defined cases: null, empty and blank texts have no words, no places, empty labels and score 0; a text of one word has
no pair, so no place; every row comes back, repeated ones and rows without id too; extra columns may have any names;
texts of any length are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, lower_ascii

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases and labels of the contract.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Opening notices of public licenses, as published with them.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution", "cc"),
    ("licensed under cc by", "cc"),
    ("licensed under cc by nc", "cc-nc"),
    ("licensed under cc by sa", "cc-sa"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
]

#: Least share of a notice's words that a place must cover, words below which a notice must be covered whole, diagonals
#: that a place may drift between neighbours, and the share of its pairs that a diagonal needs to count.
SHARE, SHORT, DRIFT, VOTES = (4, 5), 8, 3, (1, 10)


def template_pairs(phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """Rows (template, label, exact, n, position, first, second): each pair of neighbouring words of each template."""
    rows = []
    for t, (text, label, exact) in enumerate([(*x, True) for x in phrases] + [(*x, False) for x in notices]):
        own = text.split(" ")
        if len(own) < 2:
            raise ValueError(f"a template needs two words at least: {text!r}")
        rows += [(t, label, exact, len(own), p, own[p], own[p + 1]) for p in range(len(own) - 1)]
    return rows


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", phrases=PHRASES, notices=NOTICES, broadcast_rows: int = 200_000) -> DataFrame:
    """Columns `keep` with n_words and places: an array of (start, end, template, label, exact, covered, n_template),
    ordered by start, of every place of a phrase or notice."""
    pairs = template_pairs(phrases, notices)
    spark = docs.sparkSession
    table = spark.createDataFrame(pairs, "template int, label string, exact boolean, n int, position int, first string, second string")
    table = table.withColumn("pair", F.xxhash64("first", "second"))
    w = F.filter(F.split(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), NOT_WORD), lambda x: x != "")
    own = docs.select(F.struct(*keep, F.monotonically_increasing_id().alias(fresh(keep, "_row"))).alias("_own"), w.alias("_w"))
    own = own.select(F.col(f"_own.{own.schema['_own'].dataType.names[-1]}").alias("_row"), "_own", "_w", F.posexplode_outer("_w").alias("i", "second"))
    # the row of the first word, or of no word, stands for the text itself; a pair that ends at word i begins at i - 1
    whole = F.when(F.coalesce(F.col("i"), F.lit(0)) == 0, F.struct("_own", F.size("_w").cast("long").alias("n_words")))
    grams = own.select("_row", whole.alias("_text"), (F.col("i") - 1).alias("i"), F.get("_w", F.col("i") - 1).alias("first"), "second")
    grams = grams.withColumn("pair", F.xxhash64("first", "second"))
    if len(pairs) <= broadcast_rows:
        table = F.broadcast(table)
    told = grams.join(table, ["pair", "first", "second"], "left").filter("template IS NOT NULL OR _text IS NOT NULL")
    hits = told.select("_row", "_text", "template", "label", "exact", "n", "position", (F.col("i") - F.col("position")).alias("diagonal")).repartition("_row")
    # the text's own row has no template and is a group by itself in all that follows
    key = ["_row", "template", "label", "exact", "n"]
    votes = hits.groupBy(*key, "diagonal").agg(F.count("position").alias("votes"), F.collect_set("position").alias("held"), F.first("_text", True).alias("_text"))
    least = F.when(F.col("exact"), F.col("n") - 1).otherwise(F.greatest(F.lit(1), F.ceil((F.col("n") - 1) * VOTES[0] / VOTES[1])))
    votes = votes.filter(F.col("template").isNull() | (F.col("votes") >= least))
    line = Window.partitionBy("_row", "template").orderBy("diagonal")
    begins = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > DRIFT, F.lit(True))
    votes = votes.withColumn("begins", begins.cast("int")).withColumn("place", F.sum("begins").over(line))
    held = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("held")), lambda p: F.array(p, p + 1))))
    low = F.min(F.col("diagonal") + F.array_min("held"))
    high = F.max(F.col("diagonal") + F.array_max("held")) + 2
    merged = votes.groupBy(*key, "place").agg(F.size(held).alias("covered"), low.cast("long").alias("start"), high.cast("long").alias("end"), F.first("_text", True).alias("_text"))
    # verified: enough of the template's words, in a span not much longer than the template
    good = (F.col("covered") * SHARE[1] >= F.col("n") * SHARE[0]) & ((F.col("end") - F.col("start")) * SHARE[0] <= F.col("n") * SHARE[1])
    good = F.when(F.col("exact") | (F.col("n") < SHORT), F.col("covered") == F.col("n")).otherwise(good)
    place = F.when(good, F.struct("start", "end", "template", "label", "exact", F.col("covered").cast("int").alias("covered"), F.col("n").alias("n_template")))
    found = merged.groupBy("_row").agg(F.first("_text", True).alias("_text"), F.array_sort(F.collect_list(place)).alias("places"))
    return found.select(*[F.col("_text._own")[c].alias(c) for c in keep], F.col("_text.n_words").alias("n_words"), "places")


def _labels(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of the result of scan. The score is the largest share of a template that a place covers."""
    base = F.filter("places", lambda p: p["exact"])
    starts = F.transform(base, lambda p: p["start"])
    share = F.array_max(F.transform("places", lambda p: p["covered"] / p["n_template"]))
    return found.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"), _labels(F.col("places")).alias("labels"), F.coalesce(share, F.lit(0.0)).alias("score"),
    )


def oracle(phrases=PHRASES, notices=NOTICES) -> str:
    """The same scan as one SQL statement, with every pair of words joined as words."""
    rows = ",\n    ".join(f"({t}, '{label}', {str(exact).lower()}, {n}, {p}, '{a}', '{b}')" for t, label, exact, n, p, a, b in template_pairs(phrases, notices))
    return f"""
WITH pairs(template, label, exact, n, position, first, second) AS (VALUES
    {rows}),
texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_WORD}'), lambda x: x <> '') AS w
  FROM documents),
grams AS (SELECT r, unnest(list_zip(w[:-2], w[2:], range(len(w) - 1))) AS g FROM texts WHERE len(w) > 1),
hits AS (
  SELECT r, template, label, exact, n, position, g[3] - position AS diagonal
  FROM grams JOIN pairs ON g[1] = pairs.first AND g[2] = pairs.second),
votes AS (
  SELECT r, template, label, exact, n, diagonal, count(*) AS votes, list(position) AS held, min(position) AS least, max(position) AS most
  FROM hits GROUP BY ALL
  HAVING count(*) >= CASE WHEN exact THEN n - 1 ELSE greatest(1, ceil((n - 1) * {VOTES[0]} / {VOTES[1]})) END),
begun AS (
  SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {DRIFT}, true) THEN 1 ELSE 0 END AS begins
  FROM votes),
placed AS (SELECT *, sum(begins) OVER (PARTITION BY r, template ORDER BY diagonal) AS place FROM begun),
merged AS (
  SELECT r, template, label, exact, n, place, min(diagonal + least) AS start, max(diagonal + most) + 2 AS stop,
    len(list_distinct(flatten([flatten(list(held)), list_transform(flatten(list(held)), lambda p: p + 1)]))) AS covered
  FROM placed GROUP BY ALL),
good AS (
  SELECT * FROM merged
  WHERE CASE WHEN exact OR n < {SHORT} THEN covered = n ELSE covered * {SHARE[1]} >= n * {SHARE[0]} AND (stop - start) * {SHARE[0]} <= n * {SHARE[1]} END),
told AS (
  SELECT r, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(covered / n) AS score
  FROM good GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM texts LEFT JOIN told USING (r)"""
