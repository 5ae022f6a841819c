"""License statements in texts by diagonal voting over word k-grams.

Templates are the words of license phrases and notices. All rolling k-grams of a text meet the
templates' k-grams in a join on their hashes (the words decide); a hit at word p of a text and word t of a
template votes for the diagonal p - t. A short phrase stands where all its k-grams vote for one
diagonal. A notice may have words put in or left out, which moves the rest to a neighbouring diagonal:
diagonals close to each other are merged, and the span is verified by the share of the notice's
distinct k-grams that voted.

The templates are a parameter of bounded size, so they are broadcast. Rows are numbered in a stored
table, and all grouping goes by that number: whatever repeats, no two rows meet.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_words, numbered, read

K = 3
#: Words put in or left out between two parts of a notice that are still one span.
SLACK = 8
#: Share of a notice's k-grams that verifies a span.
SHARE = 0.5
#: Templates are broadcast; more words than this are refused.
TEMPLATE_WORDS = 1_000_000


class Template(NamedTuple):
    label: str
    words: list[str]
    #: A phrase must stand word by word; a notice may be changed here and there.
    exact: bool


def _template(label: str, text: str, exact: bool = False) -> Template:
    return Template(label, [w.decode() for w in ascii_words(text)], exact)


# The phrases and labels that every result must name.
PHRASES = [
    _template("mit", "under the mit license", True),
    _template("apache-2", "apache license version 2", True),
    _template("cc-by-nc", "cc by nc", True),
]

# Public license notices.
NOTICES = [
    _template("gpl-3", "gnu general public license, version 3"),
    _template("gpl-2", "gnu general public license, version 2"),
    _template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software",
    ),
    _template(
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    _template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
    ),
    _template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ),
    _template(
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    _template(
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    _template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    _template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    _template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
]


def words(column: str) -> Column:
    """The words of a text: runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.translate(F.coalesce(F.col(column), F.lit("")), upper, upper.lower())
    return F.filter(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def template_grams(spark: SparkSession, templates: list[Template], k: int = K) -> DataFrame:
    """template, label, exact, grams (how many the template has), at, gram: a row for each k-gram."""
    if sum(len(t.words) for t in templates) > TEMPLATE_WORDS:
        raise ValueError(f"templates are broadcast and may hold {TEMPLATE_WORDS} words at most")
    if any(len(t.words) < k for t in templates):
        raise ValueError(f"a template needs {k} words at least")
    rows = [
        (n, t.label, t.exact, len(t.words) - k + 1, at, t.words[at : at + k])
        for n, t in enumerate(templates)
        for at in range(len(t.words) - k + 1)
    ]
    grams = spark.createDataFrame(rows, "template int, label string, exact boolean, grams int, at int, gram array<string>")
    return grams.withColumn("hash", F.xxhash64("gram"))


def votes(rows: DataFrame, grams: DataFrame, k: int = K) -> DataFrame:
    """Hits of numbered rows (``_row``, ``text``): a row for each place where a text's k-gram equals a template's."""
    rolled = F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda i: F.xxhash64(F.slice("words", i + 1, k)))
    cut = rows.select("_row", words("text").alias("words")).where(F.size("words") >= k)
    places = cut.select("_row", "words", F.posexplode(rolled).alias("place", "hash"))
    hits = places.join(F.broadcast(grams), "hash").where(F.slice("words", F.col("place") + 1, k) == F.col("gram"))
    return hits.select("_row", "template", "label", "exact", "grams", "at", "place", (F.col("place") - F.col("at")).alias("diagonal"))


def spans(hits: DataFrame, k: int = K, slack: int = SLACK) -> DataFrame:
    """_row, template, label, exact, start, end (words), share: merged diagonals, and the share of distinct k-grams that voted."""
    order = Window.partitionBy("_row", "template").orderBy("diagonal", "at")
    gap = F.when(F.col("exact"), F.lit(0)).otherwise(F.lit(slack))
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > gap, F.lit(True))
    merged = hits.withColumn("_new", new.cast("int")).withColumn("_span", F.sum("_new").over(order))
    by = ["_row", "template", "label", "exact", "grams", "_span"]
    found = merged.groupBy(*by, "at").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    found = found.groupBy(*by).agg(F.min("first").alias("start"), (F.max("last") + k).alias("end"), F.count("*").alias("voted"))
    return found.select(*by[:4], F.col("start").cast("long"), F.col("end").cast("long"), (F.col("voted") / F.col("grams")).alias("share"))


def license_scan(docs: DataFrame, phrases: list[Template] | None = None, notices: list[Template] | None = None, share: float = SHARE, k: int = K) -> DataFrame:
    """doc_id, n_words, spans (label, exact, start, end, share; verified ones by start) and score for each row of ``docs``.

    A phrase's span is verified when all its k-grams vote, a notice's when ``share`` of them do. The score is
    the largest share of any span, verified or not, and 0.0 without hits. Null and empty texts have no
    words. Rows that repeat, and null or repeated doc_ids, are rows of their own; other columns are
    ignored; an empty table gives an empty one. A long text is cut into words whole.
    """
    templates = [*(PHRASES if phrases is None else phrases), *(NOTICES if notices is None else notices)]
    rows = numbered(docs.select("doc_id", "text"))
    found = spans(votes(rows, template_grams(docs.sparkSession, templates, k), k), k)
    verified = F.when(F.col("share") >= F.when(F.col("exact"), F.lit(1.0)).otherwise(F.lit(share)), F.struct("start", "end", "label", "exact", "share"))
    per_row = found.groupBy("_row").agg(F.array_sort(F.collect_list(verified)).alias("spans"), F.max("share").alias("score"))
    kind = "array<struct<start:bigint,end:bigint,label:string,exact:boolean,share:double>>"
    counted = rows.select("_row", "doc_id", F.size(words("text")).cast("long").alias("n_words"))
    return counted.join(per_row, "_row", "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.array().cast(kind)).alias("spans"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["exact"])
    starts = F.transform("_base", lambda s: s["start"])
    names = lambda column: F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda s: s["label"]))), ",")
    found = license_scan(read(spark, sf_dir, "documents")).withColumn("_base", base)
    return found.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names("_base").alias("base_labels"),
        names("spans").alias("labels"),
        "score",
    )


def _values() -> str:
    """The templates' k-grams as rows of SQL."""
    rows = []
    for n, t in enumerate([*PHRASES, *NOTICES]):
        grams = len(t.words) - K + 1
        rows += [f"({n}, '{t.label}', {str(t.exact).lower()}, {grams}, {at}, '{' '.join(t.words[at:at + K])}')" for at in range(grams)]
    return ",\n    ".join(rows)


SQL = f"""
WITH grams(template, label, exact, grams, spot, gram) AS (VALUES
    {_values()}
),
docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
),
cut AS (
    SELECT r, doc_id, list_filter(
        regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'),
        lambda w: w <> '') AS words
    FROM docs
),
places AS (
    SELECT r, words, unnest(range(len(words) - {K - 1})) AS place FROM cut WHERE len(words) >= {K}
),
hits AS (
    SELECT p.r, g.template, g.label, g.exact, g.grams, g.spot, p.place, p.place - g.spot AS diagonal
    FROM (SELECT r, place, array_to_string(words[place + 1:place + {K}], ' ') AS gram FROM places) p JOIN grams g USING (gram)
),
marked AS (
    SELECT *, CASE WHEN coalesce(diagonal - lag(diagonal) OVER w > CASE WHEN exact THEN 0 ELSE {SLACK} END, true) THEN 1 ELSE 0 END AS new
    FROM hits WINDOW w AS (PARTITION BY r, template ORDER BY diagonal, spot)
),
numbered AS (
    SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal, spot ROWS UNBOUNDED PRECEDING) AS span FROM marked
),
spans AS (
    SELECT r, template, label, exact, span, min(place) AS start, count(DISTINCT spot)::DOUBLE / any_value(grams) AS share
    FROM numbered GROUP BY r, template, label, exact, span
),
verified AS (
    SELECT * FROM spans WHERE share >= CASE WHEN exact THEN 1.0 ELSE {SHARE} END
),
found AS (
    SELECT r, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
        list_sort(list(DISTINCT label) FILTER (exact)) AS base_labels, list_sort(list(DISTINCT label)) AS labels
    FROM verified GROUP BY r
),
scores AS (
    SELECT r, max(share) AS score FROM spans GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM cut LEFT JOIN found USING (r) LEFT JOIN scores USING (r)
"""
