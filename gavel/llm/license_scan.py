"""License scan by diagonal voting, in DataFrame operations alone.

Every rolling k-gram of words is hashed and joined to the positions of the templates that hold
it. A hit votes for the diagonal (position in the text less position in the template); votes are
summed by row, template and diagonal, diagonals that lie close together are merged, so that a few
inserted or lost words don't split a match, and a merged span counts only if it covers enough of
its template and isn't longer than the template allows. Diagonals that cover enough by themselves
stay apart, and none merge that are a template's length apart: copies that follow each other are
copies each. Hits are confirmed word by word before
they vote, so equal hashes of different words do no harm.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Defined results: a null text counts as empty and has no places; a very long text is split whole, in
one row; spans of several templates at one place all count; rows are told apart by id and
text, so rows that repeat both get the same result each, and a null id is an id like any other;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K = 3
#: Diagonals this near to each other, and nearer than the template is long, belong to one match.
BAND = 4
#: Least covered share of a template, and longest span as a multiple of its length.
COVERED, STRETCH = 0.8, 1.5
#: Most template positions that the join broadcasts; beyond that it shuffles.
MAX_POSITIONS = 100_000

#: The phrases whose places are counted, with their labels.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
#: Wording of common notices, with the labels they give.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "either version 3 of the license or at your option any later version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("all-rights-reserved", "all rights reserved"),
]


def split_words(text: Column) -> Column:
    """Words in order. The Kelvin sign is set aside: of all letters beyond ASCII it alone
    lower-cases to an ASCII one, and only A-Z are to be lower-cased."""
    plain = F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def gram_hashes(words: Column, k: int = K) -> Column:
    starts = F.sequence(F.lit(0), F.size(words) - k)
    return F.when(F.size(words) >= k, F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])))


def template_positions(docs: DataFrame, k: int = K, notices: DataFrame | None = None) -> DataFrame:
    """(gram_hash, gram, template, place, length, label, exact) for every k-gram of every template:
    the phrases, and the ``notices`` (label, text) of at least k words, by default NOTICES."""
    spark = docs.sparkSession
    given = spark.createDataFrame(NOTICES, "label string, text string") if notices is None else notices
    phrases = spark.createDataFrame([*PHRASES.items()], "label string, text string")
    both = phrases.withColumn("exact", F.lit(True)).union(given.select("label", "text", F.lit(False)))
    templates = both.select(F.xxhash64("label", "text", "exact").alias("template"), "label", "exact", split_words(F.col("text")).alias("words")).distinct()
    placed = templates.select("template", "label", "exact", F.size("words").alias("length"), "words", F.posexplode_outer(gram_hashes(F.col("words"), k)).alias("place", "gram_hash"))
    return placed.select("template", "label", "exact", "length", "place", "gram_hash", F.array_join(F.slice("words", F.col("place") + 1, k), " ").alias("gram"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, notices: DataFrame | None = None) -> DataFrame:
    """Per row the id, number of words, places of the phrases, labels and a score.

    The score is the largest covered share among the spans found (1 for a phrase, which stands in
    full; 0 if there is none). Memory: the broadcast side has one row for each template position, and
    is joined by a shuffle beyond ``MAX_POSITIONS``; everything after the join holds hits only,
    grouped by row and template.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").alias("row_id"), F.xxhash64(text).alias("text_hash"), split_words(text).alias("words"))
    grams = keyed.withColumn("gram_hashes", gram_hashes(F.col("words"), k))
    # The outer form, since for the plain one Spark infers a filter on the size of the array and,
    # pushing it to the scan, splits the text anew for every element.
    grams = grams.select("row_id", "text_hash", "words", F.posexplode_outer("gram_hashes").alias("pos", "gram_hash"))
    places = template_positions(docs, k, notices)
    hits = grams.join(F.broadcast(places) if notices is None or places.limit(MAX_POSITIONS + 1).count() <= MAX_POSITIONS else places, "gram_hash").select(
        "row_id", "text_hash", "template", "label", "exact", "length", "place", "gram",
        (F.col("pos") - F.col("place")).alias("diagonal"),
        F.array_join(F.slice("words", F.col("pos") + 1, k), " ").alias("seen"),
    )
    row = ["row_id", "text_hash"]
    diagonals = (
        hits.groupBy(*row, "template", "label", "exact", "length", "diagonal")
        .agg(F.collect_set(F.when(F.col("seen") == F.col("gram"), F.col("place"))).alias("places"))
        .where(F.size("places") > 0)
    )
    by_template = W.partitionBy(*row, "template").orderBy("diagonal")
    covered = lambda c: F.size(F.array_distinct(F.flatten(F.transform(c, lambda p: F.sequence(p, p + k - 1)))))
    diagonals = diagonals.withColumn("alone", F.col("exact") | (covered("places") >= COVERED * F.col("length")))
    band = F.least(F.lit(BAND), F.col("length") - 1)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_template) > band, F.lit(True))
    apart = apart | F.col("alone") | F.coalesce(F.lag("alone").over(by_template), F.lit(False))
    merged = diagonals.withColumn("run", F.sum(apart.cast("int")).over(by_template)).groupBy(*row, "template", "label", "exact", "length", "run").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.min(F.array_min("places") + F.col("diagonal")).alias("first"),
        F.max(F.array_max("places") + F.col("diagonal") + k).alias("last"),
    )
    share = F.least(F.lit(1.0), covered("places") / F.col("length"))
    spans = merged.withColumn("share", share).withColumn(
        "found",
        F.when(F.col("exact"), F.col("share") == 1.0).otherwise(
            (F.col("share") >= COVERED) & (F.col("last") - F.col("first") <= STRETCH * F.col("length"))
        ),
    )
    base = F.col("exact") & F.col("found")
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    by_row = spans.groupBy(*row).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("bigint").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.max(F.when(F.col("found"), F.col("share"))).alias("score"),
    )
    sizes = docs.select(F.col(f"`{id_col}`").alias("own_id"), F.xxhash64(text).alias("own_hash"), F.size(split_words(text)).cast("bigint").alias("n_words"))
    same = F.col("own_id").eqNullSafe(F.col("row_id")) & (F.col("own_hash") == F.col("text_hash"))
    return sizes.join(by_row, same, "left").select(
        F.col("own_id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def scan_sql() -> str:
    """The same rows in DuckDB's SQL, for the default templates."""
    values = ", ".join(f"({n}, '{label}', '{text}', {'true' if n < len(PHRASES) else 'false'})" for n, (label, text) in enumerate([*PHRASES.items(), *NOTICES]))
    return rf"""
WITH templates(template, label, phrase, exact) AS (VALUES {values}
), parts AS (
  SELECT template, label, exact, string_split(phrase, ' ') AS w FROM templates
), grams AS (
  SELECT template, label, exact, len(w) AS length, p, array_to_string(w[p + 1 : p + {K}], ' ') AS gram
  FROM parts, LATERAL (SELECT unnest(range(0, len(w) - {K - 1})) AS p)
), split AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), seen AS (
  SELECT rid, p, array_to_string(w[p + 1 : p + {K}], ' ') AS gram
  FROM split, LATERAL (SELECT unnest(range(0, len(w) - {K - 1})) AS p) WHERE len(w) >= {K}
), diagonals AS (
  SELECT s.rid, g.template, g.label, g.exact, g.length, s.p - g.p AS diagonal, list(DISTINCT g.p) AS places
  FROM seen s JOIN grams g ON s.gram = g.gram GROUP BY ALL
), measured AS (
  SELECT *, exact OR len(list_distinct(flatten(list_transform(places, lambda p: range(p, p + {K}))))) >= {COVERED} * length AS alone
  FROM diagonals
), marked AS (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER w > least({BAND}, length - 1), true) OR alone OR coalesce(lag(alone) OVER w, false) AS apart
  FROM measured WINDOW w AS (PARTITION BY rid, template ORDER BY diagonal)
), numbered AS (
  SELECT *, sum(apart::INT) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM marked
), spans AS (
  SELECT rid, label, exact, length, min(list_min(places) + diagonal) AS first, max(list_max(places) + diagonal + {K}) AS last,
         list_distinct(flatten(list_transform(flatten(list(places)), lambda p: range(p, p + {K})))) AS words
  FROM numbered GROUP BY rid, template, label, exact, length, run
), judged AS (
  SELECT *, least(1.0, len(words) / length) AS share,
         CASE WHEN exact THEN len(words) = length ELSE len(words) / length >= {COVERED} AND last - first <= {STRETCH} * length END AS found
  FROM spans
), by_row AS (
  SELECT rid, count(*) FILTER (WHERE exact AND found) AS n_base, min(first) FILTER (WHERE exact AND found) AS first_word,
         max(first) FILTER (WHERE exact AND found) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact AND found) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found) AS labels, max(share) FILTER (WHERE found) AS score
  FROM judged GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0.0) AS DOUBLE) AS score
FROM split LEFT JOIN by_row USING (rid)
"""
