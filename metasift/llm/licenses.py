"""Licence scan with DataFrame functions only.

Two finds in one pass over the texts. Phrases: places where a phrase's words stand consecutively. Templates: an exact
set-similarity join of text blocks with licence notices. A block is any run of words as long as the notice and a quarter
more, wherever lines end. Tokens are ordered by how many texts of the corpus hold them, rare ones first. Only the blocks
around tokens of a notice's prefix are made: a block that holds enough of its tokens must hold one of its rarest. Each block
is judged at its rarest token (so the places of that token and of those after it must still allow the required overlap), if
enough of the notice's tokens are near. Every block that is left is counted exactly, so the join loses none.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metasift.llm.common import settle

#: Fixed by the query's contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices by label; a parameter of the operator.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-work", "this work is licensed under the gnu general public license version 3"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-notice", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
)


def lowered(text: Column) -> Column:
    """Lower case. The Kelvin sign is the one other character that would become an ASCII letter, so it is put aside."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))


def required(size: int, threshold: float) -> int:
    return math.ceil(round(size * threshold, 9))


def phrase_starts(words: Column, joined: Column, phrase: str) -> Column:
    """Start of each place; the search by word runs only where the joined words hold the phrase."""
    parts = phrase.split()
    matches = lambda i: _all([F.get(words, i + k) == part for k, part in enumerate(parts)])
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), matches)
    return F.when(F.contains(joined, F.lit(f" {phrase} ")), places).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _rows(spark: SparkSession, rows: list[tuple[str, int, int, int, int, int]]) -> DataFrame:
    """A small constant table, a few rows a template: token, template, place, size, needed, words of a block."""
    values = ", ".join(f"('{t}', {', '.join(map(str, numbers))})" for t, *numbers in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(token, template, t_place, t_size, needed, span)")


def block_size(template: str) -> int:
    """Words of a block that is compared with a template."""
    return -(-len(template.split()) * 5 // 4)


def template_matches(texts: DataFrame, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """``texts`` (row, tokens: its distinct template words, known: place and word of each template word) to row, template and the containment of a block that meets it."""
    spark = texts.sparkSession
    sets = [sorted(set(text.split())) for _, text in templates]
    vocabulary = sorted({w for s in sets for w in s})
    counted = texts.select(F.explode("tokens").alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in counted.collect()}  # at most one row for each template word
    ordered = [sorted(words, key=lambda w: (counts.get(w, 0), w)) for words in sets]
    prefixes, spans = [], [block_size(text) for _, text in templates]
    for k, words in enumerate(ordered):
        needed = required(len(words), threshold)
        prefixes += [(w, k, i, len(words), needed, spans[k]) for i, w in enumerate(words[: len(words) - needed + 1])]
    reach = max(spans)
    is_prefix = lambda w: w.isin(sorted({p[0] for p in prefixes}))
    # what stands near a prefix token, so that no row carries its whole text along
    near = lambda i: F.slice("known", F.greatest(i - reach, F.lit(0)) + 1, 2 * reach)
    hits = F.array_compact(F.transform("known", lambda x, i: F.when(is_prefix(x["word"]), F.struct(x["at"].alias("at"), x["word"].alias("token"), near(i).alias("near")))))
    met = texts.where(F.size("known") > 0).select("row", F.explode(hits).alias("hit")).select("row", "hit.*").join(F.broadcast(_rows(spark, prefixes)), "token")
    # of the block's tokens, those that are no rarer than the one it is judged at
    later = F.slice(F.get(F.array(*[_literals(words) for words in ordered]), F.col("template")), F.col("t_place") + 1, F.col("t_size"))
    own = F.filter("near", lambda x: (F.abs(x["at"] - F.col("at")) < F.col("span")) & F.array_contains(F.col("later"), x["word"]))
    met = met.withColumn("later", later).withColumn("own", own).where(F.size("own") >= F.col("needed"))
    held = lambda start: F.size(F.array_distinct(F.transform(F.filter("own", lambda x: (x["at"] >= start) & (x["at"] < start + F.col("span"))), lambda x: x["word"])))
    overlap = F.array_max(F.transform(F.filter("own", lambda x: x["at"] <= F.col("at")), lambda x: held(x["at"])))
    return met.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("needed")).select("row", "template", (F.col("overlap") / F.col("t_size")).alias("containment"))


def scan_licenses(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.9
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, template_labels (arrays) and score.

    Null and empty texts have no words, no labels and score 0. Very long texts are read whole. Repeated rows are judged each;
    templates that tie are all reported. Other columns are ignored, whatever their names. An empty table gives an empty one.
    ``score`` is the highest containment found, 1 for a phrase.
    """
    words = sorted({w for _, text in templates for w in text.split()})
    if bad := [w for w in words if not re.fullmatch("[a-z0-9]+", w)]:
        raise ValueError(f"template words must be lower-case letters and digits: {bad}")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.regexp_extract_all(lowered(F.col(text_col)), F.lit(WORD), F.lit(0)).alias("words"))
    rows = rows.withColumns({"joined": F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")), "tokens": F.array_distinct(F.filter("words", lambda w: w.isin(words)))})
    # a text holds no block that its words as a whole don't allow
    sets = [sorted(set(text.split())) for _, text in templates]
    may_hold = _any([F.size(F.array_intersect("tokens", _literals(own))) >= required(len(own), threshold) for own in sets])
    known = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(words))
    rows = rows.select(
        "row",
        "id",
        F.size("words").cast("long").alias("n_words"),
        *[phrase_starts(F.col("words"), F.col("joined"), phrase).alias(f"at_{k}") for k, (phrase, _) in enumerate(phrases)],
        "tokens",
        F.when(may_hold, known).otherwise(F.array().cast("array<struct<at:int,word:string>>")).alias("known"),
    )
    rows = settle(rows)

    names = _literals([label for label, _ in templates])
    found = template_matches(rows.select("row", "tokens", "known"), templates, threshold).groupBy("row").agg(F.array_sort(F.collect_set(F.get(names, F.col("template")))).alias("template_labels"), F.max("containment").alias("containment"))
    starts = F.concat(*[F.col(f"at_{k}") for k in range(len(phrases))])
    base = F.array_distinct(F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]))))
    return rows.join(found, "row", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        base.alias("base_labels"),
        F.coalesce("template_labels", F.array().cast("array<string>")).alias("template_labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The query's columns out of ``scan_licenses``' rows."""
    labels = F.array_sort(F.array_union("base_labels", "template_labels"))
    return found.withColumns({"labels": F.array_join(labels, ","), "base_labels": F.array_join("base_labels", ",")}).drop("template_labels")


def digest_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.9) -> str:
    """The same result in DuckDB, every block that begins at a template's word against that template."""
    values = ", ".join(f"('{label}', {sorted(set(text.split()))}, {required(len(set(text.split())), threshold)}, {block_size(text)})" for label, text in templates)
    phrases = ", ".join(f"('{phrase}', {phrase.split()}, '{label}')" for phrase, label in PHRASES)
    return f"""
WITH templates AS (SELECT * FROM (VALUES {values}) t(label, words, needed, span)),
phrases AS (SELECT * FROM (VALUES {phrases}) p(phrase, words, label)),
docs AS (SELECT row_number() OVER () AS row, doc_id, lower(replace(coalesce(text, ''), chr(8490), 'ĸ')) AS low FROM documents),
words AS (SELECT row, doc_id, low, regexp_extract_all(low, '{WORD}') AS w FROM docs),
places AS (SELECT row, label, i FROM words, phrases, unnest(range(0, len(w))) r(i)
           WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || phrase || ' ') AND w[i + 1 : i + len(words)] = words),
base AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(DISTINCT label) AS ls FROM places GROUP BY row),
every AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
hits AS (SELECT row, label, i, word, span, needed, len(words) AS size FROM every JOIN (SELECT *, unnest(words) AS held FROM templates) t ON word = held),
pairs AS (SELECT row, label, size, needed, count(DISTINCT word) OVER (PARTITION BY row, label ORDER BY i RANGE BETWEEN CURRENT ROW AND (span - 1) FOLLOWING) AS n FROM hits),
found AS (SELECT row, list(DISTINCT label) AS ls, max(n / size) AS containment FROM pairs WHERE n >= needed GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(found.ls, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0)::DOUBLE END AS score
FROM words LEFT JOIN base USING (row) LEFT JOIN found USING (row)
"""
