"""License scan with a positional index of rare licence words.

The templates (TEMPLATES) are short licence notices. The index holds each template word's places. One job counts in how many
documents each template word stands (at most a few hundred words; that bounded table goes to the driver). Then, row by row
and without a shuffle: each template's ANCHORS rarest words are looked up in the file with their places; a template's places and the file's
are intersected by relative position, and the best alignment counts the words that it puts in place; a template is found if its mandatory
phrases stand in the file and enough words are in place. Every template has anchors of its own, so a file may hold any number of
notices. Everything is DataFrame functions.

Base: the places of BASE phrases, whatever the index says.

Defined results: a null or empty text has no words, labels '' and score 0; repeated rows are scanned row by row; ties between words of one
frequency go by the alphabet; other columns are passed through, those named like added ones are replaced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import packed, words_of

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Licence notices: label, text, mandatory phrases.
TEMPLATES = [
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation version 3", ["gnu affero general public license"]),
    ("all-rights-reserved", "All rights reserved", ["all rights reserved"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("boost-1.0", "Distributed under the Boost Software License, Version 1.0", ["boost software license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc0-1.0", "Dedicated to the public domain under CC0 1.0", ["cc0 1 0"]),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("mit-notice", "Released under the MIT License", ["under the mit license"]),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "associated documentation files"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software"]),
]
#: Rarest words of a template that are looked up, and the least share of their places that must be in place.
ANCHORS, SHARE = 8, 0.5
ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _plain_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _index() -> list[tuple[str, dict[str, list[int]], int, list[str]]]:
    """(label, places of each word, number of words, mandatory phrases) of each template."""
    out = []
    for label, text, phrases in TEMPLATES:
        words = _plain_words(text)
        out.append((label, {w: [i for i, x in enumerate(words) if x == w] for w in dict.fromkeys(words)}, len(words), phrases))
    return out


def _base(words: Column) -> Column:
    """Array of (start, label) of all places of base phrases."""

    def at(word: Column, i: Column) -> Column:
        out = F.lit(None).cast("struct<start:int,label:string>")
        for phrase, label in BASE.items():
            parts = phrase.split()
            n = len(parts)
            fits = reduce(lambda a, b: a & b, [word == parts[-1], i >= n - 1, *(F.get(words, i - (n - 1 - k)) == p for k, p in enumerate(parts[:-1]))])
            out = F.when(fits, F.struct((i - (n - 1)).cast("int").alias("start"), F.lit(label).alias("label"))).otherwise(out)
        return out

    ends = {p.split()[-1] for p in BASE}
    any_end = F.arrays_overlap(words, F.array(*(F.lit(e) for e in sorted(ends))))
    return F.when(any_end, F.filter(F.transform(words, at), lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<start:int,label:string>>"))


def _in_place(hits: Column, places: dict[str, list[int]]) -> Column:
    """The most words that one relative position puts in place: the longest run of equal differences."""
    table = F.create_map(*(x for w, at in sorted(places.items()) for x in (F.lit(w), F.array(*(F.lit(i) for i in at)))))
    mine = F.filter(hits, lambda h: h["word"].isin(sorted(places)))
    starts = F.sort_array(F.flatten(F.transform(mine, lambda h: F.transform(F.element_at(table, h["word"]), lambda i: h["at"] - i))))
    zero = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, start: Column) -> Column:
        run = F.when(start == state["last"], state["run"] + 1).otherwise(F.lit(1))
        return F.struct(start.alias("last"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(starts, zero, step, lambda s: s["best"])


def _rarest(places: dict[str, list[int]], frequency: dict[str, int], anchors: int) -> dict[str, list[int]]:
    """A template's rarest words and their places; of words in equally many documents the first of the alphabet."""
    return {w: places[w] for w in sorted(places, key=lambda w: (frequency[w], w))[:anchors]}


def license_scan(docs: DataFrame, anchors: int = ANCHORS, share: float = SHARE) -> DataFrame:
    """The rows of `docs` with the added columns n_words, n_base, first_word, last_word, base_labels, labels, score."""
    index = _index()
    vocabulary = sorted({w for _, places, _, _ in index for w in places})
    listed = F.array(*(F.lit(w) for w in vocabulary))
    counted = docs.select(F.explode(F.array_intersect(words_of(F.coalesce("text", F.lit(""))), listed)).alias("word")).groupBy("word").count()
    frequency = {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in counted.collect()}
    rarest = {label: _rarest(places, frequency, anchors) for label, places, _, _ in index}
    looked_up = sorted({w for own in rarest.values() for w in own})
    found = docs.select(packed(docs, ADDED), words_of(F.coalesce("text", F.lit(""))).alias("_w"))
    joined = F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" "))
    found = found.select("row", "_w", _base(F.col("_w")).alias("_base"), joined.alias("_text"))
    verified = F.filter(F.array(*(F.when(reduce(lambda a, b: a & b, [F.contains(F.col("_text"), F.lit(f" {p} ")) for p in phrases]), F.lit(label)) for label, _, _, phrases in index)), lambda x: x.isNotNull())
    found = found.select("row", "_w", "_base", verified.alias("_verified"))
    hits = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(looked_up), F.struct(i.alias("at"), w.alias("word")))), lambda x: x.isNotNull())
    found = found.withColumn("_hits", F.when(F.size("_verified") > 0, hits))
    scores = []
    for label, own in rarest.items():
        score = _in_place(F.col("_hits"), own) / F.lit(sum(map(len, own.values())))
        scores.append(F.when(F.array_contains("_verified", label), F.struct(score.alias("score"), F.lit(label).alias("label"))))
    found = found.withColumn("_scored", F.when(F.size("_verified") > 0, F.filter(F.array(*scores), lambda x: x.isNotNull() & (x["score"] >= share))))
    base = F.array_distinct(F.transform("_base", lambda x: x["label"]))
    own = F.coalesce(F.transform("_scored", lambda x: x["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("_scored", lambda x: x["score"])), F.lit(0.0))
    starts = F.transform("_base", lambda x: x["start"])
    return found.select(
        "row.*",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, own)), ",").alias("labels"),
        F.greatest(best, F.when(F.size("_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", *ADDED)


def _oracle() -> str:
    base = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in BASE.items())
    word = ", ".join(f"('{label}', {i}, '{w}')" for label, places, _, _ in _index() for w, at in places.items() for i in at)
    phrase = ", ".join(f"('{label}', ' {p} ')" for label, _, _, phrases in _index() for p in phrases)
    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
base(phrase, n, label) AS (VALUES {base}),
tw(label, tpos, word) AS (VALUES {word}),
tp(label, phrase) AS (VALUES {phrase}),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
b AS (SELECT d.rid, x.pos, base.label FROM x JOIN d USING (rid) JOIN base ON x.word = string_split(base.phrase, ' ')[1] AND array_to_string(d.w[x.pos + 1:x.pos + base.n], ' ') = base.phrase),
bs AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM b GROUP BY rid),
lx AS (SELECT x.* FROM x WHERE word IN (SELECT word FROM tw)),
df AS (SELECT word, count(DISTINCT rid) AS n FROM lx GROUP BY word),
rare AS (
  SELECT label, word FROM (SELECT label, word, row_number() OVER (PARTITION BY label ORDER BY coalesce(n, 0), word) AS k FROM (SELECT DISTINCT label, word FROM tw) LEFT JOIN df USING (word))
  WHERE k <= {ANCHORS}),
anchor AS (SELECT label, tpos, word, count(*) OVER (PARTITION BY label) AS need FROM tw JOIN rare USING (label, word)),
ok AS (
  SELECT rid, label FROM (SELECT d.rid, tp.label, bool_and(contains(' ' || array_to_string(d.w, ' ') || ' ', tp.phrase)) AS fits
  FROM d, tp GROUP BY d.rid, tp.label) WHERE fits),
al AS (
  SELECT rid, label, max(n) / any_value(need) AS score FROM (
    SELECT lx.rid, a.label, lx.pos - a.tpos AS start, count(*) AS n, any_value(a.need) AS need
    FROM lx JOIN anchor a USING (word) JOIN ok ON ok.rid = lx.rid AND ok.label = a.label GROUP BY 1, 2, 3)
  GROUP BY rid, label HAVING max(n) / any_value(need) >= {SHARE}),
ls AS (
  SELECT rid, string_agg(label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT DISTINCT rid, label, true AS is_base FROM b UNION ALL SELECT rid, label, false FROM al) GROUP BY rid)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(bs.n_base, 0) AS n_base, bs.first_word, bs.last_word,
       coalesce(ls.base_labels, '') AS base_labels, coalesce(ls.labels, '') AS labels,
       greatest(coalesce(ma.score, 0), CASE WHEN bs.n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN bs USING (rid) LEFT JOIN ls USING (rid) LEFT JOIN (SELECT rid, max(score) AS score FROM al GROUP BY rid) ma USING (rid)
"""


ORACLE_OP1 = _oracle()
