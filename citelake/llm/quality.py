"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio between trusted texts and the raw corpus.

Words and word pairs fall into BUCKETS hash buckets. Two multinomials over the buckets are counted: of the trusted texts (a bounded
sample: at most SAMPLE of the documents that labels call good, in the order of a hash of doc_id, whose ids are broadcast) and of all documents.
A document's score is the mean of ln(P trusted / P raw) over its words and pairs; every document is scored and compared with the same
THRESHOLD. The driver receives BUCKETS numbers for each multinomial. Everything is DataFrame functions; counting shuffles a row for each
bucket and task, scoring shuffles nothing.

Words are hashed to 64 bits (XXH64), and an 8-word window's key is the XXH64 of its words' hashes; that windows of one text that differ
share a key has a chance below 1e-10 for a text of 20,000 words.

Defined results: a null or empty text has no words, score 0, and fails the base rules; without trusted rows every score is 0 and the base
rules decide alone; null ids and labels are never trusted; repeated rows are judged row by row and all count as raw; other columns
are passed through, those named like added ones are replaced."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import packed, tokens_of

#: Hash buckets of words and pairs, the bound of the trusted sample, the window of repeats.
BUCKETS, SAMPLE, WINDOW = 16_384, 20_000, 8
#: A document stays if its mean log ratio is at least this: if its words are at most a tenth less likely among trusted texts.
THRESHOLD = -0.1
#: Added to each bucket's trusted count and to what the raw share lets expect, so that rare buckets say little.
SMOOTH = 5.0
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _buckets(h: Column) -> Column:
    """The buckets of all words and of all pairs of neighbours."""
    single = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    pair = F.transform(h, lambda x, i: F.when(i > 0, F.pmod(F.xxhash64(F.get(h, i - 1), x), F.lit(BUCKETS)).cast("int")))
    return F.concat(single, F.slice(pair, 2, F.greatest(F.size(h) - 1, F.lit(0))))


def trusted_ids(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def log_ratios(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[float]:
    """ln(P trusted / P raw) for each bucket; zeros without trusted words."""
    ids = F.broadcast(trusted_ids(labels, sample).select(F.col("doc_id").alias("_id"), F.lit(1).alias("_good")))
    flagged = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left").select("_good", _hashes(tokens_of(F.coalesce("text", F.lit("")))).alias("h"))
    grams = flagged.select("_good", F.explode(_buckets(F.col("h"))).alias("bucket"))
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in grams.groupBy("bucket").agg(F.count("*").alias("n"), F.count("_good").alias("g")).collect():
        raw[r["bucket"]], good[r["bucket"]] = r["n"], r["g"]
    if not sum(good):
        return [0.0] * BUCKETS
    share = sum(good) / sum(raw)
    return [math.log((g + SMOOTH) / (n * share + SMOOTH)) for g, n in zip(good, raw, strict=True)]


def _repeated(h: Column) -> Column:
    """Array of (key, place) of all windows, sorted, for texts in which a window recurs; else empty."""
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    return F.when(F.size(h) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))


def quality_rules(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` with the added columns of ADDED."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(packed(docs, ADDED), text.alias("_text"), tokens_of(text).alias("_w"), F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("_lines"))
    out = out.withColumn("_h", _hashes(F.col("_w"))).withColumn("_win", _repeated(F.col("_h")))
    placed = F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("key"), i.alias("at"))))
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), placed))
    same = lambda e, i: F.get(F.col("_sorted"), i)["key"] == e["key"]
    twice = F.filter("_sorted", lambda e, i: F.coalesce(F.when(i > 0, same(e, i - 1)), F.lit(False)) | F.coalesce(same(e, i + 1), F.lit(False)))
    out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda e: e["at"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("_at", start, lambda s, a: F.struct((s["n"] + a + WINDOW - F.greatest(s["end"], a)).alias("n"), (a + WINDOW).alias("end")), lambda s: s["n"])
    table = F.array(*(F.lit(x) for x in ratios)) if any(ratios) else None
    total = F.aggregate(_buckets(F.col("_h")), F.lit(0.0), lambda s, b: s + F.get(table, b)) if table is not None else F.lit(0.0)
    n = F.size("_w")
    score = F.when(n > 0, total / (2 * n - 1)).otherwise(F.lit(0.0))
    out = out.select(
        "row.*",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        score.alias("score"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ratios = log_ratios(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules(docs, ratios).select("doc_id", *ADDED)
