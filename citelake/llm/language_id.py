"""Language identification, word first: known words by their log frequency in each language, unseen words by character n-grams.

Training texts are all rows with a language outside the held-out fold; all their words count, and the word table grows with the corpus.
A word that no training text holds is scored by the longest known n-gram at each of its places, from NGRAM characters (word
edges included) down to one; n-grams are counted once per distinct training word. A document's score in a language is the sum over
its words; each distinct word's scores are worked out once (see terms). Words are runs of letters in lower case.

The n-gram table is whole, however large: it is only joined by shuffles. What a place in a word looks up is its window, the NGRAM characters
from there (fewer at the word's end); each distinct window of unseen words finds its longest known n-gram once, by joins on keys that few
windows share, and the words then sum over their windows as documents do over their words. The languages themselves are taken to be
few (they are columns). Words, and windows, meet what sums over them by a shuffle join but for the bounded head.

Defined results: a null text, or one without letters, is `und` with score 0, and so is every text if nothing can be learned;
ties go to the language that is first in the alphabet; a null id is in neither fold, so such rows are predicted but not learned from;
repeated rows are predicted row by row and count as often in training; extra columns are not read."""

from __future__ import annotations

from collections.abc import Callable

import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import durable, fold, forget
from .pretokens import runs
from .terms import HEAD, corpus_terms, document_sums

#: Longest n-gram, and what smoothing adds to a word's and an n-gram's count.
NGRAM, SMOOTH_WORD, SMOOTH_GRAM = 4, 0.5, 0.5
#: Parts of a natural logarithm that scores are counted in.
UNIT = 1000
_LETTERS = regex.compile(r"\p{L}+").findall


def words() -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
    return (lambda text: runs(text.lower())), (lambda run: [run] if run.isalpha() else _LETTERS(run))


def _grams(text: Column, lengths: list[int]) -> Column:
    """At each place of a text the grams of the given lengths that fit there; the last length is cut at the text's end if it is the only one."""
    places = F.sequence(F.lit(1), F.length(text))
    if len(lengths) == 1:
        return F.transform(places, lambda i: F.substring(text, i, F.lit(lengths[0])))
    return F.flatten(F.transform(places, lambda i: F.array_compact(F.array(*(F.when(i + (n - 1) <= F.length(text), F.substring(text, i, F.lit(n))) for n in lengths)))))


def gram_scores(table: DataFrame, languages: int) -> DataFrame:
    """(gram, l0, l1, ...): the log share of each n-gram among those of its length in the distinct training words of each language, in
    thousandths."""
    cols = [f"c{i}" for i in range(languages)]
    seen = table.filter(F.greatest(*(F.col(c) for c in cols), F.lit(0)) > 0).select(F.concat(F.lit("^"), "term", F.lit("$")).alias("w"), *cols)
    held = [F.count_if(F.col(c) > 0).alias(f"g{i}") for i, c in enumerate(cols)]
    counted = durable(seen.select(F.explode(_grams(F.col("w"), [*range(1, NGRAM + 1)])).alias("gram"), *cols).groupBy("gram").agg(*held))
    of_length = {r["k"]: r for r in counted.groupBy(F.length("gram").alias("k")).agg(F.count("*").alias("size"), *(F.sum(f"g{i}").alias(f"t{i}") for i in range(languages))).collect()}
    length = F.length("gram")

    def score(i: int) -> Column:
        below = F.coalesce(*(F.when(length == k, F.lit(float(r[f"t{i}"] + SMOOTH_GRAM * (r["size"] + 1)))) for k, r in sorted(of_length.items())), F.lit(1.0))
        return F.round(F.log((F.col(f"g{i}") + SMOOTH_GRAM) / below) * UNIT).cast("int").alias(f"l{i}")

    return counted.select("gram", *(score(i) for i in range(languages)))


def window_scores(unseen: DataFrame, grams: DataFrame, languages: int) -> DataFrame:
    """(term, n, found, l0, l1, ...): each distinct window of unseen words (term) with the scores of its longest known n-gram; found is 0 if none is."""
    padded = F.concat(F.lit("^"), "term", F.lit("$"))
    scores = [f"l{i}" for i in range(languages)]
    at = unseen.select(F.explode(_grams(padded, [NGRAM])).alias("window")).groupBy("window").agg(F.count("*").alias("n"))
    at = at.select("window", "n", *(F.lit(None).cast("int").alias(x) for x in scores))
    for k in range(NGRAM, 0, -1):
        own = grams.filter(F.length("gram") == k).select(F.col("gram").alias("_gram"), *(F.col(x).alias(f"_{x}") for x in scores))
        # What is found already has a key that meets nothing, and its own, so that such rows don't meet in one task.
        key = F.when(F.col("l0").isNull() & (F.length("window") >= k), F.left("window", F.lit(k))).otherwise(F.concat(F.lit(" "), "window"))
        at = at.join(own, key == F.col("_gram"), "left").select("window", "n", *(F.coalesce(x, f"_{x}").alias(x) for x in scores))
    return at.select(F.col("window").alias("term"), "n", F.when(F.col("l0").isNull(), 0).otherwise(1).alias("found"), *(F.coalesce(x, F.lit(0)).alias(x) for x in scores))


def word_scores(table: DataFrame, languages: int, head: int = HEAD) -> DataFrame:
    """(term, n, words, s0, s1, ...): for each distinct word how much less likely it is in each language than in the likeliest, in
    thousandths of a natural logarithm; words is 1."""
    cols, logs = [f"c{i}" for i in range(languages)], [f"l{i}" for i in range(languages)]
    known = F.greatest(*(F.col(c) for c in cols), F.lit(0)) > 0
    sums = table.agg(F.count_if(known).alias("v"), *(F.sum(c).alias(c) for c in cols)).first()
    own = [F.log((F.col(c) + SMOOTH_WORD) / F.lit(float((sums[c] or 0) + SMOOTH_WORD * (sums["v"] + 1)))).alias(x) for c, x in zip(cols, logs, strict=True)]
    seen = table.filter(known).select("term", "n", *own)
    unseen = table.filter(~known).select("term", "n", F.concat(F.lit("^"), "term", F.lit("$")).alias("text"))
    grams = durable(gram_scores(table, languages))
    windows = durable(window_scores(unseen, grams, languages))
    forget(grams)

    def places() -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
        return (lambda word: [word[i : i + NGRAM] for i in range(len(word))]), (lambda window: [window])

    summed = document_sums(unseen, ["term", "n"], windows, ["found", *logs], places, head)
    mean = [(F.col(x) / F.greatest("found", F.lit(1)) / UNIT).alias(x) for x in logs]
    both = seen.unionByName(summed.select("term", "n", *mean))
    best = F.greatest(*(F.col(x) for x in logs)) if languages > 1 else F.col("l0")
    less = [F.round((best - F.col(x)) * UNIT).cast("int").alias(f"s{i}") for i, x in enumerate(logs)]
    return both.select("term", "n", F.lit(1).alias("words"), *less)


def identify_languages(docs: DataFrame, modulus: int = 5, held_out: int = 0, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of `docs` (doc_id, text, lang)."""
    number = fold(F.col("doc_id"), modulus)
    train = F.col("lang").isNotNull() & (number != held_out)
    languages = sorted(r[0] for r in docs.filter(train).select("lang").distinct().collect())
    out = (number == held_out).alias("held_out")
    if not languages:
        return docs.select("doc_id", out, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    cls = F.coalesce(*(F.when(train & (F.col("lang") == x), i) for i, x in enumerate(languages)))
    table = durable(corpus_terms(docs.select("text", cls.alias("cls")), words, len(languages)))
    values = durable(word_scores(table, len(languages), head))
    forget(table)
    names = ["words", *(f"s{i}" for i in range(len(languages)))]
    sums = document_sums(docs.select("doc_id", "text"), ["doc_id"], values, names, words, head)
    losses = [F.col(x) for x in names[1:]]
    best = F.least(*losses) if len(losses) > 1 else losses[0]
    first = F.coalesce(*(F.when(x == best, F.lit(name)) for x, name in zip(losses, languages, strict=True)))
    rest = sum((F.exp((best - x) / (UNIT * F.col("words"))) for x in losses), F.lit(0.0))
    blank = F.col("words") == 0
    return sums.select("doc_id", out, F.when(blank, "und").otherwise(first).alias("lang_pred"), F.when(blank, 0.0).otherwise(1 / rest).alias("score"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
