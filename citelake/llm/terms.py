"""Sums over a document's terms of a value that is worked out once per distinct term.

Both users (token counts, language identification) have the same shape: count the terms of the whole corpus, work
out a value for each distinct term once, and give every document the sum over its terms. The most frequent terms,
at most `head` of them, stand in nearly every document; their values are broadcast and summed where the document is read (terms longer than
HEAD_CHARS by their MD5, so that the broadcast is bounded). All other terms meet their values in a shuffle join, which no hot term can skew
because the hot ones never enter it.

Rows are told apart by numbers that a task gives them in their order, so `docs` must give the same rows in the same order if a task
runs again: files do, and results of shuffles once they are written."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pieces, row_ids

#: The broadcast part's bound: entries, and characters of each.
HEAD, HEAD_CHARS = 65_536, 64
#: A task hands on its counts when it holds FLUSH distinct runs, and forgets what it knew about SEEN of them.
FLUSH, SEEN = 250_000, 120_000
#: Made once per task: (from a text to its runs of characters without white space, from a run to its terms, repeats included).
Cutter = Callable[[], tuple[Callable[[str], list[str]], Callable[[str], list[str]]]]


def corpus_terms(docs: DataFrame, cutter: Cutter, classes: int = 0) -> DataFrame:
    """(term, n): how often each term stands in all texts; a null text has none. `docs` has the column text.

    With classes, `docs` also has the column cls, and c0, c1, ... are the counts in texts of the classes 0, 1, ...; texts of other
    classes, or of none, only count in n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (prepare, cut), held = cutter(), {}

        def out() -> Iterator[pa.RecordBatch]:
            for cls, words in held.items():
                terms: Counter = Counter()
                for word, n in words.items():
                    for x in cut(word):
                        terms[x] += n
                yield pa.RecordBatch.from_arrays([pa.array(terms.keys(), pa.string()), pa.array([cls] * len(terms), pa.int32()), pa.array(terms.values(), pa.int64())], names=["term", "cls", "n"])
            held.clear()

        for batch in batches:
            for part in pieces(batch, "text"):
                own = part.column("cls").to_pylist() if classes else [-1] * part.num_rows
                for text, cls in zip(part.column("text").to_pylist(), own, strict=True):
                    if text:
                        held.setdefault(-1 if cls is None else cls, Counter()).update(prepare(text))
                if sum(map(len, held.values())) >= FLUSH:
                    yield from out()
        yield from out()

    counted = docs.select("text", *(["cls"] if classes else [])).mapInArrow(run, "term string, cls int, n long")
    by_class = [F.sum(F.when(F.col("cls") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(classes)]
    return counted.groupBy("term").agg(F.sum("n").alias("n"), *by_class)


def short(term: str) -> str:
    """A long term's stand-in; it begins with a blank, which no term does."""
    return term if len(term) <= HEAD_CHARS else f" {md5(term.encode('utf-8', 'surrogatepass')).hexdigest()}"


def head_of(values: DataFrame, names: list[str], head: int = HEAD) -> tuple[list[str], np.ndarray]:
    """The most frequent terms (see short), at most `head` of them, and their values as an array of as many rows."""
    term = F.when(F.length("term") <= HEAD_CHARS, F.col("term")).otherwise(F.concat(F.lit(" "), F.md5("term")))
    rows = values.orderBy(F.desc("n"), "term").limit(head).select(term, *names).collect()
    return [r[0] for r in rows], np.array([r[1:] for r in rows], dtype=np.int64).reshape(len(rows), len(names))


def document_sums(docs: DataFrame, keep: list[str], values: DataFrame, names: list[str], cutter: Cutter, head: int = HEAD) -> DataFrame:
    """A row for each row of `docs`: its columns `keep`, and for each of `names` the sum (a long) of that value over its terms.

    values: (term, n, *names), a written table, with each distinct term once; the values are whole numbers, so that sums don't depend
    on their order, and small ones, so that they take little room in shuffles. Rows of `docs` may repeat and may
    hold nulls; a null text has no terms and sums of 0."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(head_of(values, names, head))
    own = [f"k{i}" for i in range(len(keep))]  # names that meet none on the way
    docs = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, own, strict=True)), "text")
    width = len(names)
    # A document's own row carries its columns and the head's sums; its key is a blank and its number, which is no term.
    sums = [f"s{i}" for i in range(width)]
    out = ", ".join(["rid long", "term string", "n long", *(f"{s} long" for s in sums), *(f"{k} {docs.schema[k].dataType.simpleString()}" for k in own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (prepare, cut), ids = cutter(), row_ids()
        head = {x: k for k, x in enumerate(held.value[0])}
        table = np.concatenate([held.value[1], np.zeros((1, width), np.int64)])
        # Of runs that were met: their numbers, each one's sums over its terms in the head, and the other terms of those that have some.
        number: dict[str, int] = {}
        totals, rests = np.zeros((0, width), np.int64), {}

        def meet(words: list[str]) -> None:
            nonlocal totals
            places, starts = [], []
            for word in words:
                starts.append(len(places))
                rest = []
                for x in cut(word):
                    if (k := head.get(short(x))) is None:
                        rest.append(x)
                    else:
                        places.append(k)
                places.append(len(table) - 1)  # no run is without a place
                if rest:
                    rests[len(number)] = rest
                number[word] = len(number)
            if words:
                totals = np.concatenate([totals, np.add.reduceat(table[places], starts, axis=0)])

        for batch in batches:
            for part in pieces(batch, "text"):
                if len(number) >= SEEN:
                    number, totals, rests = {}, totals[:0], {}
                counted = [Counter(prepare(text)) if text else {} for text in part.column("text").to_pylist()]
                meet([*dict.fromkeys(x for c in counted for x in c.keys() - number.keys())])
                runs = np.fromiter((number[x] for c in counted for x in c), np.int64)
                n = np.fromiter((x for c in counted for x in c.values()), np.int64, len(runs))
                ends = np.cumsum([0, *map(len, counted)])
                sums_ = np.zeros((len(counted), width), np.int64)
                filled = np.flatnonzero(ends[1:] > ends[:-1])
                if len(filled):
                    sums_[filled] = np.add.reduceat(totals[runs] * n[:, None], ends[:-1][filled], axis=0)
                has_rest = np.zeros(len(number), bool)
                has_rest[list(rests)] = True
                at = np.flatnonzero(has_rest[runs])
                tails = [rests[r] for r in runs[at].tolist()]
                many = np.fromiter(map(len, tails), np.int64, len(tails))
                rids = np.fromiter((next(ids) for _ in counted), np.int64, len(counted))
                rid = np.concatenate([np.repeat(rids[np.searchsorted(ends, at, side="right") - 1], many), rids])
                m = len(rid) - len(rids)
                term = [x for t in tails for x in t] + [f" {r}" for r in rids.tolist()]
                empty = np.r_[np.ones(m, bool), np.zeros(len(rids), bool)]
                take = pa.array(np.r_[np.zeros(m, np.int64), np.arange(len(rids))], mask=empty)
                values_ = [pa.array(np.r_[np.zeros(m, np.int64), sums_[:, i]], mask=empty) for i in range(width)]
                columns = [pa.array(rid), pa.array(term, pa.string()), pa.array(np.r_[np.repeat(n[at], many), np.zeros(len(rids), np.int64)]), *values_, *(part.column(k).take(take) for k in own)]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "term", "n", *sums, *own])
                if len(number) >= 4 * SEEN:
                    number, totals, rests = {}, totals[:0], {}

    rows = docs.mapInArrow(run, out)
    right = values.select(F.col("term").alias("_t"), *(F.col(x).cast("long").alias(f"_v{i}") for i, x in enumerate(names)))
    joined = rows.join(right, F.col("term") == F.col("_t"), "left")
    added = [F.sum(F.coalesce(F.col(s), F.col("n") * F.col(f"_v{i}"))).alias(names[i]) for i, s in enumerate(sums)]
    return joined.groupBy("rid").agg(*(F.max(k).alias(c) for c, k in zip(keep, own, strict=True)), *added).select(*keep, *names)
