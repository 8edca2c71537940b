"""Periodic runs of words: maximal stretches in which words one period apart are identical, and texts without their repeats.

A run has a smallest period q, at least `least` words and at least `times` periods, and no neighbouring word extends it. Any such run holds, for a
multiple i of (times - 1) * q, both i and i + q, so those points (a harmonic grid over all periods: n ln n / (times - 1) points in all) find it: where
the words at i and i + q are equal, the longest common extensions to both sides are searched in halving steps on prefix hashes, for
all pairs of a block of periods at once. The stretches found are deduplicated by their ends, where the smallest period counts (a longer period of one
stretch is a multiple of it), and verified word by word; where hashes have misled, the stretch is read anew from the words.

Batches of texts are worked on together, with numbers that no word has between them. Memory follows the longest text. Nothing is shuffled.

Defined results: a null text has no words, no runs and an empty collapsed text; rows that repeat and null ids each keep their row; other
columns of `docs` are passed through, columns named like added ones (runs, collapsed) are replaced; an empty table stays empty."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import pieces, plain_names, tokens_of

LEAST, TIMES = 6, 4
#: Pairs (period, grid point) in one numpy step; a batch's characters, which is what one step works on together.
PAIRS, TOGETHER = 1 << 20, 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Numbers of the words of several texts in a row, with prefix hashes (sums of random numbers of the words times powers of `base`, modulo 2^64)."""

    def __init__(self, ids: np.ndarray, base: np.uint64 = _BASE) -> None:
        self.ids, n = ids, len(ids)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum((mixed ^ (mixed >> np.uint64(32))) * self.power[:n], dtype=np.uint64)]

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches at i and at j > i have equal hashes."""
        return (self.sums[i + length] - self.sums[i]) * self.power[j - i] == self.sums[j + length] - self.sums[j]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on are those from j on."""
        room, length = len(self.ids) - j, np.zeros(len(i), np.int64)
        for k in reversed(range(int(room.max(initial=0)).bit_length())):
            tried = length + (1 << k)
            fits = np.flatnonzero(tried <= room)
            fits = fits[self.same(i[fits], j[fits], tried[fits])]
            length[fits] = tried[fits]
        return length

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i are those before j."""
        length = np.zeros(len(i), np.int64)
        for k in reversed(range(int(i.max(initial=0)).bit_length())):
            tried = length + (1 << k)
            fits = np.flatnonzero(tried <= i)
            fits = fits[self.same(i[fits] - tried[fits], j[fits] - tried[fits], tried[fits])]
            length[fits] = tried[fits]
        return length

    def holds(self, start: int, end: int, period: int) -> bool:
        """Whether the stretch has the period and no neighbour extends it, by its words."""
        ids = self.ids
        if not np.array_equal(ids[start : end - period], ids[start + period : end]):
            return False
        return (start == 0 or ids[start - 1] != ids[start - 1 + period]) and (end == len(ids) or ids[end] != ids[end - period])

    def read(self, i: int, period: int) -> tuple[int, int]:
        """The maximal stretch with the period that holds i and i + period, by its words."""
        broken = np.flatnonzero(self.ids[:-period] != self.ids[period:])
        at = int(np.searchsorted(broken, i))
        start = int(broken[at - 1]) + 1 if at else 0
        return start, int(broken[at]) + period if at < len(broken) else len(self.ids)


def _grid(n: int, longest: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(points, periods) of the harmonic grid over n words, in blocks of about PAIRS."""
    period = 1
    while period <= longest:
        upto, pairs = period, 0
        while upto <= longest and pairs < PAIRS:
            pairs += max(0, n - upto - 1) // ((times - 1) * upto) + 1
            upto += 1
        p = np.arange(period, upto)
        step = (times - 1) * p
        many = np.maximum(n - p - 1, -1) // step + 1
        each = np.repeat(p, many)
        yield (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * (times - 1) * each, each
        period = upto


def find_runs(ids: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES, base: np.uint64 = _BASE) -> np.ndarray:
    """(start, end, period) of each run, by start, then period; `longest`: the longest period to look for."""
    if not len(ids) or longest < 1:
        return np.empty((0, 3), np.int64)
    words, found = Words(ids, base), []
    for i, p in _grid(len(ids), longest, times):
        equal = ids[i] == ids[i + p]
        i, p = i[equal], p[equal]
        start, end = i - words.behind(i, i + p), i + p + words.ahead(i, i + p)
        long_ = end - start >= np.maximum(least, times * p)
        found.append(np.stack([start, end, p, i], axis=1)[long_])
    all_ = np.concatenate(found)
    all_ = all_[np.lexsort((all_[:, 2], all_[:, 1], all_[:, 0]))]
    first = np.flatnonzero(np.r_[True, (all_[1:, :2] != all_[:-1, :2]).any(axis=1)]) if len(all_) else np.empty(0, np.int64)
    out: dict[tuple[int, int], int] = {}
    for a, b in zip(first.tolist(), np.r_[first[1:], len(all_)].tolist()):
        start, end, period, _ = all_[a].tolist()
        rows, misled = [], all_[a:b, 2:]
        if words.holds(start, end, period):  # then its multiples hold, too
            rows, misled = [(start, end, period)], misled[misled[:, 0] % period > 0]
        for s, e, p in rows + [(*words.read(i, p), p) for p, i in misled.tolist()]:  # where hashes misled, the words are read
            if e - s >= max(least, times * p):
                out[s, e] = min(p, out.get((s, e), p))
    return np.array(sorted((s, e, p) for (s, e), p in out.items()), np.int64).reshape(-1, 3)


def _by_text(texts: list[str | None], least: int, times: int, base: np.uint64 = _BASE) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """For each text its words, and its runs (start, length, period)."""
    split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    number: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(x) for x in split], np.int64)
    starts = np.cumsum(np.r_[0, sizes + 1])[:-1]
    ids = np.empty(int(sizes.sum()) + len(split), np.int64)
    for words, s in zip(split, starts.tolist(), strict=True):
        ids[s : s + len(words)] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        ids[s + len(words)] = -1 - s  # between texts: met once
    runs = find_runs(ids, int(sizes.max(initial=0)) // times, least, times, base)
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(split) + 1))
    for k, words in enumerate(split):
        own = runs[bounds[k] : bounds[k + 1]]
        own = np.stack([own[:, 0] - starts[k], own[:, 1] - own[:, 0], own[:, 2]], axis=1)
        yield words, own[np.lexsort((own[:, 2], own[:, 0]))]


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(marks)[:-1] == 0).tolist()])


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The rows of `docs` with the added columns runs (start, length and period in words, by start, then period) and collapsed (the text's
    words, joined by blanks, without those that a run only repeats)."""
    source, keep, back = plain_names(docs, ["runs", "collapsed"])
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in source.schema), f"runs {RUNS}", "collapsed string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", TOGETHER):
                runs, collapsed = [], []
                for words, own in _by_text(part.column("text").to_pylist(), least, times):
                    runs.append(own)
                    collapsed.append(_collapsed(words, own))
                flat = np.concatenate([np.empty((0, 3), np.int64), *runs])
                each = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), each)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=[*keep, "runs", "collapsed"])

    return back(source.mapInArrow(run, schema))


def strongest(runs: Column) -> Column:
    """Of an array of runs that with the greatest length / period, exactly; the first of equals. Null if there is none."""
    better = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def _planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document (by h, the crc32 of its id) says some of its words over and over: from word a on, word i is word a + (i - a) % p,
    with g = floor(h / 10), a = g % n, p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", h.alias("h"), F.when((h % 10 == 0) & F.col("text").isNotNull(), tokens_of(F.col("text"))).alias("w"))
    shaped = split.withColumn("n", F.size("w").cast("long")).withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    shaped = shaped.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get(F.col("w"), (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    return shaped.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
