"""Benchmark decontamination with one Aho-Corasick automaton over the windows of all test items.

The automaton's symbols are words, normalised as the documents' are, so a document is scanned once, word by word, and a match's
end is a word number; word numbers map to character offsets of the original text. The automaton's windows are broadcast, and nothing is
shuffled. A benchmark of more than BLOCK_WORDS words is dealt into blocks of that size, one after the other: each has its own automaton and its
own pass over the texts, whose findings (of texts that are hit, by their MD5) are written before the next one begins, so that a worker
and the driver never hold more than one block; at last the findings of all blocks meet the documents in one join.

Defined results: a null or empty text has no words and isn't contaminated; repeated rows are judged row by row; items
without words are skipped, items that repeat count once by id, a null item id counts as the id ''; with no items nothing is hit;
other columns of `docs` are passed through, one named like an added column is replaced."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import WORD, durable, pieces, plain_names

WINDOW = 13
#: Item words in one automaton: about 2.6 million nodes, some 150 MB in a worker.
BLOCK_WORDS = 200_000
ADDED = ["n_words", "n_hit", "items", "spans"]
#: Where words stand in the original text; letters of either case are words' letters there.
_PLACES = re.compile(WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))
#: Of UTF-8: A-Z in lower case, every other ASCII byte outside of words as a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: The automaton that this worker process built last, by its broadcast's number.
_BUILT: dict[int, tuple] = {}


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_BYTES).split() if text else []


def _automaton(number: int, items: list[tuple[str, list[bytes]]], window: int) -> tuple:
    if number not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, own in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in own]
            for i in range(max(1, len(ids) - window + 1)):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, by in found.items():
            machine.add_word(key, (len(key), by))
        machine.make_automaton()
        _BUILT[number] = machine, vocabulary
    return _BUILT[number]


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted intervals [a, b) without overlaps; those that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as (id, words), in blocks of about BLOCK_WORDS words; the driver holds one block at a time."""
    block, total = [], 0
    for item, text in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        if own := words(text):
            block.append((item, own))
            total += len(own)
        if total >= BLOCK_WORDS:
            yield block
            block, total = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` with added columns: n_words and n_hit (words inside any occurrence of a window), items (ids
    with an occurring window, sorted as strings), spans (character offsets [start, end) of hit stretches in the original text)."""
    source, keep, back = plain_names(docs, ADDED)
    plain = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema]
    added = {"n_words": "long", "n_hit": "long", "items": "array<string>", "spans": "array<struct<start:int,end:int>>"}
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    found = {"_from": pa.list_(pa.int32()), "_to": pa.list_(pa.int32()), "_items": pa.list_(pa.string())}

    def hits_of(block, number: int):
        """From a text's words to its hit intervals and items, by one block's automaton."""
        machine, vocabulary = _automaton(number, block, window) if block else (None, {})
        known = vocabulary.get

        def hits(own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
            at, names = [], set()
            symbols = tuple([known(w, 0) for w in own]) if machine else ()
            if any(symbols):
                for end, (n, by) in machine.iter(symbols):
                    at.append((end - n + 1, end + 1))
                    names |= by
            return at, names

        return hits

    def row(text: str | None, own: list[bytes], hits: list[tuple[int, int]], names: set[str]) -> tuple:
        hits = _merged(hits)
        at = [m.span() for m in _PLACES.finditer(text)] if hits else []
        return len(own), sum(y - x for x, y in hits), sorted(names), [{"start": at[x][0], "end": at[y - 1][1]} for x, y in hits]

    def table(part: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=[*keep, *added])

    context, blocks, schema = docs.sparkSession.sparkContext, _blocks(items), ", ".join([*plain, *(f"{c} {kind}" for c, kind in added.items())])
    block, more = next(blocks, []), next(blocks, None)
    if more is None:  # one pass says all
        held, number = context.broadcast(block), uuid.uuid4().int

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits = hits_of(held.value, number)
            for batch in batches:
                for part in pieces(batch, "text"):
                    rows = []
                    for text in part.column("text").to_pylist():
                        own = words(text)
                        rows.append(row(text, own, *hits(own)))
                    yield table(part, rows)

        return back(source.mapInArrow(scan, schema))

    def finder(held, number: int):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits = hits_of(held.value, number)
            for batch in batches:
                for part in pieces(batch, "text"):
                    rows = [(k, *hits(words(text))) for k, text in enumerate(part.column("text").to_pylist())]
                    rows = [(k, at, names) for k, at, names in rows if at]
                    columns = [part.column("_key").take(pa.array([k for k, *_ in rows], pa.int64())), *(pa.array([[x[i] for x in at] for _, at, _ in rows], pa.list_(pa.int32())) for i in (0, 1)), pa.array([sorted(names) for *_, names in rows], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["_key", *found])

        return find

    keyed, parts = source.select(F.unhex(F.md5("text")).alias("_key"), "text").filter("text IS NOT NULL"), []
    for own in chain([block, more], blocks):
        held = context.broadcast(own)
        rows = keyed.mapInArrow(finder(held, uuid.uuid4().int), "_key binary, _from array<int>, _to array<int>, _items array<string>")
        parts.append(durable(rows.dropDuplicates(["_key"])))  # copies of a text have the same findings
        held.destroy()
    together = reduce(DataFrame.unionByName, parts).groupBy("_key").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in found))
    met = source.withColumn("_md5", F.unhex(F.md5("text"))).join(together, F.col("_md5") == F.col("_key"), "left").select(*source.columns, *found)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = [row(t, words(t), list(zip(a or (), b or (), strict=True)), set(i or ())) for t, a, b, i in zip(*(part.column(c).to_pylist() for c in ("text", *found)), strict=True)]
                yield table(part, rows)

    return back(met.mapInArrow(gather, schema))


def contaminated(n_hit, n_words):
    """The contamination rule: at least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


ORACLE_OP9 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (
  SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
m AS (SELECT p.rid, p.i, p.k, win.item_id FROM p JOIN win ON p.g = win.g AND p.k = win.k),
h AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
