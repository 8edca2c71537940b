"""SimHash near-duplicates by exact, tiled comparison of fingerprints.

Fingerprints that differ in at most `radius` bits have, in each 16-bit quarter, population counts whose differences
sum to at most `radius`. Distinct fingerprints are dealt into tiles by their four counts (17^4 tiles at most), and a tile is
compared with itself and the tiles ahead of it within the radius, with numpy exclusive-or and bit counts; all other pairs of tiles are
skipped. A tile and its neighbours are cut by a hash into blocks of about BLOCK fingerprints a side, so that no
task ever holds more than one pair of blocks, however many fingerprints share their counts. A pair of blocks gives
back a forest of its links, never all pairs. Equal texts have equal fingerprints and are one row here however often they stand.

Pipelines take the groups of linked_texts; near_dedup adds pairs of texts with similar sets of five-word shingles whose fingerprints are further apart.

Defined results: a text without words (null, empty, blank) has fingerprint zero and links like any other; rows that
repeat, ids that repeat and null ids each keep their own row; a component's id is its smallest non-null doc_id, null
if there is none; other columns don't matter."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import durable, pieces
from .components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints on each side of a pair of blocks (a task holds one such pair, some 8 MB), and pairs in one numpy comparison. Each
#: fingerprint is sent to as many pairs as its tile and those ahead hold blocks, so large blocks mean few copies.
BLOCK, PAIRS = 65_536, 2_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority of the bits of all shingles' XXH64, as a signed 64-bit number."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    if shingle == 3 and len(words) >= 3:
        hashes = [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) for each row; text_hash tells apart rows with one doc_id."""
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                fp = pa.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), fp], names=["doc_id", "text_hash", "fp"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


@dataclass(frozen=True)
class Tiling:
    """How fingerprints are dealt into numbered tiles, and which steps lead from a tile to those that may hold links.

    digits: the number of each digit's values; a tile's number is read from its digits. steps: from a tile to itself and to half of the
    tiles that aren't skipped, so that each pair of tiles comes once."""

    digits: tuple[int, ...]
    steps: tuple[tuple[int, ...], ...]

    @property
    def tiles(self) -> int:
        return math.prod(self.digits)

    def weights(self) -> np.ndarray:
        return np.array([math.prod(self.digits[k + 1 :]) for k in range(len(self.digits))])

    def split(self, tiles: np.ndarray) -> np.ndarray:
        return tiles[:, None] // self.weights() % np.array(self.digits)

    def step(self, digits: np.ndarray, d: tuple[int, ...], sign: int) -> tuple[np.ndarray, np.ndarray]:
        """Which tiles have a tile at that step, and its number."""
        moved = digits + sign * np.array(d)
        return ((moved >= 0) & (moved < np.array(self.digits))).all(axis=1), moved @ self.weights()


def by_counts(radius: int) -> Tiling:
    """Tiles by the population counts of a fingerprint's 16-bit quarters."""
    near = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return Tiling((17,) * 4, tuple(d for d in near if d >= (0, 0, 0, 0)))


def _links(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links given by node: each node of a component but the least, and the least; a forest with the same components."""
    names, ends = np.unique(np.concatenate([nodes[left], nodes[right]]), return_inverse=True)
    x, y = ends[: len(left)], ends[len(left) :]
    root = np.arange(len(names))
    while True:
        before = root.copy()
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        root = root[root]
        if (root == before).all():
            break
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def tiled_links(items: DataFrame, tiling: Tiling, near: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], block: int = BLOCK) -> DataFrame:
    """(a, b): a forest of all links among `items` (node, tile, and any number of long columns).

    near: from two blocks of the long columns to the rows of each that link. A tile and what lies ahead of it are cut by a hash of
    the node into blocks of about `block` rows. The driver receives the number of rows of each tile: `tiling.tiles` numbers at most."""
    payload = [c for c in items.columns if c not in ("node", "tile")]
    count = np.zeros(tiling.tiles, dtype=np.int64)
    for r in items.groupBy("tile").count().collect():
        count[r["tile"]] = r["count"]
    digits, ahead = tiling.split(np.arange(tiling.tiles)), np.zeros_like(count)
    for d in tiling.steps:
        inside, to = tiling.step(digits, d, 1)
        ahead[inside] += count[to[inside]]
    plan = items.sparkSession.sparkContext.broadcast((np.maximum(1, -(-count // block)), np.maximum(1, -(-ahead // block)), count > 0))
    names = ["pair", "is_left", "node", *payload]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts, rights, used = plan.value
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tile", "node", *payload)]
            for at in range(0, batch.num_rows, 20_000):
                tiles, *own = (c[at : at + 20_000] for c in columns)
                mixed = (own[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                out = []

                def emit(rows: np.ndarray, to: np.ndarray, side: bool) -> None:
                    """A left goes to its own part of the tile and all parts of the right side, and the other way round."""
                    many, one = (rights, lefts) if side else (lefts, rights)
                    times = many[to]
                    which = np.repeat(np.arange(len(rows)), times)
                    part = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                    mine = (mixed[rows] % one[to].astype(np.uint64)).astype(np.int64)[which]
                    i, j = (mine, part) if side else (part, mine)
                    out.append((to[which] << 44 | i << 22 | j, np.full(len(which), side), rows[which]))

                everyone = np.arange(len(tiles))
                emit(everyone, tiles, True)
                own_digits = tiling.split(tiles)
                for d in tiling.steps:
                    inside, to = tiling.step(own_digits, d, -1)
                    rows = everyone[inside][used[to[inside]]]
                    emit(rows, to[inside][used[to[inside]]], False)
                pair, side, rows = (np.concatenate(x) for x in zip(*out, strict=True))
                for k in range(0, len(pair), 100_000):
                    part = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[part]), pa.array(side[part]), *(pa.array(c[rows[part]]) for c in own)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in with_end(batches):
            last = batch is None
            if not last:
                new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
                rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            pair, is_left, node, *own = rest
            values = np.stack(own, axis=1)
            starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            ends = np.r_[starts[1:], len(pair)]
            done = len(starts) if last else len(starts) - 1
            a, b = [], []
            for s, e in zip(starts[:done].tolist(), ends[:done].tolist(), strict=True):
                left, right = np.flatnonzero(is_left[s:e]) + s, np.flatnonzero(~is_left[s:e]) + s
                if not len(left) or not len(right):
                    continue
                rows = max(1, PAIRS // len(right))
                found = [(i, *near(values[left[i : i + rows]], values[right])) for i in range(0, len(left), rows)]
                x = np.concatenate([left[i + f] for i, f, _ in found])
                y = np.concatenate([right[f] for _, _, f in found])
                differ = node[x] != node[y]
                if differ.any():
                    p, q = _links(node, x[differ], y[differ])
                    a.append(p), b.append(q)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])
            cut = ends[done - 1] if done else 0
            rest = [x[cut:] for x in rest]

    dealt = items.mapInArrow(deal, ", ".join(["pair long", "is_left boolean", "node long", *(f"{c} long" for c in payload)]))
    return dealt.repartition("pair").sortWithinPartitions("pair").mapInArrow(compare, "a long, b long")


def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): a forest of the links within the radius among the distinct fingerprints of `distinct` (fp)."""
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(65535))) for k in range(4)]
    tile = sum((q * 17 ** (3 - k) for k, q in enumerate(quarters)), F.lit(0))

    def near(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = left[:, 0].astype(np.uint64), right[:, 0].astype(np.uint64)  # of signed numbers numpy counts the magnitude's bits
        return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)

    return tiled_links(distinct.select(F.col("fp").alias("node"), tile.alias("tile"), "fp"), by_counts(radius), near, block)


def components_of(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """distinct: (node, first), first being the first row of that node; gives (_node, first) with the first row of the component."""
    member = distinct.join(components(found).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    linked = durable(member.select("node", "first", F.coalesce("root", "node").alias("root")))
    least = linked.groupBy("root").agg(F.min("first").alias("least")).select(F.col("root").alias("_root"), "least")
    return linked.join(least, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), F.col("least").alias("first"))


def first_row():
    """Orders the rows of a group: rows with an id come first, by id, then by the hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of `docs`; component_id is the smallest doc_id reachable."""
    rows = durable(fingerprints(docs, shingle))
    distinct = durable(rows.groupBy("fp").agg(F.min(first_row()).alias("first")))
    groups = components_of(distinct.withColumnRenamed("fp", "node"), links(distinct, radius))
    return rows.join(groups, F.col("fp") == F.col("_node")).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def linked_texts(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(text_hash, group): the texts of `docs` (doc_id, text) in groups of those whose fingerprints link, directly or by others."""
    rows = durable(fingerprints(docs, shingle).select("text_hash", "fp").distinct())
    roots = components(links(durable(rows.select("fp").distinct()), radius))
    return rows.join(roots, F.col("fp") == F.col("node"), "left").select("text_hash", F.coalesce("root", "fp").alias("group"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
