"""Near-duplicates for pipelines: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of SIMILARITY or more.

Candidates come from a prefix filter, which loses no pair: put all shingles in one order, whatever it is; two sets so similar share one
among the first n - ceil(SIMILARITY n) + 1 of each. Shingles of seldom met hash cells come first here, so few unrelated texts meet.
The texts that share such a shingle are a list. Only connections matter, so each list is first compared as a star around its least node.
A list that those links don't tie together is open, and its other pairs are compared, too.

Before any set of shingles is moved, sketches are compared by exclusive-or and bit counts: every shingle of a set turns over one bit of
its sketch, so two sketches differ in no more bits than their sets in shingles, and a pair whose sketches differ by more than similar sets may
(the radius) is none; that loses no pair. Pairs whose population counts differ by more aren't compared at all. What is left of an open list is a
forest, never all its pairs. The trees' sets of shingles meet in one task, in blocks of bounded size if they are many, which
compares what isn't connected yet (within exact bounds by sizes and by counts in BUCKETS hash buckets) and gives back a forest of links. Every link
is confirmed by the two whole sets of shingles, as 64-bit hashes.

A shingle that very many texts may have among their first ones (by the counts of its cell) is dealt to several tasks by the texts' nodes:
each makes a star of its part of the list, the parts' least nodes are a star again, and the parts together are the list that may be open.

Data: a text's prefix and its sketch (about as many bits as shingles, at most WIDEST) are shuffled, a sketch once more for each open list, and the whole set only
of texts whose sketches are near; of texts themselves, only those of copies are. Leaders of many pairs are salted, and large lists and clusters are
cut into pairs of blocks. A cluster whose texts stay apart within their bounds costs the square of its size in time.

Defined results: a null text and all others without words are one group; the row with the smallest doc_id stays, ids before nulls (of several
with that id the one with the smallest text hash; of equal rows, one); other columns are passed through; empty tables stay empty."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import durable, forget, packed, pieces
from .components import components
from .simhash import components_of, first_row, with_end

SHINGLE, SIMILARITY = 5, 0.8
#: Cells by which frequencies are estimated and rows preselected (a power of two; broadcasts hold at most so many numbers), and cells in a row.
CELLS, CHUNK = 1 << 20, 1 << 12
#: Buckets of the counts that bound what two sets share; above MOST shingles these say nothing and aren't used.
BUCKETS, MOST = 64, 1 << 20
#: Bits of a sketch, at most and at least (powers of two).
WIDEST, LEAST_BITS = 1 << 13, 64
#: Pairs of one leader in a salted part, and texts that a task remembers.
PART, SEEN = 1000, 200_000
#: Sketches in a block of an open list, and shingles in a block of a cluster (on each side of a task; at most 16 MB).
TILE, BLOCK = 1 << 14, 2_000_000
#: Texts in a part of a list, about.
LIST = 4096


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted XXH3 of a text's distinct five-word shingles (of all its words, if they are fewer), as signed numbers."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    digest, n = xxhash.xxh3_64_intdigest, SHINGLE
    joined = {b" ".join(x) for x in zip(*(words[k:] for k in range(n)), strict=False)} if len(words) >= n else {b" ".join(words)}
    return np.unique(np.fromiter((digest(x) for x in joined), np.uint64, len(joined)).view(np.int64))


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), 1) - (1 << 63)


def _cell(shingles: np.ndarray, cells: int) -> np.ndarray:
    return (shingles.view(np.uint64) & np.uint64(cells - 1)).astype(np.int64)


def sketch(shingles: np.ndarray) -> bytes:
    """The number of shingles, and bits each of which tells whether an odd number of shingles falls on it. Wider ones fold to narrower by halves."""
    n = len(shingles)
    bits = min(WIDEST, max(LEAST_BITS, 1 << max(n - 1, 0).bit_length()))
    place = (shingles.view(np.uint64) >> np.uint64(32)) & np.uint64(bits - 1)
    return np.int64(n).tobytes() + np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _halved(words: np.ndarray) -> np.ndarray:
    half = words.shape[-1] // 2
    return words[..., :half] ^ words[..., half:]


def _radius(shingles, least: float):
    """In how many shingles two similar sets can differ that have `shingles` together."""
    return shingles * (1 - least) / (1 + least) + 1e-6


def _counts(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each bucket."""
    return np.minimum(np.bincount((shingles.view(np.uint64) >> np.uint64(58)).astype(np.int64), minlength=BUCKETS), 65_535).astype(np.uint16).tobytes()


def _sums(parts: DataFrame) -> np.ndarray:
    """Of (chunk, counts): the vector of all chunks, each the sum of its rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(c, np.int32).astype(np.int64)
                total[k] = total[k] + own if k in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "counts"])

    rows = sorted(parts.repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect())
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows]) if rows else np.zeros(CELLS, np.int64)


def _cells(column: str):
    return F.col(column).bitwiseAND(F.lit(CELLS - 1))


def _only(docs: DataFrame, hashes: DataFrame, how: str) -> DataFrame:
    """The rows of `docs` (text_hash) whose hash falls into a cell of one of `hashes` (h), or into none (how: left_semi, left_anti)."""
    marked = durable(hashes.select(_cells("h").alias("_cell")).distinct())  # at most CELLS rows
    return docs.join(F.broadcast(marked), _cells("text_hash") == F.col("_cell"), how)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """Stretches of whole groups out of rows sorted by the first of `names`: the columns, and the groups' starts."""
    rest = None
    for batch in with_end(batches):
        if batch is not None:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
        if rest is None or not len(rest[0]):
            continue
        starts = np.flatnonzero(np.r_[True, rest[0][1:] != rest[0][:-1]])
        cut = len(rest[0]) if batch is None else int(starts[-1])
        if cut:
            yield *(c[:cut] for c in rest), starts[starts < cut]
        rest = [c[cut:] for c in rest]


def _can_be(size: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows x, y of one shingle can be similar, by their sizes and the shingle's places."""
    both = np.minimum(at[x], at[y]) + np.minimum(size[x] - at[x], size[y] - at[y])
    return both * (1 + least) >= least * (size[x] + size[y]) - 1e-6


def _stars(least: float):
    """From rows (shingle, node, place, whole, part): the pairs of each group's least node with the others, and, once for each list of three and more, its nodes and
    sizes. Where a group is a part of a list (part > 0), its nodes are given in any case, under the name of the whole list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for shingle, node, place, whole, part, starts in _groups(batches, ["shingle", "node", "place", "whole", "part"]):
            counts = np.diff(np.r_[starts, len(shingle)])
            size, at = place >> 32, place & 0xFFFFFFFF
            alone = part[starts] == 0
            s = starts[(counts == 2) & alone]
            fits = _can_be(size, at, s, s + 1, least) & (node[s] != node[s + 1])
            a, b = [np.minimum(node[s], node[s + 1])[fits]], [np.maximum(node[s], node[s + 1])[fits]]
            lists: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            wide = (counts > 2) | ~alone
            for s, n in zip(starts[wide].tolist(), counts[wide].tolist(), strict=True):
                own, first = np.unique(node[s : s + n], return_index=True)  # copies of one text are one row
                k = s + first
                if part[s]:
                    lists.append((int(whole[s]), int(part[s]), own, size[k]))
                if len(own) < 2:
                    continue
                others = k[1:][_can_be(size, at, np.broadcast_to(k[0], len(k) - 1), k[1:], least)]
                a.append(np.full(len(others), node[k[0]])), b.append(node[others])
                if not part[s] and len(own) > 2 and (key := xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)) not in known:
                    if len(known) >= SEEN:
                        known.clear()
                    known.add(key)
                    lists.append((key, 0, own, size[k]))
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            if len(pairs):
                none = pa.nulls(len(pairs), pa.int64())
                longs = pa.nulls(len(pairs), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none, longs, longs], names=["a", "b", "list", "part", "nodes", "sizes"])
            for i in range(0, len(lists), 1000):
                some = lists[i : i + 1000]
                none = pa.nulls(len(some), pa.int64())
                ends = [pa.array([x[j] for x in some], pa.int64()) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([none, none, *ends, *(pa.array([x[j] for x in some], pa.list_(pa.int64())) for j in (2, 3))], names=["a", "b", "list", "part", "nodes", "sizes"])

    return run


def forest(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], least: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join what is similar and not of one root yet: no more than it takes. side: compare only texts of different sides."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    nodes, roots, sets = nodes[order], roots[order], [sets[i] for i in order]
    side = None if side is None else side[order]
    n = np.array([len(x) for x in sets])
    names, root = np.unique(roots, return_inverse=True)
    if len(names) == 1:
        return []
    counts = np.stack([np.frombuffer(_counts(x), np.uint16) for x in sets]).astype(np.int64)
    # The places of each shingle that several texts hold.
    owner, flat = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
    values, number, many = np.unique(flat, return_inverse=True, return_counts=True)
    by = np.argsort(number, kind="stable")
    holders, first = owner[by], np.cumsum(np.r_[0, many])
    ends = np.cumsum(n)
    upto = np.searchsorted(n, n / least + 1e-6, side="right")  # a longer set can't be similar
    out = []
    for i in range(len(sets)):
        y = np.arange(i + 1, upto[i])
        y = y[root[y] != root[i]]
        if side is not None:
            y = y[side[y] != side[i]]
        bound = np.minimum(np.minimum(counts[i], counts[y]).sum(axis=1), n[i])
        y = y[(bound * (1 + least) >= least * (n[i] + n[y]) - 1e-6) | (n[y] > MOST)]
        if not len(y):
            continue
        own = number[ends[i] - n[i] : ends[i]]
        own = own[many[own] > 1]
        shared = np.zeros(len(sets), np.int64)
        for k in range(0, len(own), 4096):  # postings, some at a time
            part = own[k : k + 4096]
            lengths = many[part]
            at = np.repeat(first[part] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
            shared += np.bincount(holders[at], minlength=len(sets))
        for j in y[shared[y] >= least * (n[i] + n[y] - shared[y]) - 1e-9].tolist():
            if root[i] != root[j]:
                out.append((min(int(nodes[i]), int(nodes[j])), max(int(nodes[i]), int(nodes[j]))))
                root[root == root[j]] = root[i]
    return out


def likely(nodes: np.ndarray, roots: np.ndarray, sketches: list[np.ndarray], least: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of the pairs, not of one root, whose sketches don't rule out that they are similar. side: compare only texts of different sides."""
    n = np.array([x[0] for x in sketches]).astype(np.int64)
    order = np.argsort(n, kind="stable")
    n, nodes, roots, words = n[order], nodes[order], roots[order], [sketches[i][1:] for i in order]
    side = None if side is None else side[order]
    if (roots == roots[0]).all():
        return []
    # The widths grow with the sizes, and sets so similar are at most one step apart.
    width = np.array([len(x) for x in words])
    full = {int(w): (int(np.searchsorted(width, w)), np.stack([words[i] for i in np.flatnonzero(width == w)])) for w in np.unique(width)}
    views = {(w, w): (first, rows, np.bitwise_count(rows).sum(axis=1, dtype=np.int64)) for w, (first, rows) in full.items()}
    for w, (first, rows) in full.items():
        half = _halved(rows)
        views[w // 2, w] = first, half, np.bitwise_count(half).sum(axis=1, dtype=np.int64)
    upto = np.searchsorted(n, n / least + 1e-6, side="right")
    tree, out = np.arange(len(n)), []
    for i in range(len(n)):
        w = int(width[i])
        start, mine, pops = views[w, w]
        own, count = mine[i - start], pops[i - start]
        for k in (w, 2 * w):
            if (w, k) not in views:
                continue
            start, rows, pops = views[w, k]
            y = np.arange(max(i + 1, start), min(int(upto[i]), start + len(rows)))
            y = y[(roots[y] != roots[i]) & (tree[y] != tree[i])]
            if side is not None:
                y = y[side[y] != side[i]]
            y = y[np.abs(pops[y - start] - count) <= _radius(n[i] + n[y], least)]
            if not len(y):
                continue
            y = y[np.bitwise_count(rows[y - start] ^ own).sum(axis=1, dtype=np.int64) <= _radius(n[i] + n[y], least)]
            for j in y[np.unique(tree[y], return_index=True)[1]].tolist():
                out.append((min(int(nodes[i]), int(nodes[j])), max(int(nodes[i]), int(nodes[j]))))
                tree[tree == tree[j]] = tree[i]
    return out


def _near(least: float):
    """Of rows (a, b, _a, _b) the pairs whose sketches don't rule out that they are similar."""

    def near(x: bytes, y: bytes) -> bool:
        x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
        own, other = x[1:], y[1:]
        while len(other) > len(own):
            other = _halved(other)
        return int(np.bitwise_count(own ^ other).sum(dtype=np.int64)) <= _radius(int(x[0]) + int(y[0]), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [near(x, y) for x, y in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _tiles(compare, value: str, least: float):
    """From rows (tile, is_left, node, root, `value`) sorted by tile: the pairs (a, b) that `compare` gives. Tiles with one side compare it with itself."""

    def arrays(column: pa.Array) -> list[np.ndarray]:
        if pa.types.is_binary(column.type):
            return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
        values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(zero_copy_only=False)
        return [values[x:y].copy() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[int] = set()

        def out() -> pa.RecordBatch:
            sides = np.array([h[1] for h in held])
            links = compare(np.array([h[2] for h in held], np.int64), np.array([h[3] for h in held], np.int64), [h[4] for h in held], least, sides if sides.any() and not sides.all() else None)
            held.clear(), seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("tile", "is_left", "node", "root")), arrays(batch.column(value)), strict=True):
                if held and held[0][0] != row[0]:
                    yield out()
                if row[2] not in seen:
                    seen.add(row[2])
                    held.append(row)
        if held:
            yield out()

    return run


def _partnered(least: float):
    """Of rows (list, size, node, root) sorted by the first two: those with another root of similar size in their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, size, node, root, starts in _groups(batches, ["list", "size", "node", "root"]):
            kept = np.zeros(len(own), bool)
            for s, e in zip(starts.tolist(), np.r_[starts[1:], len(own)].tolist(), strict=True):
                n, changes = size[s:e], np.cumsum(np.r_[0, root[s + 1 : e] != root[s : e - 1]])
                low, high = np.searchsorted(n, n * least - 1e-6), np.searchsorted(n, n / least + 1e-6, side="right")
                kept[s:e] = changes[low] != changes[high - 1]
            yield pa.RecordBatch.from_arrays([pa.array(c[kept], pa.int64()) for c in (own, node, root)], names=["list", "node", "root"])

    return run


def _dealt(placed: DataFrame, limit: int) -> DataFrame:
    """(tile, is_left, node, root) of (cluster, node, root, size): blocks of about `limit` in size, each of which meets itself and each other of its
    cluster once, the lower one on the left."""
    blocks = placed.groupBy("cluster").agg(F.ceil(F.sum("size") / limit).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.join(blocks, "cluster").select("node", "root", "cluster", mine.alias("own"), other.alias("other"))
    tile = F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select("node", "root", tile.alias("tile"), (F.col("own") < F.col("other")).alias("is_left"))


def _compared(dealt: DataFrame, values: DataFrame, compare, least: float) -> DataFrame:
    """(a, b): what `compare` finds in each tile; values: (node, value)."""
    value = next(c for c in values.columns if c != "node")
    met = dealt.join(values, "node").select("tile", "is_left", "node", "root", value)  # copies of a text come again, and are dropped in the task
    return durable(met.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(compare, value, least), "a long, b long"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _large(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of the lists that are in parts: (a, b), the least nodes of the parts as a star, and (list, node, size), equal lists once.

    Lists are told apart by their number of nodes and two sums of hashes of the nodes."""
    parts = lists.filter("part > 0").select("list", F.element_at("nodes", 1).alias("node"))
    least = parts.groupBy(F.col("list").alias("_list")).agg(F.min("node").alias("a"))
    pairs = parts.join(least, F.col("list") == F.col("_list")).filter("node > a").select("a", F.col("node").alias("b"))
    wide = lambda seed: F.sum(F.xxhash64("node", F.lit(seed)).cast("decimal(38,0)"))
    members = lists.filter("part > 0").select("list", F.explode(F.arrays_zip("nodes", "sizes")).alias("m")).select("list", F.col("m.nodes").alias("node"), F.col("m.sizes").alias("size"))
    names = members.groupBy("list").agg(F.count("*").alias("n"), wide(1).alias("h"), wide(2).alias("i"))
    once = names.groupBy("n", "h", "i").agg(F.min("list").alias("_list")).select("_list")
    return pairs, members.join(once, F.col("list") == F.col("_list"), "left_semi")


def _open_links(members: DataFrame, large: DataFrame, sketches: DataFrame, sets_of, links: DataFrame, least: float) -> DataFrame:
    """(a, b): what joins the nodes of the lists of `members` and `large` (list, node, size) that `links` don't join. sets_of gives (node, shingles) of nodes."""
    roots = components(links).select(F.col("node").alias("_node"), "root")
    rooted = lambda rows: rows.join(roots, F.col("node") == F.col("_node"), "left").select("list", "size", "node", F.coalesce("root", "node").alias("root"))
    small = rooted(members).repartition("list").sortWithinPartitions("list", "size").mapInArrow(_partnered(least), "list long, node long, root long")
    mixed = rooted(large).groupBy(F.col("list").alias("_list")).agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("_list")
    still = durable(small.union(rooted(large).join(mixed, F.col("list") == F.col("_list"), "left_semi").select("list", "node", "root")))
    maybe = _compared(_dealt(still.select(F.col("list").alias("cluster"), "node", "root", F.lit(1).alias("size")), TILE), sketches, likely, least)
    cluster = components(maybe).select(F.col("node").alias("_node"), F.col("root").alias("_cluster"))
    ends = durable(_ends(maybe).join(still.select("node", "root").distinct(), "node"))
    sets = sets_of(ends)
    placed = ends.join(cluster, F.col("node") == F.col("_node"), "left").select("node", "root", F.coalesce("_cluster", "node").alias("cluster"))
    sized = placed.join(sets.select("node", F.size("shingles").alias("size")).distinct(), "node")
    found = _compared(_dealt(sized, BLOCK), sets, forest, least)
    forget(still, maybe, ends, sets, shuffles=True)
    return found


def _met(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(a, b, _a, _b): pairs with their values (node, value). A leader of many pairs is dealt into parts."""
    value = next(c for c in values.columns if c != "node")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    salted = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    met = salted.join(values.select(F.col("node").alias("b"), F.col(value).alias("_b")), "b")
    leaders = values.select(F.col("node").alias("a"), F.col(value).alias("_a")).join(parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return met.join(leaders, ["a", "part"]).select("a", "b", "_a", "_b")


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of distinct pairs (a, b) those whose sets of shingles have a Jaccard similarity of at least `least`."""
    shared, x, y = F.size(F.array_intersect("_a", "_b")), F.size("_a"), F.size("_b")
    return durable(_met(pairs, sets).filter(shared / (x + y - shared) >= least).select("a", "b").distinct())


def similar_links(source: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(whole, nodes, links), written tables, of the texts of `source` (doc_id, text_hash, text): whole has a row (doc_id, text_hash, node) for each,
    where a node is a set of shingles, and rows with a chunk, which are counts; nodes (node, first, copies, sketch); links (a, b), whose components are those of all pairs with a similarity of at least `least`."""
    spark, kind = source.sparkSession, source.schema["doc_id"].dataType.simpleString()
    own, limit = ["doc_id", "text_hash", "node", "sketch"], LIST

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, names, id_type = np.zeros(CELLS, np.int32), [*own, "chunk", "counts"], None
        for batch in batches:
            id_type = batch.column("doc_id").type
            for part in pieces(batch, "text"):
                found = [shingle_set(t) for t in part.column("text").to_pylist()]
                cells += np.bincount(_cell(np.concatenate(found), CELLS), minlength=CELLS).astype(np.int32)
                n = len(found)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array([_node(f) for f in found], pa.int64()), pa.array([sketch(f) for f in found], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if id_type is not None:
            chunks = [cells[i : i + CHUNK].tobytes() for i in range(0, CELLS, CHUNK)]
            n = len(chunks)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, id_type), *(pa.nulls(n, pa.int64()) for _ in range(2)), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(chunks, pa.binary())], names=names)

    whole = durable(source.mapInArrow(read, f"doc_id {kind}, text_hash long, node long, sketch binary, chunk int, counts binary"))
    rows = whole.filter("chunk IS NULL")
    cells = spark.sparkContext.broadcast(_sums(whole.filter("chunk IS NOT NULL").select("chunk", "counts")))
    nodes = durable(rows.groupBy("node").agg(F.min(first_row()).alias("first"), F.count("*").alias("copies"), F.min("sketch").alias("sketch")))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, seen = cells.value, set()
        for batch in batches:
            for part in pieces(batch, "text"):
                out = []
                for h, text in zip(part.column("text_hash").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if h in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(h)
                    found = shingle_set(text)
                    n = len(found)
                    if n:
                        many = frequency[_cell(found, CELLS)]
                        order = np.argsort(many, kind="stable")[: n - math.ceil(least * n - 1e-9) + 1]
                        first, node, parts = found[order], _node(found), many[order] // limit + 1
                        # Of a list in parts: this text's part, from 1, and a name of that part's own.
                        part = np.where(parts > 1, node % parts + 1, 0)
                        key = np.where(parts > 1, first ^ (part * 0x9E3779B97F4A7C1).astype(np.int64), first)
                        out.append((key, np.full(len(first), node), (n << 32) + np.arange(len(first)), first, part))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=names)

    names = ["shingle", "node", "place", "whole", "part"]
    dealt = source.select("text_hash", "text").mapInArrow(prefixes, ", ".join(f"{c} long" for c in names)).repartition("shingle").sortWithinPartitions("shingle", "whole", "part")
    listed = durable(dealt.mapInArrow(_stars(least), "a long, b long, list long, part long, nodes array<long>, sizes array<long>"))
    lists = durable(listed.filter("list IS NOT NULL").select("list", "part", "nodes", "sizes").dropDuplicates(["list", "part"]))
    stars, large = _large(lists)
    pairs = durable(listed.filter("list IS NULL").select("a", "b").union(stars).distinct())
    members = lists.filter("part = 0").select("list", F.explode(F.arrays_zip("nodes", "sizes")).alias("m")).select("list", F.col("m.nodes").alias("node"), F.col("m.sizes").alias("size"))
    forget(listed, shuffles=True)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in pieces(batch, "text"):
                found = []
                for h, text in zip(part.column("text_hash").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if h not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(h)
                        found.append(shingle_set(text))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([_node(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    def sets_of(wanted: DataFrame) -> DataFrame:
        chosen = nodes.join(wanted, "node", "left_semi").select(F.col("first.text_hash").alias("h"))
        return durable(_only(source, chosen, "left_semi").select("text_hash", "text").mapInArrow(full, "node long, shingles array<long>"))

    sketches = nodes.select("node", "sketch")
    near = durable(_met(pairs, sketches).mapInArrow(_near(least), "a long, b long"))
    forget(pairs)
    sets = sets_of(_ends(near))
    confirmed = _confirmed(near, sets, least)
    forget(near, sets, shuffles=True)
    links = durable(confirmed.union(_open_links(members, large, sketches, sets_of, confirmed, least)).distinct())
    forget(lists, confirmed)
    return whole, nodes, links


def _with_groups(links: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """`links` and those of each group of texts (text_hash, group) as a star around its least node; rows: text_hash, node."""
    named = durable(rows.select("text_hash", "node").distinct().join(groups, "text_hash").select("group", "node").distinct())
    least = named.groupBy(F.col("group").alias("_group")).agg(F.min("node").alias("a"), F.max("node").alias("_z")).filter("a < _z").drop("_z")
    stars = named.join(least, F.col("group") == F.col("_group")).filter("node > a").select("a", F.col("node").alias("b"))
    out = durable(links.union(stars).distinct())
    forget(named, links)
    return out


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, groups: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` of which one stays for each group of texts whose five-word shingles are similar, directly or by others.

    Every pair of texts with a Jaccard similarity of at least `similarity` is linked, and no other but the texts of one of `groups` (text_hash, group: see
    simhash.linked_texts), if these are given. All columns of `docs` are kept."""
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    whole, nodes, links = similar_links(source, similarity)
    rows = whole.filter("chunk IS NULL").select("doc_id", "text_hash", "node")
    if groups is not None:
        links = _with_groups(links, rows, groups)
    touched = durable(nodes.filter("copies > 1").select("node").union(links.select("a")).union(links.select("b")).distinct())
    met = durable(rows.join(touched, "node"))  # rows that aren't alone: few, without their texts
    stays = durable(components_of(nodes.join(touched, "node", "left_semi").select("node", "first"), links).select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_text")).distinct())
    own = docs.select(packed(docs, []), F.col("doc_id").alias("_own_id"), F.xxhash64("text").alias("text_hash"))
    hashes = met.select(F.col("text_hash").alias("h"))
    alone = _only(own, hashes, "left_anti")
    among = _only(own, hashes, "left_semi")
    # Rows that only share a cell with those aren't in `met`: they stay, too.
    known = met.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).distinct()
    forget(whole, nodes, links, touched, shuffles=True)
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_text"))
    kept = known.join(stays.select(F.col("_id").alias("_i"), F.col("_text").alias("_t"), F.lit(True).alias("_stays")), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_t")), "left").select("_id", "_text", F.coalesce("_stays", F.lit(False)).alias("_stays"))
    judged = among.join(kept, same, "left").filter(F.coalesce("_stays", F.lit(True))).dropDuplicates(["_own_id", "text_hash"])
    return alone.select("row.*").unionByName(judged.select("row.*"))
