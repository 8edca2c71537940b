"""The trie of conversations: a node for each distinct sequence of first turns, with what sharing it saves.

Turns are put in order and given polynomial rolling fingerprints of their prefixes by one numpy scan (see scans). Conversations of one depth and
fingerprint are candidates for one node; they are verified turn by turn: the turn itself and the fingerprint before it must be those of the candidate
group's representative, the smallest conversation. Where they aren't, the group is split, and the split is part of the key of all deeper nodes.
So two prefixes are one node if, and only if, they are equal.

Sums over subtrees need no walk by depth: the nodes of one smallest conversation are a chain, chains form a much flatter tree, and
its subtree sums are made by doubling (each round doubles the distance over which sums are known); along a chain they are running sums. A hot
conversation, a hot first turn or many copies of one conversation are spread over tasks: ranges in the scans, partial aggregates,
joins with one side unique. Only the list of ids under one hash is read in order by one task, as packed pieces of PIECE ids.

Defined results: null roles and texts are empty ones; a null turn comes first, turns of one number are ordered by role and text; rows without a conversation
are left out; repeated rows are turns of their own; other columns don't matter; an empty table has no nodes, not even a root."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import durable, forget
from .scans import BASES, MODULI, running

#: Ids in a packed piece.
PIECE = 65_536
#: Turns that conversations of one family may share in op12.
SHARED = 8
NOTHING = sha256(b"").hexdigest()


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, and the rolling sums up to the turn and before it: h0_roll, h0_prior, h1_roll, h1_prior), a written table."""
    said = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    h = F.xxhash64("role", "text")
    hashed = said.select("*", (F.pmod(h, F.lit(MODULI[0] - 1)) + 1).alias("h0"), (F.pmod(F.xxhash64(h), F.lit(MODULI[1] - 1)) + 1).alias("h1"))
    return running(hashed, "conv_id", ["turn", "role", "text"], rolling=["h0", "h1"]).drop("turn", "h0", "h1")


def _joined(first: Column, second: Column) -> Column:
    """One long of two rolling sums."""
    return F.shiftleft(first, 31) + second


def prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, convs) of ordered turns as they are: rows (conv_id, depth, fp, before, role, text), convs (conv_id)."""
    rows = turns.select("conv_id", F.col("place").alias("depth"), _joined(F.col("h0_roll"), F.col("h1_roll")).alias("fp"), _joined(F.col("h0_prior"), F.col("h1_prior")).alias("before"), "role", "text")
    return rows, turns.select("conv_id").distinct()


def rebuilt_prefixes(turns: DataFrame, shared: Column, family: Column, most: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Like prefixes, of conversations that begin with the first `shared` turns of the conversation `family` (all if it has fewer) and go on with their own
    turns after the first `shared`. shared (at most `most`) and family: columns worked out from conv_id. Fingerprints are put together from those of the two parts."""
    convs = durable(turns.groupBy("conv_id").agg(F.max("place").alias("n"), *(F.max(F.when(F.col("place") == shared, F.col(f"h{k}_roll"))).alias(f"cut{k}") for k in (0, 1))).select("*", shared.alias("shared"), family.alias("family")))
    heads = turns.filter(F.col("place") <= most).withColumnRenamed("conv_id", "family")
    lent = durable(convs.filter("shared > 0").select("conv_id", "family", "shared").join(heads, "family").filter("place <= shared").drop("family", "shared"))
    begun = lent.groupBy("conv_id").agg(F.max("place").alias("m"), *(F.max_by(f"h{k}_roll", "place").alias(f"head{k}") for k in (0, 1)))
    known = convs.filter("n > shared").join(begun, "conv_id", "left").select(
        F.col("conv_id").alias("_c"), "shared", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("m", "head0", "head1", "cut0", "cut1"))
    )
    own = turns.join(known, F.col("conv_id") == F.col("_c")).filter("place > shared")
    moved = F.col("shared") - F.col("m")

    def placed(k: int, name: str) -> Column:
        back = F.element_at(F.array(*(F.lit(pow(BASES[k], -s, MODULI[k])) for s in range(most + 1))), (moved + 1).cast("int"))
        return (F.col(f"head{k}") + F.pmod(F.col(f"h{k}_{name}") - F.col(f"cut{k}"), F.lit(MODULI[k])) * back) % MODULI[k]

    after = own.select("conv_id", (F.col("place") - moved).alias("depth"), _joined(placed(0, "roll"), placed(1, "roll")).alias("fp"), _joined(placed(0, "prior"), placed(1, "prior")).alias("before"), "role", "text")
    return prefixes(lent)[0].union(after), convs.select("conv_id")


def _variants(rows: DataFrame) -> DataFrame:
    """A row for each (depth, key, before, role, text): the smallest conversation and how many there are."""
    return rows.groupBy("depth", "key", "before", "role", "text").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))


def verified(rows: DataFrame, bits: int = 62) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes) of (conv_id, depth, fp, before, role, text), written tables: rows (conv_id, depth, key), nodes (conv_id, depth, key, before, n_convs, bytes), of which
    each is one distinct sequence of turns. `bits`: how many of a fingerprint are used, fewer in tests."""
    cut = lambda c: F.array(F.col(c).bitwiseAND(F.lit((1 << bits) - 1))).alias("key" if c == "fp" else c)
    keyed = durable(rows.select("conv_id", "depth", cut("fp"), cut("before"), "role", "text"))
    found = durable(_variants(keyed))
    mixed = found.groupBy("depth", "key").count().filter("count > 1")
    if not mixed.isEmpty():
        nodes = found
        rank = F.expr("row_number() OVER (PARTITION BY depth, key ORDER BY conv_id)") - 1
        classes = found.join(mixed.select("depth", "key"), ["depth", "key"]).withColumn("class", rank.cast("long")).filter("class > 0")
        on = ["depth", "key", "before", "role", "text"]
        splits = keyed.join(classes.select(*on, "class"), on).groupBy(F.col("conv_id").alias("_c")).agg(F.sort_array(F.collect_list(F.struct("depth", "class"))).alias("splits"))
        path = lambda upto: F.flatten(F.transform(F.filter("splits", lambda s: s["depth"] <= upto), lambda s: F.array(s["depth"], s["class"])))
        own = lambda c, upto: F.when(F.col("splits").isNull(), F.col(c)).otherwise(F.concat(F.col(c), path(upto))).alias(c)
        split = keyed.join(splits, F.col("conv_id") == F.col("_c"), "left")
        keyed = durable(split.select("conv_id", "depth", own("key", F.col("depth")), own("before", F.col("depth") - 1), "role", "text"))
        found = durable(_variants(keyed))
        forget(nodes)
    return keyed.select("conv_id", "depth", "key"), found.select("conv_id", "depth", "key", "before", "n_convs", F.octet_length("text").cast("long").alias("bytes"))


def subtree_sums(tree: DataFrame, sums: list[str]) -> DataFrame:
    """(node, *sums) of a forest (node, parent or null, *sums): each node's sums over its whole subtree, in as many rounds as the logarithm of the depth."""
    names = [f"_{c}" for c in sums]
    now = durable(tree.select("node", "parent", *sums))
    while not now.filter("parent IS NOT NULL").isEmpty():
        below = now.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("_n")).agg(*(F.sum(c).alias(n) for c, n in zip(sums, names, strict=True)))
        up = now.select(F.col("node").alias("_u"), F.col("parent").alias("_up"))
        summed = now.join(below, F.col("node") == F.col("_n"), "left").join(up, F.col("parent") == F.col("_u"), "left")
        after = durable(summed.select("node", F.col("_up").alias("parent"), *((F.col(c) + F.coalesce(n, F.lit(0))).alias(c) for c, n in zip(sums, names, strict=True))))
        forget(now)
        now = after
    return now.select("node", *sums)


def _digests(ends: DataFrame) -> DataFrame:
    """(node, depth, sha) of (node, depth, conv_id): the hash of each node's conversations, ascending and with commas between."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, depth, own = (batch.column(c).to_numpy() for c in ("node", "depth", "conv_id"))
            if not len(own):
                continue
            starts = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])])
            cuts = [*(x for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True) for x in range(s, e, PIECE)), len(own)]
            ids = [",".join(map(str, own[s:e].tolist())) for s, e in zip(cuts, cuts[1:], strict=False)]
            at = np.array(cuts[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(depth[at]), pa.array(own[at]), pa.array(ids)], names=["node", "depth", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            out = []
            for node, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now == (node, depth):
                    held.update(b",")
                else:
                    if now:
                        out.append((*now, held.hexdigest()))
                    now, held = (node, depth), sha256()
                held.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["_n", "_d", "sha"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, held.hexdigest())], names=["_n", "_d", "sha"])

    by = ["node", "depth", "conv_id"]
    packed = ends.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(pack, "node long, depth long, first long, ids string")
    return packed.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(digest, "_n long, _d long, sha string")


def trie(rows: DataFrame, convs: DataFrame, bits: int = 62) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node of the trie of `rows`
    (conv_id, depth, fp, before, role, text), whose conversations are those of `convs` (conv_id), turnless ones included."""
    keyed, found = verified(rows, bits)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.array(F.lit(0).cast("long")).alias("key"), F.lit(None).cast("array<long>").alias("before"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("bytes"))
    nodes = durable(found.union(root.filter(F.col("conv_id").isNotNull())))
    # Where conversations end.
    last = keyed.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by("key", "depth").alias("key"))
    ended = convs.join(last, "conv_id", "left").select(F.coalesce("depth", F.lit(0)).cast("long").alias("_d"), F.coalesce("key", F.array(F.lit(0).cast("long"))).alias("_k"), F.col("conv_id").alias("_c"))
    ends = durable(ended.join(nodes, (F.col("_d") == F.col("depth")) & (F.col("_k") == F.col("key"))).select(F.col("conv_id").alias("node"), "depth", F.col("_c").alias("conv_id")))
    # Chains: the nodes of one smallest conversation, from their top down; the top hangs on a node of another chain.
    spans = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.min_by("before", "depth").alias("before"))
    parents = nodes.select(F.col("conv_id").alias("parent"), F.col("depth").alias("_d"), F.col("key").alias("_k"))
    chains = durable(spans.join(parents, (F.col("top") - 1 == F.col("_d")) & (F.col("before") == F.col("_k")), "left").select("conv_id", "top", "bottom", "parent"))
    hung = chains.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("_p"), (F.col("top") - 1).alias("_at")).agg(F.count("*").alias("hung"))
    own = chains.select(F.col("conv_id").alias("_c"), "top", "bottom", "parent")
    here = nodes.join(own, F.col("conv_id") == F.col("_c")).join(hung, (F.col("conv_id") == F.col("_p")) & (F.col("depth") == F.col("_at")), "left")
    children = F.coalesce("hung", F.lit(0)) + F.when(F.col("depth") < F.col("bottom"), 1).otherwise(0)
    up = F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent"))
    linked = durable(here.select("conv_id", "depth", up.alias("up"), "n_convs", children.cast("long").alias("n_children"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")).withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")))
    # Sums of whole chains, then of what hangs on each node, then along the chains.
    weights = linked.groupBy(F.col("conv_id").alias("node")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    totals = durable(subtree_sums(weights.join(chains.select(F.col("conv_id").alias("_c"), "parent"), F.col("node") == F.col("_c")), ["saved", "leaves"]))
    sums = totals.select(F.col("node").alias("_t"), F.col("saved").alias("_saved"), F.col("leaves").alias("_leaves"))
    hanging = chains.filter("parent IS NOT NULL").join(sums, F.col("conv_id") == F.col("_t")).groupBy(F.col("parent").alias("_p"), (F.col("top") - 1).alias("_at")).agg(F.sum("_saved").alias("_hs"), F.sum("_leaves").alias("_hl"))
    with_hung = linked.join(hanging, (F.col("conv_id") == F.col("_p")) & (F.col("depth") == F.col("_at")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    weighed = durable(with_hung.select("conv_id", "depth", "up", "n_convs", "n_children", (F.col("saved") + zero("_hs")).alias("saved"), (F.col("leaves") + zero("_hl")).alias("leaves")))
    along = running(weighed, "conv_id", ["depth"], sums=["saved", "leaves"])
    whole = lambda c: (F.col(f"_{c}") - F.col(f"{c}_sum") + F.col(c)).cast("long")
    out = along.join(sums, F.col("conv_id") == F.col("_t")).join(_digests(ends), (F.col("conv_id") == F.col("_n")) & (F.col("depth") == F.col("_d")), "left")
    return out.select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", whole("leaves").alias("n_leaves"), whole("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations in `turns` (conv_id, turn, role, text)."""
    return trie(*prefixes(ordered_turns(turns)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)
    return trie(*rebuilt_prefixes(turns, shared, F.col("conv_id") - F.col("conv_id") % 5))
