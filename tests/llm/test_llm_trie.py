"""The conversation trie: against a plain trie, fingerprints that collide and conversations over several tasks too."""

import hashlib
import os
import random
from zlib import crc32

import pytest

from citelake.llm import prefix_trie as pt
from citelake.llm import registry, scans

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """From (conv_id, turn, role, text) to the turns of each conversation, in order."""
    out = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def rebuilt(convs):
    """By the rule of op12."""
    out = {}
    for c, own in convs.items():
        h = crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    if not convs:
        return []
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[x] for x in below) or 1
        saved[path] = sum(saved[x] for x in below) + (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], sha(ends.get(p, [])))
        for p, m in members.items()
    )


def got(df):
    return sorted(tuple(r) for r in df.collect())


def made_up(seed, n=60):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        c = rng.choice([None, *range(25)])
        rows.append((c, rng.choice([None, *range(8)]), rng.choice([None, "", "user", "a"]), rng.choice([None, "", "x", "y", "é\n"])))
    return rows


@pytest.mark.parametrize("bits", [62, 2])
def test_made_up_conversations(spark, bits):
    """With two bits, most groups of candidates hold several different prefixes."""
    for seed in (1, 2):
        rows = made_up(seed, 160)
        turns = pt.ordered_turns(spark.createDataFrame(rows, SCHEMA))
        assert got(pt.trie(*pt.prefixes(turns), bits)) == plain_trie(ordered(rows))


def test_copies_and_growing_conversations(spark):
    """Copies of one conversation, ones that go one turn further each, and one that many tasks hold."""
    rows = [(c, t, "user", f"t{t}") for c in range(40) for t in range(3)]
    rows += [(100 + c, t, "user", f"g{t}") for c in range(12) for t in range(c + 1)]
    rows += [(500, t, "user", "same") for t in range(3000)] + [(501, 0, "user", "same")] * 2500
    expected = plain_trie(ordered(rows))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = spark.createDataFrame(rows, SCHEMA)
        spans = pt.ordered_turns(turns)
        assert spans.filter("conv_id = 501").agg({"place": "max"}).first()[0] == 2500
        assert got(pt.trie(*pt.prefixes(spans))) == expected
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_running_over_tasks(spark):
    rows = [(g, i, (7 * i + g) % 13, (11 * i + g) % 17 + 1) for g, n in ((1, 3), (2, 900), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, o long, s long, r long").repartition(5)
    out = scans.running(df, "g", ["o"], ["s"], ["r"]).collect()
    for g in (1, 2, 3):
        total = roll = 0
        for k, r in enumerate(sorted((r for r in out if r["g"] == g), key=lambda r: r["o"]), 1):
            total, prior, roll = total + r["s"], roll, (roll + r["r"] * pow(scans.BASES[0], k, scans.MODULI[0])) % scans.MODULI[0]
            assert (r["place"], r["s_sum"], r["r_roll"], r["r_prior"]) == (k, total, roll, prior)


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert got(pt.conversation_trie(none)) == []
    one = spark.createDataFrame([(3, None, None, None, 1, "k")], SCHEMA + ", depth long, key string")
    assert got(pt.conversation_trie(one)) == plain_trie({3: [("", "")]})
    assert got(pt.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []


def test_rebuilt(spark):
    rows = made_up(7, 200)
    turns = pt.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    from pyspark.sql import functions as F

    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    assert got(pt.trie(*pt.rebuilt_prefixes(turns, shared, F.col("conv_id") - F.col("conv_id") % 5))) == plain_trie(rebuilt(ordered(rows)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
def test_query(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{DATA}/conversations.parquet'").fetchall()
    assert got(registry.QUERIES["op12_prefix_trie"](spark, DATA)) == plain_trie(rebuilt(ordered(rows)))
