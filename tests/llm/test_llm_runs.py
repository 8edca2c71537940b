"""Periodic runs: against plain versions by words, hashes that all collide too, and the query over the smallest table."""

import hashlib
import os
import random
from zlib import crc32

import numpy as np
import pytest

from citelake.llm import periodic_runs as pr
from citelake.llm import registry

DATA = "/root/testdata/sf0.001"


def plain_runs(words, least=6, times=4):
    """Every period, every stretch, word by word."""
    n, seen = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(least, times * p):
                seen.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in seen.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def made_up(rng):
    out = []
    for _ in range(rng.randint(0, 5)):
        block = [rng.choice("ab" if rng.random() < 0.5 else "abcde") for _ in range(rng.randint(1, 6))]
        out += (block * rng.randint(1, 7))[: rng.randint(1, 30)]
    return out


@pytest.mark.parametrize("base", [pr._BASE, np.uint64(0)])  # with base 0 nearly all hashes are equal
def test_runs_of_made_up_texts(base):
    rng = random.Random(11)
    texts = [" ".join(made_up(rng)) for _ in range(400)] + [None, "", " \n", "a " * 100, "a b " * 50 + "a", "x"]
    for text, (words, own) in zip(texts, pr._by_text(texts, 6, 4, base), strict=True):
        split = (text or "").split()
        assert [w.decode() for w in words] == split
        assert [tuple(r) for r in own.tolist()] == plain_runs(split), text
        assert pr._collapsed(words, own).decode() == " ".join(plain_collapsed(split, plain_runs(split)))


def test_other_bounds_and_blocks(monkeypatch):
    monkeypatch.setattr(pr, "PAIRS", 7)
    rng = random.Random(5)
    for least, times in ((2, 2), (10, 3), (4, 5)):
        for _ in range(100):
            words = made_up(rng)
            ids = np.array([ord(w) for w in words], np.int64)
            got = [(s, e - s, p) for s, e, p in pr.find_runs(ids, len(ids) // times, least, times).tolist()]
            assert got == plain_runs(words, least, times)


def test_long_text():
    """A long text of one word, and a long one with one repeat of long period."""
    assert pr.find_runs(np.zeros(60_000, np.int64), 15_000).tolist() == [[0, 60_000, 1]]
    rng = np.random.default_rng(3)
    block = rng.integers(0, 1 << 40, 5_000)
    ids = np.r_[rng.integers(0, 1 << 40, 777), np.tile(block, 5)[:21_000], rng.integers(0, 1 << 40, 99)]
    assert pr.find_runs(ids, len(ids) // 4).tolist() == [[777, 21_777, 5_000]]


def test_rows_of_all_kinds(spark):
    rows = [(1, "a b a b a b a b c", "x"), (1, "a b a b a b a b c", "x"), (None, None, None), (2, "", "y"), (3, "é\x0b" * 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in pr.periodic_runs(docs).collect()), key=str)
    assert got == sorted([(1, [(0, 8, 2)], "a b c"), (1, [(0, 8, 2)], "a b c"), (None, [], ""), (2, [], ""), (3, [(0, 8, 1)], "é")], key=str)
    assert pr.periodic_runs(docs.filter("false")).collect() == []
    odd = docs.select("doc_id", "text").withColumn("a.b", docs["doc_id"])
    assert pr.periodic_runs(odd).columns == ["doc_id", "text", "a.b", "runs", "collapsed"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
def test_query(spark):
    import duckdb

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r) for r in registry.QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        for r in runs:  # exactly
            if r[1] * best[2] > best[1] * r[2]:
                best = r
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[doc_id] == (doc_id, len(runs), *four, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(" ".join(plain_collapsed(words, runs))))
    assert planted
