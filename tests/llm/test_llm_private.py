"""Personal data: fixed forms against the patterns as they are written down, contexts against a plain bootstrap, and unseen identifiers that are planted."""

import hashlib
import math
import os
import random
import re
import time

import pytest

from citelake.llm import private_data as pd_
from citelake.llm import registry

DATA = "/root/testdata/sf0.01"
PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 13 <= len(digits) <= 19 and plain_luhn(digits), 9 <= len(digits) <= 15)[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_fixed_forms_of_made_up_texts():
    rng = random.Random(13)
    bits = ["a", "b.c", "@", "@@", ".", "-", "+", "%", "_", " ", "  ", "\n", "é", "255", "256", "001", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-9999", "(", ")", "x@y.zz", "7", "12", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert pd_.base_spans(text) == plain_base(text), text


def test_long_texts_take_linear_time():
    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "1." * 150_000, "a@" * 150_000, "+1" + "(" * 300_000, "a@b" + ".c" * 150_000, "a1" * 150_000, "+" * 300_000):
        pd_.mentions(text, pd_.base_spans(text))
    assert time.time() - began < 20


def plain_bootstrap(texts, rounds=pd_.ROUNDS):
    """The spans that contexts add, by dictionaries."""
    rows = [(t or "", plain_base(t)) for t in texts]
    found = [pd_.mentions(t, b) for t, b in rows]
    edges = {(p, v) for ms in found for _, _, _, v, ps in ms for p in ps}
    seeds = {}
    for ms in found:
        for _, _, kind, v, _ in ms:
            if kind is not None:
                seeds[v] = min(kind, seeds.get(v, kind))
    known, trusted = {v: (k, 1000) for v, k in seeds.items()}, {}
    for _ in range(rounds):
        trusted = {}
        for p in {p for p, _ in edges}:
            values = [v for q, v in edges if q == p]
            sums = [sum(known[v][1] for v in values if v in known and known[v][0] == k) for k in range(4)]
            most = max(sums)
            if most >= 3000 and (most + 1000) / (1000 * (len(values) + 2)) >= 0.5:
                trusted[p] = sums.index(most), (most + 1000) / (1000 * (len(values) + 2))
        new = {}
        for v in {v for _, v in edges} - seeds.keys():
            best = []
            for k in range(4):
                cs = [trusted[p][1] for p, w in edges if w == v and p in trusted and trusted[p][0] == k]
                milli = round(1000 * (1 - math.prod(1 - c for c in cs)))
                if cs and milli >= 600:
                    best.append((-milli, k))
            if best:
                new[v] = (min(best)[1], -min(best)[0])
        grown = len(new) + len(seeds) > len(known)
        known = {v: (k, 1000) for v, k in seeds.items()} | new
        if not grown:
            break
    out = []
    for ms in found:
        own = set()
        for s, e, kind, v, ps in ms:
            if kind is None and v in known and (len(v) >= 7 or any(trusted.get(p, (None,))[0] == known[v][0] for p in ps)):
                own.add((known[v][0], s, e))
        out.append(sorted(own))
    return out


def planted():
    rng = random.Random(1)
    texts = [f"Please call me at +1 (555) 010-{k:04d} today" for k in range(8)]
    texts += ["Please call me at 0555-77777 today", "or write 0555-77777 down", "Please CALL me at x17 today", "we met at 0555 in 1999", "number 0555-88888 stays"]
    texts += [f"mail box {w}{k}@example.com now" for k, w in enumerate(("ann", "bob", "cy", "dee"))] + ["mail box root@localhost now", "reach root@localhost twice root@localhost"]
    texts += [None, "", "nothing here", "a1b2c3d4 " * 3, "from host 10.0.0.1 on", "from host 10.0.0.2 on", "from host 10.0.0.3 on", "from host 10.0.0.3 on", "from host 10.0.0.777 on"]
    rng.shuffle(texts)
    return texts


def test_contexts_find_unseen_identifiers(spark):
    texts = planted()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = sorted((r["doc_id"], [tuple(s) for s in r["base"]], [tuple(s) for s in r["added"]]) for r in pd_.private_spans(docs).collect())
    expected = plain_bootstrap(texts)
    assert [(k, b, a) for k, b, a in got] == [(k, plain_base(t), a) for k, (t, a) in enumerate(zip(texts, expected, strict=True))]
    found = {(pd_.KINDS[kind], texts[k][s:e]) for k, _, a in got for kind, s, e in a}
    assert found == {("phone", "0555-77777"), ("email", "root@localhost"), ("ip", "10.0.0.777")}


def test_rows_of_all_kinds(spark):
    rows = [(1, "a@b.cc 1.2.3.4"), (1, "a@b.cc 1.2.3.4"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), len(r["base"]), len(r["added"])) for r in pd_.private_spans(docs).collect())
    assert got == [("1", 2, 0), ("1", 2, 0), ("2", 0, 0), ("None", 0, 0)]
    assert pd_.private_spans(docs.filter("false")).collect() == []


def test_redacted(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([("ié a@b.cc, 1.2.3.4!", [(1, 11, 18), (0, 3, 9), (2, 12, 19)]), ("", []), (None, [])], f"text string, spans array<{pd_.SPAN}>")
    assert [r[0] for r in docs.select(pd_.redacted(F.col("text"), F.col("spans"))).collect()] == ["ié [email], [ip]", "", None]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
def test_query(spark):
    import duckdb

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in registry.QUERIES["op13_private_data"](spark, DATA).collect()}
    assert len(got) == len(docs)
    added = plain_bootstrap([t for _, t in docs])
    join = lambda spans: ",".join(f"{pd_.KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))
    for (doc_id, text), more in zip(docs, added, strict=True):
        base, r = plain_base(text), got[doc_id]
        assert [r[f"n_{k}"] for k in pd_.KINDS] == [sum(x[0] == i for x in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(join(base).encode()).hexdigest() and r["spans"] == join(base + more)
