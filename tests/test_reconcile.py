"""Numbered lists against entries: a plain version that goes through a document's labels one after the other."""

import random

from pyspark.sql import functions as F

from citelake.operators import reconcile as rc

PARSED = "doc int, label int, part int, is_erratum boolean, author string, year int, page string, arxiv string, doi string, journal string, volume string"
ENTRY = "doc int, entry int, label string, author string, year int, page string, arxiv string, doi string, journal string, volume string"


def plain_score(p, e):
    """Of (author, year, page): last names without accents or points here."""
    s = 0.0
    if p[0] and e[0]:
        s += 4 if p[0] == e[0] else 3 if p[0] in e[0] or e[0] in p[0] else 0
    if p[1] is not None and e[1] is not None:
        s += {0: 2.0, 1: 1.5, 2: 1.0, 3: 0.5}.get(abs(p[1] - e[1]), 0.0)
    return s + (2 if p[2] and p[2] == e[2] else 0)


def plain_reconcile(labels, papers, entries):
    """labels: {label: n}; papers: {label: [(part, is_erratum, key)]}; entries: [key]. -> {label: (count, first, n, picks, missing)}."""
    order, total = sorted(labels), len(entries)
    counts = {k: labels[k] for k in order}
    picks, missing = {k: [] for k in order}, {k: [] for k in order}
    if papers:
        at = 0
        for k in order:
            own = papers.get(k, [])
            real = [p for p in own if not p[1]]
            n = len(real) or labels[k]
            if not own:
                at += n
                continue

            def run(some, end):
                taken = []
                for part, _, key in some:
                    best = None
                    for j in range(at, min(end, total)):
                        s = plain_score(key, entries[j])
                        if j not in [t[1] for t in taken] and s > (best[1] if best else 0):
                            best = j, s
                    if best and best[1] >= 3:
                        taken.append((part, *best))
                return taken

            picks[k] = run(real, at + n + 3) or run(own, at + n + 8)
            counts[k] = n if picks[k] else min(n, max(1, total - at))
            missing[k] = [p[0] for p in real if p[0] not in [t[0] for t in picks[k]]]
            if at >= total:
                break
            at += counts[k]
    else:
        excess = sum(counts.values()) - total
        for k in order:
            if excess > 0 and counts[k] > 1:
                counts[k] -= 1
                excess -= 1
    out, first = {}, 0
    for k in order:
        out[k] = (counts[k], first, max(0, min(counts[k], total - first)), picks[k], missing[k])
        first += counts[k]
    return out


def made_up(rng):
    """A list of entries and what a reader made of it: papers lost, doubled, swapped, several under one label."""
    entries = [(rng.choice(["smith", "jones", "li", "smithson", "wu"]), rng.choice([None, *range(1990, 1996)]), rng.choice(["", "1", "2", "3"])) for _ in range(rng.randint(0, 14))]
    read = [e for e in entries if rng.random() > 0.15]
    for _ in range(rng.randint(0, 3)):
        if len(read) > 1:
            i = rng.randrange(len(read) - 1)
            read[i], read[i + 1] = read[i + 1], read[i]
    if read and rng.random() < 0.3:
        read.insert(rng.randrange(len(read)), ("nobody", 1900, "9"))
    if read and rng.random() < 0.2:
        read += read[:3]
    labels, papers, label = {}, {}, 0
    while read:
        label += rng.choice([1, 1, 1, 2])
        some, read = read[: rng.choice([1, 1, 2, 3])], read[3:] if rng.random() < 0.1 else read[1:]
        labels[label] = rng.choice([len(some), len(some), 1, 4])
        if rng.random() > 0.1:
            papers[label] = [(i, rng.random() < 0.1, e) for i, e in enumerate(some)]
    return labels, papers if rng.random() > 0.15 else {}, entries


def test_equals_the_plain_version(spark):
    rng = random.Random(8)
    docs = [made_up(rng) for _ in range(250)]
    none = (None,) * 4
    labels = spark.createDataFrame([(d, k, n) for d, (ls, _, _) in enumerate(docs) for k, n in ls.items()], "doc int, label int, n int")
    papers = spark.createDataFrame([(d, k, part, bad, *key, *none) for d, (_, ps, _) in enumerate(docs) for k, own in ps.items() for part, bad, key in own], PARSED)
    entries = spark.createDataFrame([(d, i, str(i + 1), *e, *none) for d, (_, _, es) in enumerate(docs) for i, e in enumerate(es)], ENTRY)
    out = rc.reconcile(labels, papers, entries)
    got = {(r["doc"], r["label"]): (r["count"], r["first"], r["n_entries"], [tuple(x) for x in r["picks"]], list(r["missing"])) for r in out.collect()}
    expected = {(d, k): v for d, doc in enumerate(docs) for k, v in plain_reconcile(*doc).items()}
    assert got == expected
    assert any(v[4] for v in expected.values()) and any(len(v[3]) > 1 for v in expected.values())
    judged = {r["doc"]: r for r in rc.list_agreement(labels, papers, entries, out).collect()}
    for d, (ls, ps, es) in enumerate(docs):
        if not ls:
            continue
        own = [v for (e, _), v in expected.items() if e == d]
        counted, total = sum(v[0] for v in own), len(es)
        coverage, ratio = (sum(v[2] for v in own) / total, counted / total) if total else (0.0, 1.0)
        over = bool(ps) and counted > total
        strict = bool(ps) and (abs(counted - total) >= 5 or ratio < 0.85) and not total and coverage >= 0.5 and not over
        r = judged[d]
        assert (r["total"], r["expected"], r["counted"], r["coverage"], r["ratio"], r["well_aligned"], r["over_parsed"], r["strict"]) == (total, sum(ls.values()), counted, coverage, ratio, total > 0, over, strict)


def test_strict_and_empty(spark):
    labels = spark.createDataFrame([(1, k, 1) for k in range(1, 8)], "doc int, label int, n int")
    papers = spark.createDataFrame([(1, k, 0, False, f"n{k}x", 2000, None, None, None, None, None) for k in range(1, 8)], PARSED)
    entries = spark.createDataFrame([(1, i, None, f"n{i + 1}x", 2000, None, None, None, None, None) for i in range(13)], ENTRY)
    out = rc.reconcile(labels, papers, entries)
    (r,) = rc.list_agreement(labels, papers, entries, out).collect()
    assert r["strict"] and not r["well_aligned"] and (r["counted"], r["total"]) == (7, 13)
    assert rc.reconcile(labels.filter("false"), papers, entries).collect() == []
    alone = rc.reconcile(labels, papers.filter("false"), entries.filter("false")).orderBy("label").collect()
    assert [(x["count"], x["n_entries"]) for x in alone] == [(1, 0)] * 7
    assert rc.list_agreement(labels, papers, entries.filter("false"), rc.reconcile(labels, papers, entries.filter("false"))).select(F.max("ratio")).first()[0] == 1.0


def pair_score(p, e):
    """Of dicts: the rules of records.match_score, for last names without accents."""
    if p["arxiv"] and p["arxiv"] == e["arxiv"]:
        return 10.0
    s = plain_score((p["author"], p["year"], p["page"]), (e["author"], e["year"], e["page"]))
    volume, page = bool(p["volume"]) and p["volume"] == e["volume"], bool(p["page"]) and p["page"] == e["page"]
    if p["journal"] and volume and ((p["journal"] == e["journal"] and (page or not p["page"] or not e["page"])) or page):
        s += 4
    return s


def plain_strong(p, e):
    if p["arxiv"] and p["arxiv"] == e["arxiv"]:
        return 3, 10
    author = bool(p["author"] and e["author"]) and (p["author"] in e["author"] or e["author"] in p["author"])
    page, near = bool(p["page"]) and p["page"] == e["page"], p["year"] is not None and e["year"] is not None and abs(p["year"] - e["year"]) <= 3
    if p["journal"] and p["volume"] and p["volume"] == e["volume"] and author and (page or near):
        return 1, 6 + 2 * (p["journal"] == e["journal"]) + 2 * page + near
    return None


def plain_settle(labels, papers, entries):
    """One label after the other, one strategy after the other."""
    total = len(entries)
    seq = plain_sequence(labels, papers, entries)
    numbers = [int(e["label"]) for e in entries if e["label"]]
    counted, covered = sum(v[0] for v in seq.values()), sum(v[2] for v in seq.values())
    ratio, coverage = (counted / total, covered / total) if total else (1.0, 0.0)
    over = bool(papers) and counted > total
    aligned = total and sum(e["label"] == str(i + 1) for i, e in enumerate(entries)) / total >= 0.95
    strict = bool(papers) and (abs(counted - total) >= 5 or ratio < 0.85) and not aligned and coverage >= 0.5 and not over
    excess, out = over and ratio > 1.05, {}
    same_id = lambda p, i: bool(p["arxiv"]) and p["arxiv"] == entries[i]["arxiv"]
    for k in sorted(labels):
        own = [p for p in papers.get(k, []) if not p["bad"]] or papers.get(k, [])
        _, first, n, *_ = seq[k]
        scored = [(p, i, s) for p in own for i, e in enumerate(entries) if (s := pair_score(p, e)) >= 3]
        if hit := [i for i, e in enumerate(entries) if e["label"] == str(k)]:
            out[k] = hit, "label"
            continue
        strong = [(-x[0], -x[1], p["part"], i) for p, i, _ in scored if (x := plain_strong(p, entries[i])) and (not n or first - 1 <= i <= first + n)]
        if strong:
            out[k] = [min(strong)[3]], "strong"
            continue
        if numbers and k > max(numbers) and (hit := sorted({min(i for q, i, _ in scored if q is p and same_id(p, i)) for p, j, _ in scored if same_id(p, j)})):
            out[k] = hit, "id"
            continue
        if numbers and not excess and n:
            out[k] = list(range(first, first + n)), "sequence"
            continue
        hit = set()
        if strict or excess:
            for p in own:
                mine = [(-s, i) for q, i, s in scored if q is p]
                if not mine:
                    continue
                fits = [x for x in mine if p["year"] is not None and entries[x[1]]["year"] is not None and abs(p["year"] - entries[x[1]]["year"]) <= 3]
                same = [x for x in mine if same_id(p, x[1])]
                best = min(same) if same else min(fits) if fits and min(mine)[0] >= min(fits)[0] - 1 else min(mine)
                if best in same or (best in fits and -best[0] >= 4) or (p["year"] is None and -best[0] >= 6):
                    hit.add(best[1])
        if hit:
            out[k] = sorted(hit), "best"
            continue
        if not numbers:
            near = {min((-s, i) for q, i, s in scored if q is p and k - 2 <= i <= 2 * k + 8)[1] for p in own if any(q is p and k - 2 <= i <= 2 * k + 8 for q, i, _ in scored)}
            if near:
                out[k] = sorted(near), "near"
            elif not strict and 1 <= k <= total:
                out[k] = [k - 1], "place"
    return out


def plain_sequence(labels, papers, entries):
    """plain_reconcile with pair_score."""
    global plain_score
    keep = plain_score
    try:
        plain_score = lambda p, e: pair_score(p, e) if isinstance(p, dict) else keep(p, e)
        return plain_reconcile(labels, {k: [(p["part"], p["bad"], p) for p in own] for k, own in papers.items()}, entries)
    finally:
        plain_score = keep


def test_settled_labels_equal_the_plain_version(spark):
    rng, docs = random.Random(31), []
    pick = lambda *x: rng.choice([None, *x])
    for _ in range(200):
        kind = rng.choice(["labelled", "none", "shifted", "some"])
        entries = []
        for i in range(rng.randint(0, 14)):
            label = {"labelled": str(i + 1), "none": None, "shifted": str(i + 3), "some": rng.choice([None, "", str(i + 1)])}[kind]
            entries.append({"label": label, "author": rng.choice(["smith", "jones", "li", "smithson", "wu"]), "year": pick(*range(1990, 1999)), "page": pick("1", "2", "3"), "arxiv": pick(f"2301.{10000 + rng.randrange(12)}"), "journal": pick("J", "K"), "volume": pick("5", "6")})
        read, label, labels, papers = [dict(e) for e in entries if rng.random() > 0.2], 0, {}, {}
        for _ in range(rng.randint(0, 6)):
            read.insert(rng.randint(0, len(read)), {"author": "nobody", "year": 1900, "page": "9", "arxiv": None, "journal": None, "volume": None})
        while read:
            label += rng.choice([1, 1, 1, 2])
            n = rng.choice([1, 1, 1, 2, 3])
            some, read = read[:n], read[n:]
            labels[label] = rng.choice([len(some), 1])
            if rng.random() > 0.1:
                papers[label] = [{**e, "arxiv": e["arxiv"] if rng.random() < 0.5 else None, "part": i, "bad": rng.random() < 0.1} for i, e in enumerate(some)]
        docs.append((labels, papers if rng.random() > 0.1 else {}, entries))
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    labels = table([(d, k, n) for d, (ls, _, _) in enumerate(docs) for k, n in ls.items()], "doc int, label int, n int")
    papers = table([(d, k, p["part"], p["bad"], p["author"], p["year"], p["page"], p["arxiv"], None, p["journal"], p["volume"]) for d, (_, ps, _) in enumerate(docs) for k, own in ps.items() for p in own], PARSED)
    entries = table([(d, i, e["label"], e["author"], e["year"], e["page"], e["arxiv"], None, e["journal"], e["volume"]) for d, (_, _, es) in enumerate(docs) for i, e in enumerate(es)], ENTRY)
    got = {(r["doc"], r["label"]): (list(r["found"]), r["by"]) for r in rc.settled_labels(labels, papers, entries).collect()}
    expected = {(d, k): v for d, doc in enumerate(docs) for k, v in plain_settle(*doc).items()}
    wrong = [(k, got.get(k), expected.get(k)) for k in sorted(got.keys() | expected.keys()) if got.get(k) != expected.get(k)]
    assert not wrong, wrong[:3]
    assert {v[1] for v in expected.values()} == {"label", "strong", "id", "sequence", "best", "near", "place"}
    assert rc.settled_labels(labels.filter("false"), papers, entries).collect() == []


def test_settled_labels_score_pairs_once(spark, monkeypatch):
    """The pairs that strategies go by serve the sequence, too, and nothing is written for each strategy."""
    labels = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], "doc int, label int, n int")
    papers = spark.createDataFrame([(1, k, 0, False, "smith", 1990 + k, "1", None, None, None, None) for k in (1, 2)], PARSED)
    entries = spark.createDataFrame([(1, k - 1, None, "smith", 1990 + k, "1", None, None, None, None) for k in (1, 2)], ENTRY)
    written, keep = [], rc.durable
    monkeypatch.setattr(rc, "durable", lambda df: written.append(1) or keep(df))
    monkeypatch.setattr(rc, "match_score", None)
    got = sorted((r["label"], list(r["found"]), r["by"]) for r in rc.settled_labels(labels, papers, entries).collect())
    assert got == [(1, [0], "near"), (2, [1], "near")] and len(written) <= 3
