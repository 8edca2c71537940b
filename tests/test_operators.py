"""Operators on small literal tables."""

import pytest
from pyspark.sql import functions as F

from citelake.operators import graph, lists, pairs, records, related

COLUMNS = "recid long, owner long, title string, year string, earliest_date string, citation_count long, citation_count_wo_self long, journal_title string, arxiv_id string, document_type array<string>, local_item_id long, is_related boolean, total_authors int"


def paper(recid, cites=10, wo=None, title="T", year="2020", kind="article", journal=None, local=None):
    return (recid, 1, title, year, f"{year}-01-01", cites, wo, journal, None, [kind], local, False, 3)


@pytest.fixture(scope="module")
def small(spark):
    papers = [paper(1), paper(10, 10), paper(11, 100, 5), paper(12, 400, title="Review of Particle Physics"), paper(13, 20, kind="review"), paper(20, 50, year="2019"), paper(21, 50, year="2021"), paper(22, None, year="x"), paper(23, 7, kind="review")]
    edges = [(1, 10), (1, 11), (1, 12), (1, 13), (20, 10), (20, 11), (21, 10), (22, 10), (22, 11), (23, 10), (20, 1), (21, 1), (11, 10)]
    return spark.createDataFrame(edges, "citing long, cited long"), spark.createDataFrame(papers, COLUMNS), spark.createDataFrame([(1,)], "seed long")


def test_anchors(small):
    got = related.anchors(*small).orderBy("rank").collect()
    assert [(r["recid"], r["rank"]) for r in got] == [(10, 1), (11, 2)]  # neither the general review nor a review


def test_coupling(small):
    got = {r["recid"]: r for r in related.related_coupling(*small).collect()}
    assert set(got) == {20, 21, 22}  # not the seed, its references or a review
    assert got[20]["shared"] == got[22]["shared"] == 2 and got[21]["shared"] == 1
    assert got[20]["coupling"] == pytest.approx(1) and got[20]["rank"] == 1 and got[22]["rank"] == 2


def test_hybrid_without_citations(small):
    got = related.related(*small).collect()
    assert all(r["co_citation"] == 0 and r["combined"] == r["coupling"] for r in got)  # the seed has fewer than five citations


def test_one_hop_and_totals(small):
    links, papers, seeds = small
    shown = {(r["side"], r["recid"]) for r in graph.one_hop(*small).collect()}
    assert shown == {("references", 10), ("references", 11), ("cited_by", 20), ("cited_by", 21)}
    recent = graph.one_hop(*small, "mostrecent").filter("side = 'cited_by'").orderBy("rank").collect()
    assert [r["recid"] for r in recent] == [21, 20]
    assert tuple(graph.graph_totals(links, seeds).first()) == (4, 2)


def test_multi_seed(spark, small):
    links, papers, _ = small
    seeds = spark.createDataFrame([(1,), (20,), (22,)], "seed long")
    got = {(r["side"], r["recid"]): r["connections"] for r in graph.multi_seed(links, papers, seeds).collect()}
    assert got[("references", 10)] == 3 and got[("references", 11)] == 3
    assert not {1, 20, 22} & {r for _, r in got}
    assert {tuple(r) for r in graph.seed_edges(links, seeds).collect()} == {(20, 1)}


def test_histogram(spark):
    rows = spark.createDataFrame([("g", c) for c in [0, 1, 9, 10, 49, 50, 99, 100, 249, 250, 499, 500, -1]], "g string, citation_count long")
    got = {r["bin"]: r["n"] for r in lists.citation_histogram(rows, rows, "g").collect()}
    assert got == {"0": 1, "1-9": 2, "10-49": 2, "50-99": 2, "100-249": 2, "250-499": 2, "500+": 1}


def plain_bins(years, bars=10, least=3):
    """Bars of equal share, worked out with lists."""
    counts = sorted({y: years.count(y) for y in set(years)}.items())
    if len(counts) <= bars:
        return [([y], n) for y, n in counts]
    share, out, now = max(least, -(-len(years) // bars)), [], []
    for i, (y, n) in enumerate(counts):
        now.append((y, n))
        left = len(counts) - i - 1
        if sum(n for _, n in now) >= share or left <= bars - len(out) - 1 or not left:
            out.append(([y for y, _ in now], sum(n for _, n in now)))
            now = []
    while len(out) > bars:
        k = min(range(len(out) - 1), key=lambda i: out[i][1] + out[i + 1][1])
        out[k : k + 2] = [(out[k][0] + out[k + 1][0], out[k][1] + out[k + 1][1])]
    while len(out) > 3 and out[0][1] < least and out[0][1] + out[1][1] < share * 1.5:
        out[:2] = [(out[0][0] + out[1][0], out[0][1] + out[1][1])]
    return out


@pytest.mark.parametrize("years", [[2000 + i % 40 for i in range(200)], [1990, *[2000 + i for i in range(12)] * 3], [2001] * 5, [1990 + i for i in range(11)], [1990 + i * i % 37 for i in range(90)]])
def test_year_bins(spark, years):
    rows = spark.createDataFrame([("g", str(y)) for y in years] + [("g", "Unknown"), ("g", ""), ("g", None)], "g string, year string")
    got = [((r["first"], r["last"]), r["n"]) for r in lists.year_bins(rows, "g").orderBy("first").collect()]
    assert got == [((ys[0], ys[-1]), n) for ys, n in plain_bins(years)]


def test_filters(spark):
    assert lists.choose(["published"], "preprint") == ["preprint"]
    assert lists.choose(["published"], "published") == []
    papers = spark.createDataFrame([paper(1, 51), paper(2, 50, year="2011a"), paper(3, 0, year="Unknown", local=4)], COLUMNS)
    ids = lambda *f: sorted(r["recid"] for r in lists.apply_filters(papers, list(f), 2015).collect())
    assert ids("high_citations") == [1] and ids("recent_5y") == [1, 2] and ids("local") == [3] and ids("online") == [1, 2] and ids() == [1, 2, 3]


def test_h_index(spark):
    rows = spark.createDataFrame([("a", c) for c in [10, 8, 5, 4, 3]] + [("b", 0), ("b", None)], "author string, citation_count long")
    got = {r["author"]: (r["h_index"], r["citations"]) for r in lists.h_index(rows, "author").collect()}
    assert got == {"a": (4, 30), "b": (0, 0)}


def test_changes_and_protection(spark):
    local = spark.createDataFrame([(1, "A  title ", None), (2, "Old", "x")], "k int, title string, date string")
    remote = spark.createDataFrame([(1, "a title", "2020"), (2, "New", "")], "k int, title string, date string")
    changes = records.field_changes(local, remote, "k", ["title", "date"])
    assert {(r["k"], r["field"], r["was_empty"]) for r in changes.collect()} == {(1, "date", True), (2, "title", False)}
    assert [r["field"] for r in records.protect(changes, ["title", "date"]).collect()] == ["date"]


def test_unpublished(spark):
    rows = spark.createDataFrame([("journalArticle", "arXiv:1", "", "", "", ""), ("journalArticle", "arXiv:1", "10.1/x", "", "1", "2"), ("journalArticle", "arXiv:1", "10.1/x", "", "1", ""), ("journalArticle", "", "", "arXiv:1", "", ""), ("journalArticle", "", "10.48550/arXiv.1", "", "", ""), ("book", "arXiv:1", "", "", "", ""), ("journalArticle", None, None, None, None, None)], "a string, b string, c string, d string, e string, f string")
    got = rows.select(records.is_unpublished(*map(F.col, "abcdef")).alias("r")).collect()
    assert [r["r"] for r in got] == [True, False, True, True, True, False, False]


def test_cache(spark):
    rows = spark.createDataFrame([("refs", 2, True, 5, 5, 1000), ("profile", 2, True, 5, 4, 3), ("profile", 2, True, 1, 1, 1), ("cited", 1, True, 1, 1, 1), ("cited", 2, False, 1, 1, 1), ("cited", 2, True, None, 1, 24)], "kind string, version int, complete boolean, total long, n_rows long, hours int")
    now = F.expr("timestamp'2024-01-31 00:00:00'")
    entries = rows.withColumn("ts", now - F.expr("make_dt_interval(0, hours)"))
    assert [r["status"] for r in records.cache_status(entries, now).collect()] == ["valid", "expired", "valid", "bad", "bad", "valid"]
    assert records.purge(entries, now).count() == 3


def test_text_filter_and_matches(spark):
    rows = spark.createDataFrame([(1, "müller writes"), (2, "mueller reads"), (3, "miller")], "i int, search_text string").withColumn("search_text", __import__("citelake.functions.text", fromlist=["x"]).search_text(F.col("search_text")))
    assert sorted(r["i"] for r in records.text_filter(rows, "Müller").collect()) == [1, 2]
    assert records.text_filter(rows, "").count() == 3
    parts = "doc int, {} int, arxiv string, doi string, author string, year int, page string, journal string, volume string"
    parsed = spark.createDataFrame([(1, 1, None, None, "Müller", 2000, "5", "J", "1"), (1, 2, "2301.1", None, "x", 1990, None, None, None), (1, 3, None, None, "zz", 1900, None, None, None)], parts.format("ref"))
    entries = spark.createDataFrame([(1, 7, None, None, "Muller", 2001, "5", "J", "1"), (1, 8, "2301.1", None, "y", 2020, None, None, None)], parts.format("entry"))
    assert {(r["ref"], r["entry"], r["score"]) for r in records.best_matches(parsed, entries).collect()} == {(1, 7, 7.5), (2, 8, 10.0)}


def test_creators(spark):
    schema = "item int, pos int, name string"
    local = spark.createDataFrame([(1, 0, "Müller"), (1, 1, "smith"), (1, 2, "Özil")], schema)
    remote = spark.createDataFrame([(1, 0, "Muller"), (1, 1, "Smith"), (1, 2, "Ozil"), (1, 3, "New")], schema)
    got = records.merge_creators(local, remote, ["Smith", ""]).orderBy("pos").collect()
    assert [r["name"] for r in got] == ["Müller", "smith", "Özil", "New"] and [r["kept"] for r in got] == [True, True, True, False]


def test_empty_tables(spark, small):
    links, papers, seeds = (x.limit(0) for x in small)
    for got in (related.related(links, papers, seeds), graph.multi_seed(links, papers, seeds), lists.year_bins(papers, "owner"), lists.spread(papers, "owner")):
        assert got.count() == 0


def test_choose_bins():
    keys = ["a", "b", "c", "d"]
    assert lists.choose_bins([], keys, "b") == ["b"] and lists.choose_bins(["b"], keys, "b") == []
    assert lists.choose_bins(["b"], keys, "a", more=True) == ["a", "b"] and lists.choose_bins(["a", "b"], keys, "a", more=True) == ["b"]
    assert lists.choose_bins(["d"], keys, "c", last="a", upto=True) == ["a", "b", "c"] and lists.choose_bins(["d"], keys, "a", last="b", upto=True, more=True) == ["a", "b", "d"]


def test_axis_range(spark):
    rows = spark.createDataFrame([("a", c) for c in [1, 10]] + [("b", 5), ("c", 0)] + [("d", c) for c in [*range(1, 20), 10_000]], "g string, citation_count long")
    got = {r["g"]: (r["low"], r["high"]) for r in lists.axis_range(rows, "g").collect()}
    assert got["a"] == (1.0, round(10**1.1, 6)) and got["b"] == (round(5 * 10**-0.1, 6), round(5 * 10**0.1, 6)) and "c" not in got and got["d"][1] < 30


@pytest.mark.parametrize("limit", [0, 1024])
def test_best_matches_are_those_of_all_pairs(spark, monkeypatch, limit):
    """Random references and entries with nulls, ties, parts of names and written forms of ids and journals, against every pair of a document."""
    import random

    monkeypatch.setattr(pairs.pairs_of, "__defaults__", (limit,))  # by keys alone, and whole documents
    rng = random.Random(4)
    pick = lambda *x: rng.choice([None, *x])
    journal = ("Phys. Rev. D", "Phys.Rev.D", "Physical Review", "PHYS REV (Ser. D)", "J", "")
    ids = (pick, "2301.12345", "arXiv:2301.12345v2", "2301.54321", "x")
    part = lambda *names: (pick(*ids[1:]), pick("10.1/a", "10.1/A.", "10.1/b"), pick(*names), pick(1999, 2000, 2001, 2003), pick("5", "6", ""), pick(*journal), pick("1", "2", ""))
    schema = "doc int, {} int, arxiv string, doi string, author string, year int, page string, journal string, volume string, {} string"
    lines = ("A. Mull, B. Lin", "Particle Data Group", "x", "", "B. Wu, and O. Mul-Ler")
    parsed = spark.createDataFrame([(i % 7, i, *part("Müller", "Mul-ler", "Mull", "Li", "L", "lin", ""), pick("the data group", "y")) for i in range(150)], schema.format("ref", "raw"))
    entries = spark.createDataFrame([(i % 7, i, *part("Müller, A.", "Muller, B.", "A. Li", "O. Lin", "ATLAS Collaboration", ""), pick(*lines)) for i in range(150)], schema.format("entry", "line"))
    norm = lambda rows, own, p: rows.select("doc", own, *records.normal_parts(rows, own == "ref")).toDF("doc", own, *(p + c for c in ["arxiv", "doi", "author", "year", "page", "journal", "volume", "text"]))
    best = {}
    for r in norm(parsed, "ref", "a_").join(norm(entries, "entry", "b_"), "doc").select("doc", "ref", "entry", records.match_score().alias("score")).collect():
        if r["score"] >= 3:
            best[r["doc"], r["ref"]] = min(best.get((r["doc"], r["ref"]), (0, 0)), (-r["score"], r["entry"]))
    got = {(r["doc"], r["ref"]): (-r["score"], r["entry"]) for r in records.best_matches(parsed, entries).collect()}
    assert got == best and len(got) > 100


def test_match_score_by_the_rules(spark):
    """Ids and journals in other forms, the authors' line, data groups, and pages that differ."""
    cases = [
        (("arXiv:2301.12345v2", None, None, None, None, None, None, None), ("2301.12345", None, None, None, None, None, None, None), 10.0),
        ((None, "10.1/A).", None, None, None, None, None, None), (None, "10.1/a", None, None, None, None, None, None), 9.0),
        ((None, None, None, None, None, "Phys. Rev. D", "5", None), (None, None, None, None, None, "Phys.Rev.D", "5", None), 4.0),
        ((None, None, None, None, "12", "Phys. Rev. D", "5", None), (None, None, None, None, "13", "Phys.Rev.D", "5", None), 0.0),
        ((None, None, None, None, "12", "Other", "5", None), (None, None, None, None, "12", "Phys.Rev.D", "5", None), 6.0),
        ((None, None, None, None, "12", None, "5", None), (None, None, None, None, "12", "Phys.Rev.D", "5", None), 2.0),
        ((None, None, "Lin", 2000, None, None, None, None), (None, None, "Wu, A.", 2001, None, None, None, "A. Wu, B. Lin"), 3.5),
        ((None, None, None, 2000, None, None, None, "Particle Data Group"), (None, None, "Wu, A.", 2003, None, None, None, "Particle data group"), 2.5),
        ((None, None, "Van-Hove", None, None, None, None, None), (None, None, "van Hove, L.", None, None, None, None, None), 4.0),
    ]
    schema = "arxiv string, doi string, author string, year int, page string, journal string, volume string, {} string, k int"
    a = spark.createDataFrame([(*x, i) for i, (x, _, _) in enumerate(cases)], schema.format("raw"))
    b = spark.createDataFrame([(*y, i) for i, (_, y, _) in enumerate(cases)], schema.format("line"))
    names = ["arxiv", "doi", "author", "year", "page", "journal", "volume", "text"]
    left = a.select("k", *records.normal_parts(a, True)).toDF("k", *("a_" + c for c in names))
    right = b.select("k", *records.normal_parts(b, False)).toDF("k", *("b_" + c for c in names))
    got = {r["k"]: r["score"] for r in left.join(right, "k").select("k", records.match_score().alias("score")).collect()}
    assert got == {i: s for i, (_, _, s) in enumerate(cases)}


@pytest.mark.parametrize("limit", [0, 1024])
def test_author_year_pairs_are_complete(spark, monkeypatch, limit):
    """No entry that scores LEAST or more with a citation is left unpaired."""
    import random

    from citelake.operators import matching as G

    monkeypatch.setattr(pairs.pairs_of, "__defaults__", (limit,))
    rng = random.Random(6)
    names = ["Li", "O", "Sjöstrand, T.", "Sjostrand", "Strand", "Bahr, A.", "王"]
    some = lambda: [rng.choice(names) for _ in range(rng.randrange(4))]
    year = lambda: rng.choice([None, "1999", "2000a", "2001", "x"])
    cited = spark.createDataFrame([(i % 5, i, some(), year(), rng.random() < 0.3) for i in range(100)], "doc int, citation int, authors array<string>, year string, et_al boolean")
    listed = spark.createDataFrame([(i % 5, i, some(), year()) for i in range(100)], "doc int, entry int, authors array<string>, year string")
    targets, own = F.transform("authors", lambda a: G.T.fold(a)), F.transform("authors", lambda a: G.T.fold(G.A.last_name(a)))
    a = cited.select("doc", "citation", targets.alias("t"), F.col("year").alias("y"), "et_al")
    b = listed.select("doc", "entry", own.alias("n"), F.col("year").alias("ey"))
    every = a.join(b, "doc").select("doc", "citation", "entry", G.author_year_score(F.col("t"), F.col("y"), F.col("et_al"), F.col("n"), F.col("ey")).alias("s")).select("doc", "citation", "entry", "s.*").filter(F.col("score") >= G.LEAST).collect()
    best = {}
    for r in every:
        best.setdefault((r["doc"], r["citation"]), []).append(r)
    want = set()
    for key, rows in best.items():
        rows = [r for r in rows if r["year_matched"]] or rows
        top = max(r["score"] for r in rows)
        rows = sorted((r for r in rows if r["score"] >= top - G.WITHIN), key=lambda r: (-r["score"], r["entry"]))[: G.GIVEN]
        want |= {(*key, r["entry"], r["score"]) for r in rows}
    assert {(r["doc"], r["citation"], r["entry"], r["score"]) for r in G.author_year_matches(cited, listed).collect()} == want and len(want) > 50


def test_sort_list_and_merged_rows(spark):
    rows = spark.createDataFrame([paper(i, cites=c, year=y) for i, (c, y) in enumerate([(5, "2001"), (5, "1999"), (None, "x"), (9, "2001"), (5, "2000")])], COLUMNS)
    got = lambda by: [r["recid"] for r in lists.sort_list(rows, "owner", by).orderBy("rank").collect()]
    assert got("cites") == [3, 0, 1, 4, 2] and got("year") == [0, 3, 4, 1, 2]
