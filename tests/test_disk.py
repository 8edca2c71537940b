"""What queries write and move: it fills the disk where tables are large."""

import os

import pytest
from pyspark.sql import functions as F

from citelake.plans import registry
from citelake.sources import graph_files as G
from citelake.sources import shared, tables

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


def bytes_of(path):
    names = [os.path.join(path.removeprefix("file://"), x) for x in os.listdir(path.removeprefix("file://"))]
    return sum(os.path.getsize(x) for x in names), [x for x in names if os.path.basename(x).startswith("part-")]


def test_saved_graphs_are_small_and_deleted(spark, tmp_path):
    before = shared.written(spark)
    got = registry.QUERIES["graph_saved_and_read"](spark, DATA)
    (path,) = set(shared.written(spark)) - set(before)
    n, parts = bytes_of(path)
    assert parts and all(x.endswith(".gz") for x in parts)
    G.write_graphs(G.read_graphs(spark, path), f"{tmp_path}/plain")
    plain = spark.read.text(f"{tmp_path}/plain").agg(F.sum(F.length("value"))).first()[0]
    assert got.count() > 7000 and 5 * n < plain
    shared.clean_up(spark, before)
    assert not os.path.exists(path.removeprefix("file://"))


def test_counts_alone_meet_no_papers(spark):
    plan = lambda *columns: tables.papers(spark, DATA, *columns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("recid", "citation_count").count("Join ") == 1 and plan("recid", "citation_count_wo_self").count("Join ") == 3


def test_placed_graphs_are_the_same(spark):
    nodes = spark.createDataFrame([(1, 0, "10", "seed"), (1, 1, "20", "reference"), (1, 2, "20", "citedBy"), (2, 0, "20", "seed")], "graph int, place int, recid string, kind string")
    nodes = nodes.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in G._NODE.split(", ")) if c not in nodes.columns))
    edges = spark.createDataFrame([(1, "10", "20", "seed-to-reference")] * 2, "graph int, source string, target string, type string")
    settings = spark.createDataFrame([(1, "2024-01-02", "relevance"), (2, "2024-01-03", None)], "graph int, createdAt string, sort string")
    want = sorted(map(str, G.graph_documents(nodes, edges, settings).collect()))
    assert len(want) == 2 and sorted(map(str, G.graph_documents(nodes.repartition("graph"), edges.repartition("graph"), settings, placed=True).collect())) == want


def test_joined_in_place_moves_nothing(spark):
    from citelake.operators.pairs import joined_in_place

    rows = lambda name, n: spark.range(n).select((F.col("id") % 5).alias("doc"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("key"), F.col("id").alias(name)).repartition("doc")
    a, b = rows("x", 60), rows("y", 40).filter("key IS NOT NULL")
    got = joined_in_place(a, b, ["doc", "key"])
    assert got.columns == ["doc", "key", "x", "y"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, a.join(b, ["doc", "key"]).collect())) != []
    plan = joined_in_place(a, b, ["doc", "key"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2


@pytest.mark.parametrize("placed", [False, True])
def test_author_year_entries_write_what_is_decided_alone(spark, placed):
    from citelake.operators import author_year as AY

    n = spark.range(40).select((F.col("id") % 6).alias("doc"), F.col("id").alias("k"), (F.col("id") % 4).alias("c")).repartition("doc")
    cited = n.selectExpr("doc", "k AS citation", "array(concat('name', k)) AS authors", "cast(map() AS map<string,string>) AS initials", "CASE WHEN c = 1 THEN '2001a' ELSE '2001' END AS year", "false AS et_al")
    read = n.filter("c < 3").selectExpr("doc", "k AS ref", "array(concat('Name', k)) AS authors", "CASE WHEN c = 1 THEN '2001a' ELSE '2001' END AS year", "'' AS raw", "cast(null AS string) AS arxiv", "CASE WHEN c < 2 THEN concat('10.1/X', k) END AS doi", "'' AS journal", "'' AS volume", "'' AS page")
    listed = n.selectExpr("doc", "k AS entry", "array(concat('Name', k)) AS authors", "cast(null AS string) AS line", "'2001' AS year", "'' AS arxiv", "concat('10.1/x', k) AS doi", "'' AS journal", "'' AS volume", "'' AS page")
    before = set(shared.written(spark))
    got = {(r.citation, r.entry, r.by) for r in AY.author_year_entries(cited, read, listed, **({"placed": True} if placed else {})).collect()}
    assert {(k, "precise" if k % 4 < 2 else "fuzzy") for k in range(40)} == {(k, by) for k, e, by in got if k == e}
    assert len(set(shared.written(spark)) - before) == 3  # what is decided, and twice which documents are large


def test_candidates_go_to_their_seed_with_ranks_alone(spark):
    import math
    import re

    from citelake.operators import related

    papers = spark.range(60).selectExpr("id AS recid", "concat('t', id) AS title", "CAST(2000 + id % 5 AS string) AS year", "id % 9 + 5 AS citation_count", "id % 9 + 5 AS citation_count_wo_self", "'J' AS journal_title", "array(CASE WHEN id % 10 = 7 THEN 'review' ELSE 'article' END) AS document_type")
    pairs = {(a, b) for a in range(60) for b in range(12) if a != b and (a * 7 + b * b) % 5 < 2}
    links, seeds = spark.createDataFrame(sorted(pairs), "citing long, cited long"), spark.range(0, 60, 6).withColumnRenamed("id", "seed")
    out = related.coupling(links, papers, seeds)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(seed#\w+, \w+#", plan) and not re.search(r"hashpartitioning\(recid#\w+, seed#", plan)
    review, cites = (lambda x: x % 10 == 7), (lambda x: x % 9 + 5)
    want = {}
    for s in range(0, 60, 6):
        near = lambda r: (round(abs(math.log10(cites(r) + 1) - math.log10(51)), 12), r)
        anchors = sorted((b for a, b in pairs if a == s and not review(b)), key=near)[:15]
        weight = {r: 1 / (1 + math.log1p(cites(r))) for r in anchors}
        by = {r: sorted((a for a, b in pairs if b == r), key=lambda a: (-cites(a), a))[:25] for r in anchors}
        for c in {a for r in anchors for a in by[r]}:
            if c != s and (s, c) not in pairs and not review(c):
                met = [r for r in anchors if c in by[r]]
                want[s, c] = len(met), round(sum(weight[r] for r in met) / max(0.0001, sum(weight.values())), 6), " | ".join(f"t{r}" for r in met[:3]), cites(c), 2000 + c % 5
    got = {(r.seed, r.recid): (r.shared, round(r.coupling, 6), r.shared_titles, r.cites, r.year) for r in out.collect()}
    assert got == want and len(want) > 100
