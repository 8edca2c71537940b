"""Expressions that compute their parts once, and tables that aren't read without need."""

import os

import pytest
from pyspark.sql import functions as F

from citelake.functions.places import bound, matches_at
from citelake.operators import bibliography, funding
from citelake.sources import tables

DATA = "/root/testdata/sf0.001"


def patterns(column, spark):
    """How many patterns the plan of a column of texts holds."""
    plan = spark.createDataFrame([("x",)], "text string").select(column.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    return sum(plan.count(x) for x in ("regexp_extract_all(", "regexp_replace(", "split(", "RLIKE"))


def test_matches_at(spark):
    rows = spark.createDataFrame([("ab12c345",), ("none",), ("",), (None,), ("7",)], "t string").select(matches_at(F.col("t"), "([0-9])[0-9]*").alias("m")).collect()
    assert [None if r.m is None else [tuple(x) for x in r.m] for r in rows] == [[(2, 2, "1"), (5, 3, "3")], [], [], None, [(0, 1, "7")]]
    assert patterns(matches_at(F.col("text"), "([0-9]+)"), spark) == 2  # was 4 and more


def test_bound(spark):
    assert spark.range(1).select(bound(F.rand(), lambda x: x == x).alias("same")).first().same


def test_words_are_cut_once(spark):
    """Where a name is sought, words aren't cut again at each word."""
    assert patterns(bibliography.author_in(F.col("text")), spark) < 20
    assert patterns(funding.searched(F.col("text")), spark) < 8


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
def test_papers_read_what_is_asked_for(spark):
    few = tables.papers(spark, DATA, "recid", "owner", "year")
    assert few.columns == ["recid", "owner", "year"] and len(few.inputFiles()) == 1
    whole = {r.recid: r for r in tables.papers(spark, DATA).collect()}
    for columns in (["recid", "title"], ["recid", "citation_count"], ["recid", "journal_title"], ["recid", "total_authors"]):
        assert all(r[1] == whole[r[0]][columns[1]] for r in tables.papers(spark, DATA, *columns).collect())


def test_rows_of_a_graph_are_moved_once(spark):
    import re

    from citelake.sources import graph_files as G

    nodes = spark.createDataFrame([], f"graph long, place int, {G._NODE}")
    edges = spark.createDataFrame([], "graph long, source string, target string, type string")
    plan = G.graph_documents(nodes, edges, spark.createDataFrame([], "graph long, createdAt string, sort string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(graph#\w+, (?:recid|e)#", plan)


def test_pairs_are_whole_rows(spark):
    from citelake.operators.pairs import pairs_of

    a, b = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "doc int, ref int, k string"), spark.createDataFrame([(1, 7, "y"), (2, 8, "x")], "doc int, entry int, m string")
    for small, want in ((9, [(1, 1, "x", 7, "y"), (1, 2, "y", 7, "y")]), (0, [(1, 2, "y", 7, "y")])):
        assert sorted(map(tuple, pairs_of(a, b, ["ref", "entry"], F.array("k"), F.array("m"), small).collect())) == want
