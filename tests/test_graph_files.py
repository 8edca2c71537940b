"""Graph documents, their CSV, and searches by conditions."""

import json

import pytest
from pyspark.sql import functions as F

from citelake.operators import search
from citelake.sources import files
from citelake.sources import graph_files as G


def table(spark):
    node = "graph int, place int, recid string, kind string, title string, authorLabel string, year string, citationCount long, localItemID long, recordUrl string, arxivId string, doi string"
    rows = [(1, 0, "10", "seed", "S, \"one\"", "A", "2001", 5, 7, None, None, None), (1, 0, "20", "reference", None, None, "1999", 3, None, "u", "hep-th/1", "10.1/x"), (1, 1, "10", "reference", "again", None, None, None, None, None, None, None), (1, 0, "30", "citedBy", "C\nc", None, None, None, None, None, None, None),
            (1, 1, None, "citedBy", "none", None, None, None, None, None, None, None), (2, 0, "10", "seed", "ü", None, None, None, None, None, None, None)]
    edges = [(1, "10", "20", "seed-to-reference"), (1, "10", "20", "seed-to-reference"), (1, "30", "10", "cited-by-to-seed"), (1, None, "10", "seed-to-seed")]
    settings = [(1, "2024-01-02", "relevance"), (2, "2024-01-03", None), (3, "2024-01-04", None)]
    return G.graph_documents(spark.createDataFrame(rows, node), spark.createDataFrame(edges, "graph int, source string, target string, type string"), spark.createDataFrame(settings, "graph int, createdAt string, sort string"))


def lines(path):
    import glob

    return sorted(x for p in glob.glob(f"{path}/part-*") for x in open(p, encoding="utf-8").read().splitlines())


def test_save_reload_save(spark, tmp_path):
    G.write_graphs(table(spark), f"{tmp_path}/a")
    first = lines(f"{tmp_path}/a")
    assert len(first) == 2 and json.loads(first[0])["seeds"] == [{"recid": "10", "title": 'S, "one"', "localItemID": 7}] and len(json.loads(first[0])["graph"]["nodes"]) == 3
    extra = [json.dumps(json.loads(first[0]) | {"viewState": {"panX": 1.5}, "new": [1, "ü"]}, ensure_ascii=False), "broken {", "[1]"]
    old = json.dumps({"version": "0", "createdAt": "2020", "nodes": [{"recid": 1, "kind": "seed"}, {"recid": 2, "kind": "reference", "title": "T"}], "edges": [{"source": 1, "target": 2, "type": "reference"}], "sort": "odd", "kept": True})
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "part-0").write_text("\n".join([*extra, old]), encoding="utf-8")
    G.write_graphs(G.read_graphs(spark, f"{tmp_path}/b"), f"{tmp_path}/c")
    second = lines(f"{tmp_path}/c")
    G.write_graphs(G.read_graphs(spark, f"{tmp_path}/c"), f"{tmp_path}/d")
    assert lines(f"{tmp_path}/d") == second and len(second) == 2
    docs = [json.loads(x) for x in second]
    newest, oldest = sorted(docs, key=lambda d: d["createdAt"], reverse=True)
    assert newest == json.loads(extra[0])
    assert oldest == {"version": "1", "createdAt": "2020", "seeds": [{"recid": "1", "title": "1"}], "graph": {"nodes": [{"recid": "1", "kind": "seed"}, {"recid": "2", "kind": "reference", "title": "T"}], "edges": [{"source": "1", "target": "2", "type": "seed-to-reference"}]}, "settings": {"sort": "mostcited"}, "kept": True}
    back = G.read_graphs(spark, f"{tmp_path}/a")
    assert {(r["seed"], tuple(r["references"]), tuple(r["cited_by"])) for r in G.by_seed(back).collect()} == {("10", ("20",), ("30",)), ("10", (), ())}
    assert [r["createdAt"] for r in G.recent(back, 1).collect()] == ["2024-01-03"]


def test_csv(spark, tmp_path):
    nodes = G.nodes_of(table(spark).filter("graph = 1"))
    got = {r["l"] for r in nodes.select(files.csv_line(*map(F.col, files.GRAPH_COLUMNS)).alias("l")).collect()}
    assert got == {'10,seed,"S, ""one""",2001,5,7,,,', "20,reference,20,1999,3,,u,10.1/x,hep-th/1", '30,citedBy,"C\nc",,,,,,'}
    files.write_graph_csv(nodes.filter("recid <> '30'").coalesce(1), f"{tmp_path}/x")
    assert lines(f"{tmp_path}/x") == sorted(["recid,kind,title,year,citationCount,localItemID,recordUrl,doi,arxivId", *(x for x in got if not x.startswith("30"))])


def test_search(spark, tmp_path):
    rows = [(1, "article", "Müller writes", 2000), (2, "book", None, 1990), (3, "article", "muller reads", None), (4, None, "x", 2001)]
    spark.createDataFrame(rows, "item_id int, kind string, title string, year int").write.parquet(f"{tmp_path}/i")
    items = spark.read.parquet(f"{tmp_path}/i")
    ids = lambda tree, n=None: sorted(r["item_id"] for r in search.search(items, tree, n).collect())
    assert ids(("title", "contains", "MÜLLER")) == [1, 3] and ids(("title", "containsExactly", "ller")) == [1, 3] and ids(("title", "doesNotContain", "muller")) == [2, 4]
    assert ids(("all", ("kind", "is", "article"), ("year", "isGreaterThan", 1999))) == [1] and ids(("any", ("year", "isEmpty"), ("kind", "in", ["book"]))) == [2, 3]
    assert ids(("not", ("kind", "is", "article"))) == [2, 4] and ids(("kind", "isNot", "article")) == [2, 4] and ids(("all",)) == [1, 2, 3, 4] and ids(("any",)) == []
    assert ids(("all",), 2) == [1, 2]
    with pytest.raises(ValueError):
        search.predicate(("kind", "like", "x"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = search.search(items, ("all", ("kind", "is", "article"), ("title", "beginsWith", "M"), ("any", ("year", "isLessThan", 1995), ("year", "isGreaterThan", 1999)), ("title", "contains", "u")))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: [")[1].split("], ReadSchema")[0]
    assert all(x in pushed for x in ("EqualTo(kind,article)", "StringStartsWith(title,M)", "Or(LessThan(year,1995),GreaterThan(year,1999))"))
