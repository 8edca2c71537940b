"""Queries on single rules of matching, filters and readers, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.functions import markers as M
from citelake.functions import papers as P
from citelake.functions import titles
from citelake.operators import entries as E
from citelake.operators import library as L
from citelake.operators import lists, matching
from citelake.operators import metadata as MD
from citelake.sources import files, merged, tables
from citelake.sources.tables import SQL

from .citations import query


def _table(spark, d, name):
    return tables.table(spark, d, name)


@query("tag_names", "SELECT DISTINCT n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 = 0")
def tag_names(spark, d):
    items = _table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("item_id"), F.col("c_nationkey").alias("tag_id"))
    return L.tag_names(items.select("item_id"), items, _table(spark, d, "nation").select(F.col("n_nationkey").alias("tag_id"), F.col("n_name").alias("name")))


_REFS = "SELECT l_orderkey AS citing, l_partkey AS cited, l_suppkey % 20 AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ordinal FROM lineitem"


@query("reference_lists", f"SELECT citing, ordinal, CASE WHEN label % 4 <> 0 THEN cited END AS cited, CAST(label AS VARCHAR) AS label FROM ({_REFS})")
def reference_lists(spark, d):
    line = _table(spark, d, "lineitem").selectExpr("l_orderkey AS recid", "struct(l_linenumber AS n, l_partkey AS p, l_suppkey AS s) AS x")
    record = lambda x: F.struct(F.when(x["s"] % 20 % 4 != 0, F.concat(F.lit("https://x/api/literature/"), x["p"].cast("string"), F.when(x["p"] % 2 == 0, "/").otherwise(""))).alias("record"), (x["s"] % 20).cast("string").alias("label"))
    records = line.groupBy("recid").agg(F.transform(F.sort_array(F.collect_list("x")), record).alias("references"))
    return files.references_of(records).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("complete_records", "SELECT o_orderkey AS recid, o_orderkey % 4 <> 0 AND (o_custkey % 3 <> 0 OR o_custkey % 5 = 0) AND o_orderkey % 7 <> 0 AS complete FROM orders")
def complete_records(spark, d):
    o = _table(spark, d, "orders").selectExpr(
        "o_orderkey AS recid", "CASE o_orderkey % 4 WHEN 0 THEN array(named_struct('title', '')) ELSE array(named_struct('title', 'T')) END AS titles", "CASE WHEN o_custkey % 3 <> 0 THEN array('A') ELSE cast(array() AS array<string>) END AS authors",
        "CASE WHEN o_custkey % 5 = 0 THEN array('C') END AS collaborations", "CASE WHEN o_orderkey % 7 <> 0 THEN 0 END AS citation_count")
    return o.select("recid", E.is_complete().alias("complete"))


@query("papers_in_own_bins", SQL + ", b AS (SELECT owner, min(CAST(year AS INT)) AS low, max(CAST(year AS INT)) AS high FROM papers GROUP BY owner) SELECT recid FROM papers JOIN b USING (owner) WHERE CAST(year AS INT) IN (low, low + 1, high)")
def papers_in_own_bins(spark, d):
    p = tables.papers(spark, d)
    ends = p.groupBy("owner").agg(F.min(F.col("year").cast("int")).alias("low"), F.max(F.col("year").cast("int")).alias("high"))
    bins = ends.select("owner", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), a.alias("first"), b.alias("last")) for k, a, b in (("early", F.col("low"), F.col("low") + 1), ("mid", F.col("low") + 2, F.col("high") - 1), ("late", F.col("high"), F.col("high")))))).alias("b")).select("owner", "b.*")
    return lists.in_bins(p, bins, lists.choose_bins(["early"], ["early", "mid", "late"], "late", more=True), "owner").select("recid")


#: Two written forms of a journal by a part's number, and their keys in SQL.
_A = "concat('Phys. Rev. ', substr('ABCDE', cast(p_partkey % 5 as {i}) + 1, 1), CASE WHEN p_partkey % 3 = 0 THEN ' (Ser. 2)' ELSE '' END)"
_B = "concat(CASE p_partkey % 4 WHEN 0 THEN 'PHYS.REV.' WHEN 1 THEN 'Phys Rev ' WHEN 2 THEN 'Phys. ' ELSE 'Nucl. Phys. ' END, substr('ABCDE', cast(p_size % 5 as {i}) + 1, 1))"


def _key(x: str) -> str:
    return f"nullif(regexp_replace(lower(regexp_replace({x.format(i='INT')}, '\\s*\\([^)]*\\)', ' ', 'g')), '[^a-z0-9]+', '', 'g'), '')"


@query("journals_similar", f"WITH k AS (SELECT p_partkey AS part, {_key(_A)} AS a, {_key(_B)} AS b FROM part) SELECT part, a AS key, a = b OR (least(length(a), length(b)) >= 6 AND left(a, least(length(a), length(b)) - 2) = left(b, least(length(a), length(b)) - 2)) AS same FROM k")
def journals_similar(spark, d):
    a, b = (F.expr(x.format(i="int")) for x in (_A, _B))
    return _table(spark, d, "part").select(F.col("p_partkey").alias("part"), matching.journal_key(a).alias("key"), matching.journals_similar(a, b).alias("same"))


_Y = "concat(1950 + o_custkey % 70, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'B' ELSE '' END)"


@query("years_and_markup", f"SELECT o_orderkey AS recid, CAST(1950 + o_custkey % 70 AS VARCHAR) AS year, o_custkey % 4 < 3 AS latex, o_custkey % 5 < 4 AS marked FROM orders")
def years_and_markup(spark, d):
    formula = F.expr("concat('On ', CASE o_custkey % 4 WHEN 0 THEN '$x_2$ here' WHEN 1 THEN '\\\\alpha decay' WHEN 2 THEN '\\\\(y' ELSE 'cost 5$ or x' END)")
    text = F.expr(f"concat('as ', CASE o_custkey % 5 WHEN 0 THEN '[3, 5-7]' WHEN 1 THEN 'Smith et al. (2001)' WHEN 2 THEN 'said¹²' WHEN 3 THEN '[{1}]' ELSE '(see 2) in 2001' END)")
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("recid"), P.base_year(F.expr(_Y)).alias("year"), titles.has_latex(formula).alias("latex"), M.has_markers(text).alias("marked"))


@query("publication_rules", """WITH x AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey % 3 AS j, l_suppkey % 3 AS v, l_linenumber % 3 AS p, l_partkey % 5 AS y, l_suppkey % 4 < 2 AS a, l_orderkey % 11 = 0 AS ax, l_orderkey % 13 = 0 AS d FROM lineitem)
SELECT id, n, (j = 1 AND v = 1 AND p <> 0) OR (v = 1 AND p = 1) AS matches, CASE WHEN j = 1 THEN 1 ELSE 0 END + CASE WHEN v = 1 THEN 2 ELSE 0 END + CASE WHEN p = 1 THEN 2 ELSE 0 END + CASE WHEN v = 1 AND p = 1 THEN 1 ELSE 0 END AS priority,
  CASE WHEN ax THEN 'arxiv' WHEN d THEN 'doi' WHEN v = 1 AND a AND (p = 1 OR y <= 3) THEN 'journal' END AS kind, CASE WHEN ax THEN 10 WHEN d THEN 9 WHEN v = 1 AND a AND (p = 1 OR y <= 3) THEN 6 + CASE WHEN j = 1 THEN 2 ELSE 0 END + CASE WHEN p = 1 THEN 2 ELSE 0 END + CASE WHEN y <= 3 THEN 1 ELSE 0 END END AS score FROM x""")
def publication_rules(spark, d):
    """Of the value k % 3: 0 different, 1 equal, 2 missing."""
    equal = lambda c: F.expr(f"CASE {c} % 3 WHEN 0 THEN false WHEN 1 THEN true END")
    j, v, p = equal("l_partkey"), equal("l_suppkey"), equal("l_linenumber")
    strong = matching.strong_match(F.expr("l_suppkey % 4 < 2"), j, v, p, F.expr("l_partkey % 5"), F.expr("l_orderkey % 11 = 0"), F.expr("l_orderkey % 13 = 0"))
    out = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), matching.publication_matches(j, v, p).alias("matches"), matching.publication_priority(j, v, p).alias("priority"), strong.alias("s"))
    return out.select("id", "n", "matches", "priority", F.col("s.kind").alias("kind"), F.col("s.score").alias("score"))


_ITEMS = """SELECT o_orderkey AS item_id, CASE o_orderkey % 3 WHEN 0 THEN 'journalArticle' WHEN 1 THEN 'book' ELSE 'preprint' END AS item_type, o_orderpriority AS title, CASE o_custkey % 3 WHEN 0 THEN 'arXiv:1' WHEN 1 THEN o_orderstatus END AS journal,
  CASE WHEN o_custkey % 2 = 0 THEN concat('note', {n}, 'arXiv:old', {n}, 'end') END AS extra, CASE WHEN o_custkey % 4 = 0 THEN 'http://own' END AS url FROM orders"""
_WRITTEN = f"""WITH i AS ({_ITEMS.format(n='chr(10)')}), m AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 4 = 0 THEN 'book' ELSE 'article' END AS kind, CASE WHEN o_custkey % 5 > 0 THEN 'T' || o_custkey END AS title, CASE WHEN o_orderkey % 5 > 1 THEN 'J' || o_orderkey % 9 END AS j, CASE WHEN o_custkey % 7 > 3 THEN '2301.' || (10000 + o_custkey) END AS arxiv, o_custkey % 6 > 2 AS has_doi FROM orders WHERE o_orderkey % 2 = 0)
SELECT i.item_id, coalesce(m.title, i.title) AS title, CASE WHEN m.item_id IS NULL THEN i.journal WHEN j IS NULL THEN CASE WHEN arxiv IS NOT NULL AND i.journal = 'arXiv:1' THEN NULL ELSE i.journal END WHEN item_type = 'journalArticle' THEN CASE WHEN i.journal IS NULL OR i.journal = 'arXiv:1' THEN j ELSE i.journal END WHEN item_type = 'book' AND kind = 'book' THEN i.journal ELSE j END AS journal,
  CASE WHEN arxiv IS NULL THEN i.extra WHEN i.extra IS NULL THEN 'arXiv:' || arxiv || ' [hep-ph]' ELSE 'note' || chr(10) || 'end' || chr(10) || 'arXiv:' || arxiv || ' [hep-ph]' END AS extra,
  CASE WHEN m.item_id IS NULL THEN i.url WHEN item_type = 'book' AND has_doi THEN 'https://doi.org/10.1/' || i.item_id ELSE coalesce(i.url, CASE WHEN arxiv IS NOT NULL THEN 'https://arxiv.org/abs/' || arxiv END) END AS url FROM i LEFT JOIN m USING (item_id)"""


def _items(spark, d):
    own = ["item_type", "title", "journal", "extra", "url"]
    text = _ITEMS.format(n="'\\n'")
    _table(spark, d, "orders").createOrReplaceTempView("_orders_of_items")
    items = spark.sql(text.replace("FROM orders", "FROM _orders_of_items"))
    meta = _table(spark, d, "orders").filter("o_orderkey % 2 = 0").selectExpr(
        "o_orderkey AS item_id", "CASE WHEN o_orderkey % 4 = 0 THEN 'book' ELSE 'article' END AS document_type", "CASE WHEN o_custkey % 5 > 0 THEN concat('T', o_custkey) ELSE '' END AS title", "CASE WHEN o_orderkey % 5 > 1 THEN concat('J', o_orderkey % 9) END AS journal_abbreviation",
        "CASE WHEN o_custkey % 7 > 3 THEN concat('2301.', 10000 + o_custkey) END AS arxiv", "'hep-ph' AS category", "CASE WHEN o_custkey % 7 > 3 THEN concat('https://arxiv.org/abs/2301.', 10000 + o_custkey) END AS arxiv_url", "CASE WHEN o_custkey % 6 > 2 THEN concat('10.1/', o_orderkey) END AS doi",
    )
    null = lambda rows, names: rows.select("item_id", *(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names))
    return null(items, MD.ITEM_FIELDS), null(meta, MD.META_FIELDS), ["item_id", *own[1:]]


@query("metadata_written", _WRITTEN)
def metadata_written(spark, d):
    items, meta, shown = _items(spark, d)
    return MD.with_metadata(items, meta).select(*shown)


@query("metadata_merged", _WRITTEN)
def metadata_merged(spark, d):
    """The same as a table that is made, merged into twice, and read."""
    import uuid

    from citelake.sources.shared import shared_dir

    items, meta, shown = _items(spark, d)
    path = f"{shared_dir(spark)}/merged-{uuid.uuid4().hex}"
    merged.create(items, path, "item_id")
    for _ in range(2):
        merged.merge(meta, path, MD.metadata_columns(), insert=False)
    return merged.read(spark, path).select(*shown)
