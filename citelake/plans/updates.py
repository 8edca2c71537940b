"""Queries on updates of items, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.operators import updates as U
from citelake.sources import tables
from citelake.sources.tables import SQL

from .citations import query


def orders(spark, d):
    return tables.table(spark, d, "orders")


@query("publication_status", """SELECT o_orderkey AS recid, o_orderkey % 5 IN (1, 2, 4) AS published,
  CASE o_orderkey % 5 WHEN 1 THEN 'Phys. Rev. D' WHEN 2 THEN 'J. High ' || o_orderstatus WHEN 4 THEN 'Plain' END AS journal, CASE WHEN o_orderkey % 5 IN (1, 2, 4) THEN CAST(o_custkey % 90 AS VARCHAR) END AS volume,
  CASE o_orderkey % 5 WHEN 1 THEN CAST(o_orderkey % 700 AS VARCHAR) WHEN 2 THEN 'A' || o_orderkey WHEN 4 THEN 'A' || o_orderkey END AS page, CASE WHEN o_orderkey % 5 IN (1, 2, 4) THEN year(o_orderdate) END AS year,
  CASE WHEN o_orderkey % 5 IN (1, 2, 4) AND o_orderkey % 3 <> 0 THEN '10.1/' || o_orderkey END AS doi FROM orders""")
def publication_status(spark, d):
    row = lambda title, page, material: f"named_struct('journal_title', {title}, 'journal_volume', cast(o_custkey % 90 as string), 'artid', concat('A', o_orderkey), 'page_start', {page}, 'year', year(o_orderdate), 'material', {material})"
    none, text = "cast(null as string)", lambda x: f"cast({x} as string)"
    erratum = row(text("'J.Err.'"), text("'1'"), text("'erratum'"))
    real = row("CASE o_orderkey % 5 WHEN 1 THEN 'Phys.Rev.D' WHEN 2 THEN concat('J. High ', o_orderstatus) ELSE 'Plain' END", "CASE o_orderkey % 5 WHEN 1 THEN cast(o_orderkey % 700 as string) WHEN 2 THEN '' END", none)
    free = row(none, none, none)
    infos = F.expr(f"CASE o_orderkey % 5 WHEN 0 THEN array({free}, {erratum}) WHEN 1 THEN array({erratum}, {real}) WHEN 2 THEN array({free}, {real}) WHEN 4 THEN array({real}, {erratum}) END")
    dois = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN array(named_struct('value', concat('10.48550/arXiv.', o_orderkey))) ELSE array(named_struct('value', '10.48550/arXiv.1'), named_struct('value', concat('10.1/', o_orderkey))) END")
    return U.publication_of(orders(spark, d).select(F.col("o_orderkey").alias("recid"), infos.alias("publication_info"), dois.alias("dois")))


@query("preprint_checks", "SELECT event_id, event_id % 9 <> 0 AND epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts) < 24 * 3600000000 AS fresh FROM events")
def preprint_checks(spark, d):
    checked = F.when(F.col("event_id") % 9 != 0, F.col("ts").cast("timestamp"))
    return tables.table(spark, d, "events").select("event_id", U.is_fresh(checked, F.expr("timestamp'2024-01-15 12:00:00 UTC'")).alias("fresh"))


@query("journals_shown", SQL + "SELECT recid, CASE WHEN journal_title <> '' THEN journal_title WHEN arxiv_id IS NOT NULL AND recid % 4 <> 0 THEN CASE recid % 3 WHEN 0 THEN 'arXiv:hep-th/' || arxiv_id WHEN 1 THEN 'arXiv:' || arxiv_id || ' [hep-ph]' ELSE 'arXiv:' || arxiv_id END END AS journal FROM papers")
def journals_shown(spark, d):
    arxiv = F.expr("CASE WHEN recid % 3 = 0 THEN concat('hep-th/', arxiv_id) ELSE arxiv_id END")
    category, kind = F.expr("CASE WHEN recid % 3 < 2 THEN 'hep-ph' END"), F.expr("CASE WHEN recid % 4 = 0 THEN 'book' ELSE 'journalArticle' END")
    return tables.papers(spark, d).select("recid", U.effective_journal(F.col("journal_title"), arxiv, category, kind).alias("journal"))


#: A local list of authors by an order's number, the remote one, and whether they agree.
_LISTS = [
    ([("Ulf-G.", "Meißner"), ("A.", "Smith")], [("Ulf G.", "Meissner"), ("A.", "Smith"), ("B.", "Jones")], True),
    ([("J. R.", "Pelaez")], [("J.R.", "Peláez")], True), ([("J.", "Müller")], [("J.", "Mueller")], True), ([("A.", "Smith"), ("", "others")], [("A.", "Smith"), ("B.", "X")], True),
    ([("A.", "Smith")], [("B.", "Smith")], False), ([("A.", "Smith"), ("C.", "Wu")], [("A.", "Smith"), ("C.", "Wo")], False), ([("", "ATLAS Collaboration")], [("A.", "Smith")], True), ([], [("A.", "Smith")], False), ([], [], True),
]


@query("author_lists", f"SELECT o_orderkey AS recid, [{', '.join(str(x).lower() for *_, x in _LISTS)}][CAST(o_orderkey % {len(_LISTS)} AS INT) + 1] AS agree FROM orders")
def author_lists(spark, d):
    people = lambda own: "array(" + ", ".join(f"named_struct('first', '{a}', 'last', '{b}')" for a, b in own) + ")" if own else "cast(array() as array<struct<first:string,last:string>>)"
    pick = lambda k: F.expr("CASE " + " ".join(f"WHEN o_orderkey % {len(_LISTS)} = {i} THEN {people(x[k])}" for i, x in enumerate(_LISTS)) + " END")
    return orders(spark, d).select(F.col("o_orderkey").alias("recid"), U.author_lists_equal(pick(0), pick(1)).alias("agree"))


@query("protected_names", "SELECT c_custkey AS id, contains('fam' || (c_custkey % 50), 'fam7') OR c_custkey % 11 = 0 OR c_custkey % 13 = 0 AS protected FROM customer")
def protected_names(spark, d):
    first = F.expr("CASE WHEN c_custkey % 11 = 0 THEN 'Ulf-G. X' WHEN c_custkey % 13 = 0 THEN '' ELSE concat('Q', c_custkey) END")
    return tables.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), U.is_protected(first, F.expr("concat('Fam', c_custkey % 50)"), ["Fam7", "Ulf-G."]).alias("protected"))


#: References as a reader parsed them (author, year and page, some missing or wrong) and the entries of the same list.
_MEAN = SQL + """, en AS (SELECT e.citing AS doc, e.cited AS entry, 'fam' || chr(CAST(97 + p.owner % 7 AS INT)) AS author, 'a. fam' || chr(CAST(97 + p.owner % 7 AS INT)) || ', b. zed' || (p.recid % 3) AS line, p.year AS year, CASE WHEN p.recid % 4 <> 0 THEN CAST(p.recid % 30 AS VARCHAR) END AS page, p.recid % 8 <> 0 AS published FROM edges e JOIN papers p ON p.recid = e.cited),
pr AS (SELECT doc, entry AS ref, CASE entry % 5 WHEN 0 THEN '' WHEN 1 THEN author WHEN 2 THEN 'fam' WHEN 3 THEN 'zed' || (entry % 3) ELSE author || 'x' END AS author, CASE WHEN entry % 3 > 0 THEN CAST(CAST(year AS INT) + entry % 2 AS VARCHAR) END AS year, CASE WHEN entry % 7 > 2 THEN CAST(entry % 30 AS VARCHAR) END AS page FROM en),
m AS (SELECT a.doc, a.ref, b.entry, CASE WHEN a.author = '' THEN 0 WHEN a.author = b.author THEN 4 WHEN contains(a.author, b.author) OR contains(b.author, a.author) THEN 3 WHEN contains(b.line, a.author) THEN 2 ELSE 0 END
    + CASE WHEN a.year = b.year THEN 2 ELSE 0 END + CASE WHEN a.page = b.page THEN 2 ELSE 0 END AS earned, CASE WHEN a.author <> '' THEN 1 ELSE 0 END + CASE WHEN a.year IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN a.page IS NOT NULL AND b.published THEN 1 ELSE 0 END AS checks
  FROM pr a JOIN en b USING (doc)),
r AS (SELECT doc, ref, entry, earned / checks AS score, row_number() OVER (PARTITION BY doc, ref ORDER BY earned / checks DESC, entry) AS k FROM m WHERE checks > 0 AND earned > 0)
SELECT doc, ref, entry, score FROM r WHERE k = 1 AND score >= 1.5"""


@query("mean_matches", _MEAN)
def mean_matches(spark, d):
    p = tables.papers(spark, d)
    met = tables.edges(spark, d).join(p.withColumnRenamed("recid", "cited"), "cited")
    entries = met.selectExpr("citing AS doc", "cited AS entry", "concat('Fam', chr(97 + owner % 7)) AS author", "concat('A. Fam', chr(97 + owner % 7), ', B. Zed', cited % 3) AS line", "year", "CASE WHEN cited % 4 <> 0 THEN cast(cited % 30 as string) END AS page", "cited % 8 <> 0 AS published")
    parsed = entries.selectExpr("doc", "entry AS ref", "CASE entry % 5 WHEN 0 THEN '' WHEN 1 THEN author WHEN 2 THEN 'fam' WHEN 3 THEN concat('zed', entry % 3) ELSE concat(author, 'x') END AS author", "CASE WHEN entry % 3 > 0 THEN cast(cast(year as int) + entry % 2 as string) END AS year", "CASE WHEN entry % 7 > 2 THEN cast(entry % 30 as string) END AS page")
    return U.mean_matches(parsed, entries)
