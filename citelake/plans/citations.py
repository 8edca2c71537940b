"""Queries on citations, graphs and lists, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from citelake.functions import papers as P
from citelake.operators import graph, lists, related
from citelake.sources import tables
from citelake.sources.shared import durable
from citelake.sources.tables import SQL, TOP_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: "Now" for filters on recent years: the last year of the tables.
YEAR = 2001


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def plain(spark: SparkSession, d: str, *columns: str, by: str = "citing") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Citations (partitioned by one end), papers and the seeds of queries by paper (of orders alone), as they are: for queries that read them once."""
    seeds = tables.table(spark, d, "orders").filter("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("seed"))
    return tables.edges(spark, d, by), tables.papers(spark, d, *columns), seeds


def base(spark: SparkSession, d: str, *columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same with citations and papers written once, for queries that read them more than once; of papers all columns, or those that are named."""
    links, papers, seeds = plain(spark, d, *columns)
    return durable(links), durable(papers), seeds


def several(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same with the few seeds of a graph of several."""
    links, papers, _ = base(spark, d)
    return links, papers, durable(tables.top_seeds(links))


#: What papers are ranked and told from reviews by.
_RANKED = ["recid", "title", "year", "citation_count", "citation_count_wo_self", "journal_title", "document_type"]
#: A review, in SQL over the tables' papers: their brands are never review journals, their titles never the general review.
_REVIEW = "p.is_review_type"
_CITES = "p.citation_count_wo_self"


@query("refs_of_paper", SQL + "SELECT s.seed, e.cited AS recid, p.year, p.citation_count FROM seeds s JOIN edges e ON e.citing = s.seed LEFT JOIN papers p ON p.recid = e.cited")
def refs_of_paper(spark, d):
    links, papers, seeds = plain(spark, d)
    return related.references(links, seeds).join(papers, "recid", "left").select("seed", "recid", "year", "citation_count")


_TOP = f"""top AS (
  SELECT e.cited, e.citing AS recid, row_number() OVER (PARTITION BY e.cited ORDER BY {_CITES} DESC, e.citing) AS rank
  FROM edges e JOIN papers p ON p.recid = e.citing)"""


@query("cited_by_top", SQL + f", {_TOP} SELECT cited, recid, rank FROM top WHERE rank <= 25 AND cited IN (SELECT seed FROM seeds)")
def cited_by_top(spark, d):
    links, papers, seeds = plain(spark, d)
    return related.top_citing(links, papers, seeds.select(F.col("seed").alias("recid")), 25)


@query("citing_totals", SQL + "SELECT p.recid, count(DISTINCT e.citing) AS total FROM papers p LEFT JOIN edges e ON e.cited = p.recid GROUP BY p.recid")
def citing_totals(spark, d):
    own = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("seed"))
    return related.citing_totals(tables.edges(spark, d), own).withColumnRenamed("seed", "recid")


_ANCHORS = f"""an AS (
  SELECT *, row_number() OVER (PARTITION BY seed ORDER BY bucket, dist, recid) AS rank FROM (
    SELECT s.seed, p.recid, p.title, 1 / (1 + ln(1 + {_CITES})) AS weight,
           CASE WHEN {_CITES} < 5 THEN 3 WHEN {_CITES} <= 300 THEN 0 WHEN {_CITES} <= 1500 THEN 1 ELSE 4 END AS bucket,
           round(abs(log10({_CITES} + 1) - log10(51)), 12) AS dist
    FROM seeds s JOIN edges e ON e.citing = s.seed JOIN papers p ON p.recid = e.cited WHERE NOT {_REVIEW})),
anchors AS (SELECT * FROM an WHERE rank <= 15)"""


@query("anchors", SQL + f", {_ANCHORS} SELECT seed, recid, round(weight, 9) AS weight, rank FROM anchors")
def anchors(spark, d):
    return related.anchors(*plain(spark, d)).select("seed", "recid", F.round("weight", 9).alias("weight"), "rank")


_COUPLING = f"""{_ANCHORS}, {_TOP},
tot AS (SELECT seed, sum(weight) AS w FROM anchors GROUP BY seed),
cand AS (
  SELECT a.seed, t.recid, count(*) AS shared, sum(a.weight) AS w, string_agg(CASE WHEN k <= 3 THEN title END, ' | ' ORDER BY a.rank) AS shared_titles
  FROM (SELECT a.*, t.recid AS cand, row_number() OVER (PARTITION BY a.seed, t.recid ORDER BY a.rank) AS k FROM anchors a JOIN top t ON t.cited = a.recid AND t.rank <= 25) a
  JOIN (SELECT DISTINCT recid FROM top) t ON t.recid = a.cand
  WHERE a.cand <> a.seed AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.citing = a.seed AND e.cited = a.cand) GROUP BY 1, 2),
coup AS (
  SELECT c.seed, c.recid, c.shared, c.shared_titles, round(c.w / greatest(0.0001, t.w), 9) AS coupling, {_CITES} AS cites, TRY_CAST(p.year AS INTEGER) AS y
  FROM cand c JOIN papers p USING (recid) JOIN tot t USING (seed) WHERE NOT {_REVIEW})"""


@query("related_coupling", SQL + f""", {_COUPLING} SELECT seed, rank, recid, shared, coupling, shared_titles FROM (
  SELECT *, row_number() OVER (PARTITION BY seed ORDER BY coupling DESC, shared DESC, cites DESC, y DESC NULLS LAST, recid) AS rank FROM coup) WHERE rank <= 50""")
def related_coupling(spark, d):
    links, papers, seeds = plain(spark, d, *_RANKED, by="cited")
    return related.related_coupling(links, durable(papers), seeds)  # citations by seeds are a small part: they are read again, not written


@query("related_hybrid", SQL + f""", {_COUPLING},
r1 AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY coupling DESC, shared DESC, cites DESC, y DESC NULLS LAST, recid) AS r FROM coup),
tt AS (SELECT seed, count(DISTINCT e.citing) AS total FROM seeds LEFT JOIN edges e ON e.cited = seed GROUP BY seed),
al AS (SELECT seed, total, CASE WHEN total >= 5 THEN 0.5 / (1 + exp(-0.15 * (total - 30))) ELSE 0 END AS alpha FROM tt),
co AS (SELECT r1.seed, r1.recid, count(DISTINCT a.citing) AS together FROM r1 JOIN edges a ON a.cited = r1.seed JOIN edges b ON b.cited = r1.recid AND b.citing = a.citing WHERE r <= 25 GROUP BY 1, 2),
sc AS (
  SELECT r1.*, alpha, CASE WHEN alpha > 0 AND coalesce(together, 0) > 0 AND total > 0 AND cites > 0 THEN least(1.0::DOUBLE, together / sqrt(total::DOUBLE * cites)) ELSE 0 END AS co_citation
  FROM r1 JOIN al USING (seed) LEFT JOIN co ON co.seed = r1.seed AND co.recid = r1.recid),
fin AS (SELECT *, round((1 - alpha) * coupling + alpha * co_citation, 9) AS combined FROM sc)
SELECT seed, rank, recid, shared, coupling, round(co_citation, 9) AS co_citation, combined FROM (
  SELECT *, row_number() OVER (PARTITION BY seed ORDER BY combined DESC, shared DESC, cites DESC, y DESC NULLS LAST, recid) AS rank FROM fin) WHERE rank <= 50""")
def related_hybrid(spark, d):
    return related.related(*base(spark, d, *_RANKED))


@query("cocitation_cosine", SQL + """, pr AS (SELECT a.cited AS seed, b.cited AS recid, count(DISTINCT a.citing) AS together
  FROM seeds JOIN edges a ON a.cited = seed JOIN edges b ON b.citing = a.citing AND b.cited <> a.cited GROUP BY 1, 2),
n AS (SELECT cited, count(*) AS n FROM edges GROUP BY cited)
SELECT seed, recid, together, round(least(1.0::DOUBLE, together / sqrt(a.n::DOUBLE * b.n)), 6) AS cosine FROM pr JOIN n a ON a.cited = seed JOIN n b ON b.cited = recid""")
def cocitation_cosine(spark, d):
    links, _, seeds = plain(spark, d)
    by = related.citing(links, seeds).select("seed", F.col("recid").alias("citing"))
    pairs = by.join(links, "citing").filter("cited <> seed").groupBy("seed", F.col("cited").alias("recid")).agg(F.count_distinct("citing").alias("together"))
    n = links.groupBy("cited").agg(F.count("*").alias("n"))
    full = pairs.join(n.select(F.col("cited").alias("seed"), F.col("n").alias("na")), "seed").join(n.select(F.col("cited").alias("recid"), F.col("n").alias("nb")), "recid")
    return full.select("seed", "recid", "together", F.round(P.cocitation_cosine(F.col("together"), F.col("na"), F.col("nb")), 6).alias("cosine"))


@query("blend_weight", SQL + "SELECT recid, round(CASE WHEN citation_count >= 5 THEN 0.5 / (1 + exp(-0.15 * (citation_count - 30))) ELSE 0 END, 6) AS alpha FROM papers")
def blend_weight(spark, d):
    return tables.papers(spark, d, "recid", "citation_count").select("recid", F.round(P.blend_weight(F.col("citation_count")), 6).alias("alpha"))


_HOP = f"""hop AS (
  SELECT seed, side, p.*, greatest(0, {_CITES}) AS c, TRY_CAST(p.year AS INTEGER) AS y FROM (
    SELECT s.seed, 'references' AS side, e.cited AS recid FROM seeds s JOIN edges e ON e.citing = s.seed UNION ALL
    SELECT s.seed, 'cited_by', e.citing FROM seeds s JOIN edges e ON e.cited = s.seed) x JOIN papers p USING (recid) WHERE NOT {_REVIEW}),
hs AS (
  SELECT *, round(0.62 * ln(1 + c) / ln(1 + greatest(1, max(c) OVER w)) + 0.38 * CASE WHEN max(y) OVER w > min(y) OVER w AND y IS NOT NULL THEN (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) ELSE 0 END
         + CASE WHEN local_item_id IS NOT NULL THEN 0.03 ELSE 0 END, 9) AS score FROM hop WINDOW w AS (PARTITION BY seed, side))"""
_SORTS = {"relevance": "score DESC, citation_count_wo_self DESC, y DESC NULLS LAST, recid", "mostrecent": "y DESC NULLS LAST, citation_count_wo_self DESC, recid", "mostcited": "citation_count_wo_self DESC, y DESC NULLS LAST, recid"}
for _sort, _keys in _SORTS.items():

    @query(f"graph_one_hop_{_sort}", SQL + f", {_HOP}, r AS (SELECT *, row_number() OVER (PARTITION BY seed, side ORDER BY {_keys}) AS rank FROM hs) SELECT seed, side, rank, recid FROM r WHERE rank <= 25")
    def _one_hop(spark, d, sort=_sort):
        return graph.one_hop(*base(spark, d), sort).select("seed", "side", "rank", "recid")


_MULTI = f"""{_HOP}, r AS (SELECT *, row_number() OVER (PARTITION BY seed, side ORDER BY {_SORTS['relevance']}) AS rank FROM hs),
shown AS (SELECT * FROM r WHERE rank <= 25),
conn AS (
  SELECT side, recid, count(DISTINCT seed) AS connections FROM (SELECT seed, side, recid FROM hop WHERE side = 'references' UNION ALL SELECT seed, side, recid FROM shown WHERE side = 'cited_by')
  WHERE recid NOT IN (SELECT seed FROM seeds) GROUP BY 1, 2),
merged AS (SELECT DISTINCT side, recid, c, y, citation_count_wo_self, local_item_id, earliest_date FROM shown WHERE recid NOT IN (SELECT seed FROM seeds)),
ms AS (
  SELECT m.*, coalesce(connections, 1) AS connections, round(0.62 * ln(1 + c) / ln(1 + greatest(1, max(c) OVER w)) + 0.38 * CASE WHEN max(y) OVER w > min(y) OVER w AND y IS NOT NULL THEN (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) ELSE 0 END
         + CASE WHEN local_item_id IS NOT NULL THEN 0.03 ELSE 0 END, 9) AS score FROM merged m LEFT JOIN conn USING (side, recid) WINDOW w AS (PARTITION BY side)),
multi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY connections DESC, {_SORTS['relevance']}) AS mrank FROM ms) WHERE mrank <= 25)"""


@query("graph_multi_seed", TOP_SQL + f", {_MULTI} SELECT side, mrank AS rank, recid, connections FROM multi")
def graph_multi_seed(spark, d):
    return graph.multi_seed(*several(spark, d)).select("side", "rank", "recid", "connections")


_TIME = "CASE WHEN {x} IS NOT NULL THEN round(CAST({x}[1:4] AS INTEGER) + ((CAST({x}[6:7] AS INTEGER) - 1) * 30.44::DOUBLE + CAST({x}[9:10] AS INTEGER)) / 365, 6) END"
_RADIUS = "CASE WHEN {x} >= 2000 THEN 14 WHEN {x} >= 500 THEN 12 WHEN {x} >= 100 THEN 10 WHEN {x} >= 50 THEN 8 WHEN {x} >= 10 THEN 7 ELSE 6 END"


@query("graph_nodes", TOP_SQL + f""", {_MULTI}
SELECT recid, 'seed' AS kind, NULL::BIGINT AS connections, {_RADIUS.format(x='citation_count_wo_self')} AS radius, {_TIME.format(x='earliest_date')} AS time FROM papers WHERE recid IN (SELECT seed FROM seeds)
UNION ALL SELECT recid, CASE WHEN side = 'references' THEN 'reference' ELSE 'cited_by' END, connections, {_RADIUS.format(x='citation_count_wo_self')}, {_TIME.format(x='earliest_date')} FROM multi""")
def graph_nodes(spark, d):
    links, papers, seeds = several(spark, d)
    return graph.graph_nodes(seeds, papers, graph.multi_seed(links, papers, seeds))


@query("induced_edges", TOP_SQL + f", {_MULTI}, nodes AS (SELECT recid FROM multi UNION SELECT seed FROM seeds) SELECT citing AS source, cited AS target FROM edges WHERE citing IN (SELECT recid FROM nodes) AND cited IN (SELECT recid FROM nodes)")
def induced_edges(spark, d):
    links, papers, seeds = several(spark, d)
    nodes = graph.multi_seed(links, papers, seeds).select("recid").union(seeds)
    return graph.induced_edges(links, nodes)


#: Seed pairs need more seeds than a report's three.
@query("seed_edges", SQL + ", many AS (SELECT citing AS seed FROM edges WHERE citing IN (SELECT cited FROM edges) GROUP BY citing ORDER BY count(*) DESC, citing LIMIT 200) SELECT citing AS source, cited AS target FROM edges WHERE citing IN (SELECT seed FROM many) AND cited IN (SELECT seed FROM many)")
def seed_edges(spark, d):
    links = tables.edges(spark, d)
    return graph.seed_edges(links, tables.top_seeds(links, 200))


@query("graph_totals", TOP_SQL + "SELECT (SELECT count(DISTINCT cited) FROM edges WHERE citing IN (SELECT seed FROM seeds) AND cited NOT IN (SELECT seed FROM seeds)) AS \"references\", (SELECT count(DISTINCT citing) FROM edges WHERE cited IN (SELECT seed FROM seeds) AND citing NOT IN (SELECT seed FROM seeds)) AS cited_by")
def graph_totals(spark, d):
    links, _, seeds = several(spark, d)
    return graph.graph_totals(links, seeds)


_PRED = {
    "high_citations": "citation_count > 50", "recent_5y": f"TRY_CAST(year AS INTEGER) >= {YEAR - 4}", "recent_1y": f"TRY_CAST(year AS INTEGER) >= {YEAR}",
    "published": "coalesce(journal_title <> '', false)", "preprint": "coalesce(arxiv_id <> '', false) AND NOT coalesce(journal_title <> '', false)", "non_review": "NOT is_review_type",
    "related": "is_related", "local": "coalesce(local_item_id > 0, false)", "online": "NOT coalesce(local_item_id > 0, false)", "small_group": "total_authors BETWEEN 1 AND 10",
}
for _name, _sql in _PRED.items():

    @query(f"filter_{_name}", SQL + f"SELECT recid, year, citation_count FROM papers WHERE {_sql}")
    def _filter(spark, d, name=_name):
        return lists.apply_filters(tables.papers(spark, d), [name], YEAR).select("recid", "year", "citation_count")


@query("filters_and", SQL + f"SELECT recid, year FROM papers WHERE {_PRED['recent_5y']} AND {_PRED['published']} AND {_PRED['non_review']} AND {_PRED['small_group']}")
def filters_and(spark, d):
    return lists.apply_filters(tables.papers(spark, d), ["recent_5y", "published", "non_review", "small_group"], YEAR).select("recid", "year")


@query("filter_matrix", SQL + f"SELECT recid, {', '.join(f'{s} AS {n}' for n, s in _PRED.items())} FROM papers")
def filter_matrix(spark, d):
    return lists.filter_matrix(tables.papers(spark, d), YEAR).select("recid", *_PRED)


for _by, _key in (("year", "TRY_CAST(p.year AS INTEGER) DESC NULLS LAST"), ("cites", "p.citation_count DESC NULLS LAST")):

    @query(f"refs_sorted_{_by}", SQL + f"SELECT s.seed, p.recid, row_number() OVER (PARTITION BY s.seed ORDER BY {_key}, p.recid) AS rank FROM seeds s JOIN edges e ON e.citing = s.seed JOIN papers p ON p.recid = e.cited")
    def _sorted(spark, d, by=_by):
        links, papers, seeds = plain(spark, d)
        return lists.sort_list(related.references(links, seeds).join(papers, "recid"), "seed", by).select("seed", "recid", "rank")


@query("time_window", SQL + f", t AS (SELECT recid, {_TIME.format(x='earliest_date')} AS time FROM papers) SELECT recid, time FROM t WHERE time IS NULL OR time BETWEEN 1996.25 AND 1998.75")
def time_window(spark, d):
    return lists.time_window(tables.papers(spark, d), 1996.25, 1998.75).select("recid", "time")


_RANGES = ", ".join(f"('{k}', {a}, {'NULL::BIGINT' if b is None else b})" for k, a, b in lists.RANGES)


@query("hist_citations", SQL + f", rg(bin, low, high) AS (VALUES {_RANGES}) SELECT y.year, bin, low, high, count(p.recid) AS n FROM (SELECT DISTINCT year FROM papers) y CROSS JOIN rg LEFT JOIN papers p ON p.year = y.year AND p.citation_count >= low AND (high IS NULL OR p.citation_count <= high) GROUP BY ALL")
def hist_citations(spark, d):
    papers = tables.papers(spark, d)
    return lists.citation_histogram(papers, papers, "year")


@query("hist_years", SQL + "SELECT owner, TRY_CAST(year AS INTEGER) AS year, count(*) AS n FROM papers GROUP BY ALL")
def hist_years(spark, d):
    return lists.year_histogram(tables.papers(spark, d), "owner")


@query("hist_years_binned")
def hist_years_binned(spark, d):
    papers = tables.papers(spark, d).withColumn("year", F.date_format(F.add_months(F.to_date("earliest_date"), (F.col("recid") % 40 * 12).cast("int")), "yyyy"))
    return lists.year_bins(papers, "journal_title")


@query("spread_stats", SQL + """, o AS (SELECT year, citation_count AS c, row_number() OVER (PARTITION BY year ORDER BY citation_count) - 1 AS k, count(*) OVER (PARTITION BY year) AS n, min(citation_count) OVER (PARTITION BY year) AS lo FROM papers)
SELECT year, max(n) AS n, min(c) AS least, max(c) AS greatest, count(*) FILTER (c = lo) AS at_least, max(c) FILTER (k = n // 2) AS upper_median,
       CASE WHEN max(n) >= 10 THEN max(c) FILTER (k = floor((n - 1) * 0.95::DOUBLE + 0.5)) ELSE max(c) END AS p95, round(log10(max(c) + 1) - log10(min(c) + 1), 6) AS log_range FROM o GROUP BY year""")
def spread_stats(spark, d):
    return lists.spread(tables.papers(spark, d), "year")


@query("axis_ranges", SQL + """, o AS (SELECT year, citation_count AS c, row_number() OVER (PARTITION BY year ORDER BY citation_count) - 1 AS k, count(*) OVER (PARTITION BY year) AS n FROM papers WHERE citation_count > 0),
r AS (SELECT year, log10(min(c)) AS lo, log10(CASE WHEN max(n) >= 10 THEN max(c) FILTER (k = floor((n - 1) * 0.95::DOUBLE + 0.5)) ELSE max(c) END) AS hi FROM o GROUP BY year),
w AS (SELECT year, lo, hi, 0.1::DOUBLE * CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS pad FROM r)
SELECT year, round(greatest(1, pow(10::DOUBLE, lo - pad)), 6) AS low, round(greatest(greatest(1, pow(10::DOUBLE, lo - pad)), pow(10::DOUBLE, hi + pad)), 6) AS high FROM w""")
def axis_ranges(spark, d):
    return lists.axis_range(tables.papers(spark, d), "year")


@query("papers_in_bins", SQL + "SELECT recid, year FROM papers WHERE year IN ('1996', '1998')")
def papers_in_bins(spark, d):
    papers = tables.papers(spark, d).withColumn("all", F.lit(1))
    return lists.in_bins(papers, lists.year_bins(papers, "all"), ["1996", "1998"], "all").select("recid", "year")


@query("author_h_index", SQL + """, o AS (SELECT owner, citation_count AS c, row_number() OVER (PARTITION BY owner ORDER BY citation_count DESC) AS k FROM papers)
SELECT owner, count(*) AS papers, sum(c) AS citations, count(*) FILTER (c >= k) AS h_index, round(sum(c) / count(*), 6) AS average FROM o GROUP BY owner""")
def author_h_index(spark, d):
    return lists.h_index(tables.papers(spark, d), "owner")
