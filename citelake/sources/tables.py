"""Citation tables out of star-schema tables: an order is a paper, its line items' parts are the papers that it cites.

papers: recid, owner, title, year, earliest_date, citation_count, citation_count_wo_self, journal_title, arxiv_id,
document_type, local_item_id, is_related, total_authors. edges: citing, cited, distinct and without loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


PAPER = ["recid", "owner", "title", "year", "earliest_date", "citation_count", "citation_count_wo_self", "journal_title", "arxiv_id", "document_type", "local_item_id", "is_related", "total_authors"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """The citations; with `by` (citing or cited) all rows of one such paper in one place, so that what meets or counts them by it doesn't move them again."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited")).filter("citing <> cited")
    return (items.repartition(by) if by else items).distinct()


def citation_counts(links: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(recid, citation_count, citation_count_wo_self): citing papers, and those that another owner has; without owners only the first, for which links meet no papers."""
    if owners is None:
        return links.groupBy(F.col("cited").alias("recid")).agg(F.count("*").alias("citation_count"))
    citing = links.join(owners.select(F.col("recid").alias("citing"), F.col("owner").alias("_by")), "citing", "left")
    both = citing.join(owners.select(F.col("recid").alias("cited"), F.col("owner").alias("_of")), "cited", "left")
    other = ~F.col("_by").eqNullSafe(F.col("_of"))
    return both.groupBy(F.col("cited").alias("recid")).agg(F.count("*").alias("citation_count"), F.count_if(other).alias("citation_count_wo_self"))


#: What a column of papers needs beyond its order.
_COUNTED, _LISTED = {"citation_count", "citation_count_wo_self"}, {"journal_title", "total_authors"}


def papers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The papers, or only those columns of them; tables that only other columns need aren't read (each has a row for a paper at most)."""
    wanted = set(columns)
    needs = lambda *names: not wanted or not wanted.isdisjoint(names)
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem")
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    own = orders.select(
        key.alias("recid"),
        F.col("o_custkey").alias("owner"),
        F.date_format(day, "yyyy").alias("year"),
        F.date_format(day, "yyyy-MM-dd").alias("earliest_date"),
        F.when(F.col("o_orderstatus").isin("O", "P"), F.concat(F.date_format(day, "yyMM"), F.lit("."), F.lpad((key % 100000).cast("string"), 5, "0"))).alias("arxiv_id"),
        F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "review").otherwise("article")).alias("document_type"),
        F.when(key % 3 == 0, key + 1).alias("local_item_id"),
        (key % 7 == 0).alias("is_related"),
        (F.col("o_orderstatus") != "O").alias("_published"),
    )
    full = own
    if needs(*_COUNTED):
        owners = orders.select(F.col("o_orderkey").alias("recid"), F.col("o_custkey").alias("owner"))
        counts = citation_counts(edges(spark, sf_dir, "citing"), owners) if needs("citation_count_wo_self") else citation_counts(edges(spark, sf_dir, "cited"))
        full = full.join(counts, "recid", "left")
    if needs(*_LISTED):
        line = [F.min("l_partkey").alias("_part"), *([F.count_distinct("l_suppkey").alias("_suppliers")] if needs("total_authors") else [])]
        listed = items.groupBy(F.col("l_orderkey").alias("recid")).agg(*line)
        if needs("journal_title"):
            listed = listed.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_part"), F.col("p_brand").alias("_brand")), "_part", "left")
        full = full.join(listed, "recid", "left")
    if needs("title"):
        titles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recid"), F.substring_index("text", "\n", 1).alias("_title"))
        full = full.join(titles, "recid", "left")
    made = {
        "title": lambda: F.coalesce("_title", F.concat(F.lit("Paper "), F.col("recid").cast("string"))),
        "citation_count": lambda: F.coalesce("citation_count", F.lit(0)),
        "citation_count_wo_self": lambda: F.coalesce("citation_count_wo_self", F.lit(0)),
        "journal_title": lambda: F.when(F.col("_published"), F.col("_brand")),
        "total_authors": lambda: (F.coalesce("_suppliers", F.lit(0)) + 1).cast("int"),
    }
    return full.select(*(made.get(c, lambda c=c: F.col(c))().alias(c) for c in PAPER if needs(c)))


def seeds(papers: DataFrame) -> DataFrame:
    """What queries by paper ask for: every paper whose number is divisible by 20."""
    return papers.filter("recid % 20 = 0").select(F.col("recid").alias("seed"))


def top_seeds(links: DataFrame, n: int = 3) -> DataFrame:
    """What a graph of several seeds is shown for: the `n` papers with most references among those that are cited; a report of fixed size."""
    out = links.groupBy(F.col("citing").alias("seed")).agg(F.count("*").alias("refs"))
    cited = links.select(F.col("cited").alias("seed")).distinct()
    return out.join(cited, "seed", "left_semi").orderBy(F.desc("refs"), "seed").limit(n).select("seed")


#: The same tables in DuckDB SQL, to be put before a query's own common table expressions.
SQL = r"""
WITH edges AS (SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem WHERE l_orderkey <> l_partkey),
cnt AS (
  SELECT e.cited AS recid, count(*) AS n, count(*) FILTER (a.o_custkey IS DISTINCT FROM b.o_custkey) AS n_other
  FROM edges e LEFT JOIN orders a ON a.o_orderkey = e.citing LEFT JOIN orders b ON b.o_orderkey = e.cited GROUP BY e.cited),
lines AS (SELECT l_orderkey AS recid, min(l_partkey) AS part, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1),
papers AS (
  SELECT o_orderkey AS recid, o_custkey AS owner,
         coalesce(CASE WHEN d.text IS NOT NULL THEN string_split(d.text, chr(10))[1] END, 'Paper ' || o_orderkey) AS title,
         strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m-%d') AS earliest_date,
         coalesce(n, 0) AS citation_count, coalesce(n_other, 0) AS citation_count_wo_self,
         CASE WHEN o_orderstatus <> 'O' THEN p_brand END AS journal_title,
         CASE WHEN o_orderstatus IN ('O', 'P') THEN strftime(o_orderdate, '%y%m') || '.' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') END AS arxiv_id,
         o_orderpriority = '1-URGENT' AS is_review_type,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS local_item_id,
         o_orderkey % 7 = 0 AS is_related, coalesce(suppliers, 0) + 1 AS total_authors
  FROM orders LEFT JOIN cnt ON cnt.recid = o_orderkey LEFT JOIN lines ON lines.recid = o_orderkey
  LEFT JOIN part ON p_partkey = lines.part LEFT JOIN documents d ON d.doc_id = o_orderkey),
seeds AS (SELECT recid AS seed FROM papers WHERE recid % 20 = 0)
"""
#: The same with the few seeds of a graph of several.
TOP_SQL = SQL.replace("SELECT recid AS seed FROM papers WHERE recid % 20 = 0", """
  SELECT citing AS seed FROM edges WHERE citing IN (SELECT cited FROM edges) GROUP BY citing ORDER BY count(*) DESC, citing LIMIT 3""")
