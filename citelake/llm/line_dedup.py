"""Line dedup by site-relative frequency: a line that stands on a large share of a host's pages is boilerplate.

Pages are counted by distinct text: the copies of one page are one page, so a page isn't called boilerplate because it was
crawled a thousand times (copies are left to near-dedup). A line's key is the MD5 of the line without blanks around it; blank lines are never
boilerplate. Lines are counted with partial aggregation, so a hot host or line costs no task more than its share. A
host has at most (mean distinct lines of its pages) / ratio boilerplate lines, for each of them takes up that share of the pages;
this array, a row for each host, is written out, so that its size is known when it meets the pages: Spark sends it to the pages where it is
small, and otherwise joins by host, which it splits if a host is hot.

Defined results: a null text stays null and counts as no page; a null host is a host of its own; repeated rows are
copies of one page; empty tables stay empty; other columns are passed through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import durable, packed

#: A line on at least this share of a host's pages goes, if it stands on MIN_PAGES pages at least: on a site of few pages every line is on a
#: large share of them, and two pages may be a page and its near copy; only the third shows that a line is the site's.
RATIO, MIN_PAGES = 0.05, 3


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, n_pages, ratio): the MD5 of each boilerplate line of each host."""
    page = docs.filter(F.col("text").isNotNull()).select(F.col(host).alias("host"), F.xxhash64("text").alias("page"), "text")
    totals = page.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _key))
    counted = page.select("host", "page", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count_distinct("page").alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    joined = counted.join(totals.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")))
    return joined.select("host", "line", "n_pages", (F.col("n_pages") / F.col("pages")).alias("ratio")).filter(F.col("n_pages") >= ratio * F.col("pages"))


def dedup_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The rows of `docs` with boilerplate lines taken out of text, and the added column n_dropped (lines taken out)."""
    found = durable(boilerplate(docs, host, ratio, min_pages).groupBy("host").agg(F.collect_list("line").alias("_lines")).withColumnRenamed("host", "_host"))
    own = docs.select(packed(docs, ["n_dropped"]), F.col(host).alias("_own_host"), F.split("text", "\n").alias("_split"))
    met = own.join(found, F.col("_own_host").eqNullSafe(F.col("_host")), "left")
    stays = F.filter("_split", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_lines"), _key(x)))
    met = met.select("row", "_split", F.when(F.col("_lines").isNull(), F.col("_split")).otherwise(stays).alias("_stay"))
    n = F.coalesce(F.size("_split") - F.size("_stay"), F.lit(0)).cast("long")
    text = F.when(n == 0, F.col("row.text")).otherwise(F.array_join("_stay", "\n"))
    return met.select(*((text if c.lower() == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c.lower() != "n_dropped"), n.alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = dedup_lines(docs)
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "source", "n_dropped", F.length(kept).cast("long").alias("n_chars_kept"), F.sha2(kept, 256).alias("kept_sha256"))


ORACLE_OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL),
t AS (SELECT source, count(DISTINCT text) AS pages FROM d WHERE text IS NOT NULL GROUP BY source),
b AS (
  SELECT n.source, n.line FROM (
    SELECT source, trim(line, ' ') AS line, count(DISTINCT text) AS n_pages FROM l WHERE trim(line, ' ') <> '' GROUP BY 1, 2) n
  JOIN t ON n.source IS NOT DISTINCT FROM t.source
  WHERE n_pages >= {MIN_PAGES} AND n_pages >= {RATIO} * pages),
k AS (
  SELECT l.rid, count(b.line) AS n_dropped, string_agg(CASE WHEN b.line IS NULL THEN l.line END, chr(10) ORDER BY l.i) AS kept
  FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, ' ') = b.line GROUP BY l.rid)
SELECT d.doc_id, d.source, coalesce(k.n_dropped, 0) AS n_dropped, length(coalesce(k.kept, '')) AS n_chars_kept, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
