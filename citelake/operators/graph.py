"""Citation graphs around seeds: one hop on both sides, many seeds merged, edges among the nodes shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from citelake.functions import papers as P
from citelake.sources.shared import durable

from .related import citing, references

SIDE = 25


def with_relevance(rows: DataFrame, group: list[str]) -> DataFrame:
    """The rows with _score: citations and recency, each scaled within the group, and a bonus for local papers.

    A group's bounds are aggregated and joined back, so no task holds a whole group."""
    cites, year = F.greatest(F.lit(0), P.citations()), P.year_number(F.col("year"))
    bounds = rows.groupBy(*(F.col(c).alias(f"_{c}") for c in group)).agg(F.max(cites).alias("_top"), F.min(year).alias("_low"), F.max(year).alias("_high"))
    met = rows.join(bounds, [F.col(c) == F.col(f"_{c}") for c in group])
    span = F.col("_high") - F.col("_low")
    recent = F.when((span > 0) & year.isNotNull(), (year - F.col("_low")) / span).otherwise(F.lit(0.0))
    score = F.round(0.62 * F.log1p(cites) / F.log1p(F.greatest(F.lit(1), "_top")) + 0.38 * recent + F.when(F.col("local_item_id").isNotNull(), 0.03).otherwise(0.0), 9)
    return met.select(*rows.columns, score.alias("_score"))


def _order(sort: str, first: list[Column] | None = None) -> list[Column]:
    cites, year = F.desc(P.citations()), F.desc_nulls_last(P.year_number(F.col("year")))
    own = {"relevance": [F.desc("_score"), cites, year], "mostrecent": [year, cites], "mostcited": [cites, year]}[sort]
    return [*(first or []), *own, F.col("recid")]


def one_hop(links: DataFrame, papers: DataFrame, seeds: DataFrame, sort: str = "relevance", n: int = SIDE, reviews: bool = False) -> DataFrame:
    """(seed, side, rank, paper columns): the first `n` references and citing papers of each seed in the given order.

    Reviews are taken out before the cut, so a side is full if the seed has enough other neighbours."""
    both = references(links, seeds).withColumn("side", F.lit("references")).union(citing(links, seeds).withColumn("side", F.lit("cited_by")))
    full = both.join(papers, "recid")
    if not reviews:
        full = full.filter(~(P.is_review() | P.is_general_review_title(F.col("title"))))
    full = with_relevance(full, ["seed", "side"]) if sort == "relevance" else full.withColumn("_score", F.lit(0.0))
    w = Window.partitionBy("seed", "side").orderBy(*_order(sort))
    return full.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def connection_counts(links: DataFrame, papers: DataFrame, seeds: DataFrame, shown: DataFrame, reviews: bool = False) -> DataFrame:
    """(side, recid, connections): how many seeds a paper is tied to: by all their references, but by the shown citing papers."""
    refs = references(links, seeds)
    if not reviews:
        keep = papers.filter(~(P.is_review() | P.is_general_review_title(F.col("title")))).select("recid")
        refs = refs.join(keep, "recid", "left_semi")
    both = refs.select("seed", "recid", F.lit("references").alias("side")).union(shown.filter(F.col("side") == "cited_by").select("seed", "recid", "side"))
    free = both.join(seeds.select(F.col("seed").alias("recid")), "recid", "left_anti")
    return free.groupBy("side", "recid").agg(F.count_distinct("seed").alias("connections"))


def multi_seed(links: DataFrame, papers: DataFrame, seeds: DataFrame, sort: str = "relevance", n: int = SIDE, reviews: bool = False) -> DataFrame:
    """(side, rank, recid, connections, paper columns): the seeds' graphs merged. Each paper stands once for each side, seeds don't.

    Of a paper's rows the one with the most citations counts, and any local item of them."""
    shown = durable(one_hop(links, papers, seeds, sort, n, reviews))
    own = [c for c in shown.columns if c not in ("seed", "rank", "_score", "side", "recid", "local_item_id")]
    best = F.max_by(F.struct(*own), F.struct(F.coalesce(P.citations(), F.lit(-1)), F.xxhash64(*own)))
    merged = shown.groupBy("side", "recid").agg(best.alias("_best"), F.min("local_item_id").alias("local_item_id")).select("side", "recid", "local_item_id", "_best.*")
    merged = merged.join(seeds.select(F.col("seed").alias("recid")), "recid", "left_anti")
    full = merged.join(connection_counts(links, papers, seeds, shown, reviews), ["side", "recid"], "left").withColumn("connections", F.coalesce("connections", F.lit(1)))
    full = with_relevance(full, ["side"]) if sort == "relevance" else full.withColumn("_score", F.lit(0.0))
    w = Window.partitionBy("side").orderBy(*_order(sort, [F.desc("connections")] if sort == "relevance" else None))
    return full.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def seed_edges(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(source, target): seeds that cite seeds."""
    a, b = seeds.select(F.col("seed").alias("citing")), seeds.select(F.col("seed").alias("cited"))
    return links.join(a, "citing", "left_semi").join(b, "cited", "left_semi").filter("citing <> cited").select(F.col("citing").alias("source"), F.col("cited").alias("target"))


def induced_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target): all edges among the nodes (recid)."""
    own = nodes.select("recid").distinct()
    inside = links.join(own.select(F.col("recid").alias("citing")), "citing", "left_semi").join(own.select(F.col("recid").alias("cited")), "cited", "left_semi")
    return inside.select(F.col("citing").alias("source"), F.col("cited").alias("target"))


def graph_totals(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(references, cited_by): papers tied to any seed. Of those that cite seeds, seeds that cite seeds don't count."""
    own = seeds.select(F.col("seed").alias("recid"))
    refs = references(links, seeds).select("recid").distinct().join(own, "recid", "left_anti").agg(F.count("*").alias("references"))
    by = citing(links, seeds).select("recid").distinct().join(own, "recid", "left_anti").agg(F.count("*").alias("cited_by"))
    return refs.withColumn("_k", F.lit(1)).join(by.withColumn("_k", F.lit(1)), "_k").drop("_k")


def graph_nodes(seeds: DataFrame, papers: DataFrame, merged: DataFrame) -> DataFrame:
    """(recid, kind, connections, radius, time): seeds and shown papers as rows for export."""
    own = seeds.join(papers, seeds["seed"] == papers["recid"]).select("recid", F.lit("seed").alias("kind"), F.lit(None).cast("long").alias("connections"), P.node_radius(P.citations()).alias("radius"), F.round(P.fractional_year(F.col("earliest_date")), 6).alias("time"))
    kind = F.when(F.col("side") == "references", "reference").otherwise("cited_by")
    return own.unionByName(merged.select("recid", kind.alias("kind"), "connections", P.node_radius(P.citations()).alias("radius"), F.round(P.fractional_year(F.col("earliest_date")), 6).alias("time")))
