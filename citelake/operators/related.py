"""Related papers: bibliographic coupling through anchor references, blended with co-citation. All operators take many seeds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from citelake.functions import papers as P
from citelake.sources.shared import durable

ANCHORS, PER_ANCHOR, RESULTS, COCITED = 15, 25, 50, 25


def references(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, recid): what each seed cites."""
    return links.join(seeds, links["citing"] == seeds["seed"]).select("seed", F.col("cited").alias("recid"))


def citing(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, recid): what cites each seed."""
    return links.join(seeds, links["cited"] == seeds["seed"]).select("seed", F.col("citing").alias("recid"))


def citing_totals(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, total): papers citing each seed; 0 if none does."""
    # Counted before seeds are met: links are moved once, and counts alone are joined.
    counted = links.groupBy(F.col("cited").alias("seed")).agg(F.count_distinct("citing").alias("total"))
    return seeds.join(counted, "seed", "left").select("seed", F.coalesce("total", F.lit(0)).alias("total"))


def top_citing(links: DataFrame, papers: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """(cited, recid, rank): the `n` most cited papers citing each target; ties by recid."""
    return _top_citing(links, papers.select("recid", P.citations(None).alias("cites")), targets, n).select("cited", "recid", "rank")


def _top_citing(links: DataFrame, papers: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """top_citing with all columns of papers (recid, cites and others)."""
    own = targets.select(F.col("recid").alias("cited")).distinct()
    w = Window.partitionBy("cited").orderBy(F.desc(F.coalesce("cites", F.lit(-1))), "recid")
    hits = links.join(own, "cited", "left_semi").withColumnRenamed("citing", "recid").join(papers, "recid")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def anchors(links: DataFrame, papers: DataFrame, seeds: DataFrame, k: int = ANCHORS, reviews: bool = False) -> DataFrame:
    """(seed, recid, title, weight, rank): the `k` references of each seed that say most about what it is near.

    References cited neither too rarely nor too often come first, then those nearest to 50 citations on a logarithmic scale;
    the field's general review never serves, and other reviews only on request."""
    refs = references(links, seeds).join(papers, "recid").filter(~P.is_general_review_title(F.col("title")))
    if not reviews:
        refs = refs.filter(~P.is_review())
    cites = P.citations(None)
    distance = F.round(F.abs(F.log10(cites + 1) - F.log10(F.lit(51.0))), 12)
    w = Window.partitionBy("seed").orderBy(P.anchor_bucket(cites), F.asc_nulls_last(distance), "recid")
    ranked = refs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    title = F.when(F.trim("title") != "", F.col("title")).otherwise(F.col("recid").cast("string"))
    return ranked.select("seed", "recid", title.alias("title"), P.anchor_weight(cites).alias("weight"), "rank")


def _ranked(scored: DataFrame, score: str, n: int) -> DataFrame:
    """The best `n` of each seed: score, shared references and citations down, then later years, then recid."""
    w = Window.partitionBy("seed").orderBy(F.desc(score), F.desc("shared"), F.desc(F.coalesce("cites", F.lit(-1))), F.desc_nulls_last("year"), "recid")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def coupling(links: DataFrame, papers: DataFrame, seeds: DataFrame, k: int = ANCHORS, per_anchor: int = PER_ANCHOR, reviews: bool = False) -> DataFrame:
    """(seed, recid, shared, coupling, shared_titles, cites, year): papers that cite a seed's anchors, with their citations and year as numbers.

    Each anchor counts through its `per_anchor` most cited citing papers; seeds, their references and reviews are left out
    afterwards. coupling is the weight of the shared anchors over that of all anchors.

    A candidate goes to its seed with the rank of the anchor alone; weights and titles of a seed's anchors (at most k) are there as lists."""
    chosen = durable(anchors(links, papers, seeds, k, reviews))
    kept = ~P.is_general_review_title(F.col("title")) if reviews else ~(P.is_general_review_title(F.col("title")) | P.is_review())
    known = papers.select("recid", P.citations(None).alias("cites"), P.year_number(F.col("year")).alias("year"), kept.alias("_kept"))
    hits = _top_citing(links, known, chosen, per_anchor).filter("_kept").select(F.col("cited").alias("_anchor"), F.col("recid").alias("cand"), "cites", "year")
    met = chosen.select("seed", F.col("recid").alias("_anchor"), F.col("rank").alias("_rank")).join(hits, "_anchor").select("seed", F.col("cand").alias("recid"), "_rank", "cites", "year").filter("recid <> seed")
    # What a seed cites is put to its candidates, not joined with them: they are grouped by seed and paper anyway.
    taken = references(links, seeds).withColumn("_taken", F.lit(True))
    rows = met.unionByName(taken, allowMissingColumns=True).repartition("seed")
    grouped = rows.groupBy("seed", "recid").agg(F.sort_array(F.collect_list("_rank")).alias("_ranks"), F.max("cites").alias("cites"), F.max("year").alias("year"), F.max("_taken").alias("_taken"))
    own = chosen.repartition("seed").groupBy("seed").agg(F.sum("weight").alias("_total"), F.map_from_entries(F.collect_list(F.struct("rank", F.struct("weight", "title")))).alias("_anchors"))
    full = grouped.filter("_taken IS NULL").join(own, "seed").withColumn("_shared", F.transform("_ranks", lambda r: F.col("_anchors")[r]))
    weight = F.aggregate("_shared", F.lit(0.0), lambda s, x: s + x["weight"])
    return full.select(
        "seed", "recid", F.size("_ranks").cast("long").alias("shared"), F.round(weight / F.greatest(F.lit(0.0001), F.col("_total")), 9).alias("coupling"),
        F.array_join(F.transform(F.slice("_shared", 1, 3), lambda x: x["title"]), " | ").alias("shared_titles"), "cites", "year",
    )


def related_coupling(links: DataFrame, papers: DataFrame, seeds: DataFrame, n: int = RESULTS) -> DataFrame:
    out = _ranked(coupling(links, papers, seeds), "coupling", n)
    return out.select("seed", "rank", "recid", "shared", "coupling", "shared_titles")


def cocited(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seed, recid, together): how many papers cite both, for each given pair that any paper does."""
    a = links.select(F.col("cited").alias("seed"), F.col("citing").alias("_by"))
    b = links.select(F.col("cited").alias("recid"), F.col("citing").alias("_by"))
    one = pairs.select("seed", "recid").join(a, "seed")
    return one.join(b, ["recid", "_by"]).groupBy("seed", "recid").agg(F.count_distinct("_by").alias("together"))


def related(links: DataFrame, papers: DataFrame, seeds: DataFrame, n: int = RESULTS, deepened: int = COCITED) -> DataFrame:
    """The `n` most related papers of each seed: coupling blended with co-citation.

    Only the best `deepened` candidates by coupling get a co-citation score; the others keep 0. The blend depends on the seed's citations."""
    found = durable(coupling(links, papers, seeds))
    best = _ranked(found, "coupling", deepened).select("seed", "recid")
    together = cocited(links, best).withColumnRenamed("seed", "_s").withColumnRenamed("recid", "_r")
    totals = citing_totals(links, seeds).withColumn("_alpha", P.blend_weight(F.col("total")))
    met = found.join(totals, "seed").join(together, (F.col("seed") == F.col("_s")) & (F.col("recid") == F.col("_r")), "left")
    cosine = F.when(F.col("_alpha") > 0, P.cocitation_cosine(F.coalesce("together", F.lit(0)), F.col("total"), F.coalesce("cites", F.lit(0)))).otherwise(F.lit(0.0))
    scored = met.withColumn("co_citation", cosine).withColumn("combined", F.round((1 - F.col("_alpha")) * F.col("coupling") + F.col("_alpha") * F.col("co_citation"), 9))
    out = _ranked(scored, "combined", n)
    return out.select("seed", "rank", "recid", "shared", "coupling", F.round("co_citation", 9).alias("co_citation"), "combined")
