"""Paper lists: quick filters, sorting, histograms and summaries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from citelake.functions import papers as P

#: The quick filters' bounds.
HIGH_CITATIONS, SMALL_GROUP, RECENT, THIS = 50, 10, 5, 1
#: Citation ranges of the histogram, least and greatest.
RANGES = [("0", 0, 0), ("1-9", 1, 9), ("10-49", 10, 49), ("50-99", 50, 99), ("100-249", 100, 249), ("250-499", 250, 499), ("500+", 500, None)]


def since(years: int, current_year: int) -> Column:
    """In the last `years` years, the current one included; a year that begins with no number is in none."""
    return F.coalesce(P.leading_int(F.col("year")) >= current_year - (max(1, years) - 1), F.lit(False))


def predicates(current_year: int) -> dict[str, Callable[[], Column]]:
    """The quick filters by name. The current year is a parameter, so that a result doesn't depend on the day it is made."""
    local = lambda: F.coalesce(F.col("local_item_id") > 0, F.lit(False))
    return {
        "high_citations": lambda: F.coalesce("citation_count", F.lit(0)) > HIGH_CITATIONS,
        "recent_5y": lambda: since(RECENT, current_year),
        "recent_1y": lambda: since(THIS, current_year),
        "published": lambda: P.is_published(F.col("journal_title")),
        "preprint": lambda: P.has_arxiv(F.col("arxiv_id")) & ~P.is_published(F.col("journal_title")),
        "non_review": lambda: ~P.is_review(),
        "related": lambda: F.coalesce("is_related", F.lit(False)),
        "local": local,
        "online": lambda: ~local(),
        "small_group": lambda: F.coalesce("total_authors", F.lit(0)).between(1, SMALL_GROUP),
    }


#: Filters of which choosing one drops the other.
EXCLUDES = {"published": {"preprint"}, "preprint": {"published"}, "local": {"online"}, "online": {"local"}, "recent_5y": {"recent_1y"}, "recent_1y": {"recent_5y"}}


def choose(active: list[str], name: str) -> list[str]:
    """The active filters after a filter is switched: off if it was on, else on, without those that it excludes."""
    if name in active:
        return [x for x in active if x != name]
    return [x for x in active if x not in EXCLUDES.get(name, set())] + [name]


def apply_filters(papers: DataFrame, active: list[str], current_year: int) -> DataFrame:
    known = predicates(current_year)
    return papers.filter(reduce(lambda a, b: a & b, [known[x]() for x in active], F.lit(True)))


def filter_matrix(papers: DataFrame, current_year: int) -> DataFrame:
    """The rows with a boolean column for each quick filter."""
    return papers.select("*", *(p().alias(name) for name, p in predicates(current_year).items()))


def sort_list(papers: DataFrame, group: str, by: str) -> DataFrame:
    """The rows with rank within their group: by year or citations, down; unknown ones last, ties by recid.

    A row's rank is the number of rows with greater values and its place among those with its own, so a large group isn't sorted in one task."""
    key = P.year_number(F.col("year")) if by == "year" else F.col("citation_count")
    rows = papers.withColumn("_key", key)
    counted = rows.groupBy(F.col(group).alias("_group"), F.col("_key").alias("_value")).agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(Window.partitionBy("_group").orderBy(F.desc_nulls_last("_value"))) - F.col("_n")
    met = rows.join(counted.withColumn("_above", above), F.col(group).eqNullSafe(F.col("_group")) & F.col("_key").eqNullSafe(F.col("_value")))
    place = F.row_number().over(Window.partitionBy(group, "_key").orderBy("recid"))
    return met.select(*papers.columns, (F.col("_above") + place).alias("rank"))


def time_window(papers: DataFrame, start: float, end: float) -> DataFrame:
    """Papers whose time lies in the window, and those whose time is unknown."""
    t = P.fractional_year(F.col("earliest_date"))
    return papers.withColumn("time", F.round(t, 6)).filter(t.isNull() | t.between(start, end))


def citation_histogram(papers: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """(group, bin, low, high, n): all ranges for each group, empty ones too; a negative count is in none."""
    ranges = papers.sparkSession.createDataFrame([(k, a, b) for k, a, b in RANGES], "bin string, low long, high long")
    c = F.col("citation_count")
    bins = F.coalesce(*(F.when((c >= a) & (c <= b if b is not None else F.lit(True)), k) for k, a, b in RANGES))
    counted = papers.groupBy(group, bins.alias("bin")).agg(F.count("*").alias("n"))
    every = groups.select(group).distinct().withColumn("bin", F.explode(F.array(*(F.lit(k) for k, _, _ in RANGES))))
    return every.join(F.broadcast(ranges), "bin").join(counted, [group, "bin"], "left").select(group, "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def year_histogram(papers: DataFrame, group: str) -> DataFrame:
    """(group, year, n) over years that begin with a positive number."""
    year = P.leading_int(F.col("year"))
    return papers.filter(year > 0).groupBy(group, year.alias("year")).agg(F.count("*").alias("n"))


#: Bars of the year histogram, least count of a bar that is made by merging.
BARS, LEAST = 10, 3
_BIN = "struct<count:bigint,years:array<int>>"


def year_bins(papers: DataFrame, group: str, bars: int = BARS) -> DataFrame:
    """(group, key, first, last, n): years as bars, at most `bars` of them, with about equal counts.

    Up to `bars` years are bars of their own. Otherwise years are gathered in order until a bar has its share of all papers, or until the
    years left are as few as the bars left; while there are too many bars the two neighbours with the smallest sum become
    one; last, a first bar below LEAST joins the second if that makes no bar above one and a half shares. A group's years are one
    short sorted array, on which three folds work."""
    counted = year_histogram(papers, group)
    years = counted.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col("year").cast("int").alias("year"), F.col("n").cast("long").alias("n")))).alias("ys"), F.sum("n").cast("long").alias("total"))
    one = lambda y: F.struct(y["n"].alias("count"), F.array(y["year"]).alias("years"))
    share = F.greatest(F.lit(LEAST), F.ceil(F.col("total") / bars))
    join = lambda a, b: F.struct((a["count"] + b["count"]).alias("count"), F.concat(a["years"], b["years"]).alias("years"))
    empty = F.struct(F.array().cast(f"array<{_BIN}>").alias("bins"), F.lit(None).cast(_BIN).alias("open"), F.lit(0).alias("seen"))

    def gather(s: Column, y: Column) -> Column:
        bar = F.when(s["open"].isNull(), one(y)).otherwise(join(s["open"], one(y)))
        seen = s["seen"] + 1
        left, free = F.size("ys") - seen, bars - F.size(s["bins"]) - 1
        full = (bar["count"] >= share) | (left <= free) | (left == 0)
        return F.struct(F.when(full, F.concat(s["bins"], F.array(bar))).otherwise(s["bins"]).alias("bins"), F.when(~full, bar).alias("open"), seen.alias("seen"))

    def merge(bins: Column, _: Column) -> Column:
        sums = F.transform(F.slice(bins, 1, F.size(bins) - 1), lambda b, i: b["count"] + F.get(bins, i + 1)["count"])
        at = F.array_position(sums, F.array_min(sums)).cast("int")
        both = F.array(join(F.element_at(bins, at), F.element_at(bins, at + 1)))
        return F.concat(F.slice(bins, 1, at - 1), both, F.slice(bins, at + 2, F.size(bins)))

    def absorb(bins: Column, _: Column) -> Column:
        a, b = F.get(bins, 0), F.get(bins, 1)
        small = (F.size(bins) > 3) & (a["count"] < LEAST) & (a["count"] + b["count"] < share * 1.5)
        return F.when(small, F.concat(F.array(join(a, b)), F.slice(bins, 3, F.size(bins)))).otherwise(bins)

    times = lambda n: F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    out = years.withColumn("bins", F.aggregate("ys", empty, gather)["bins"])
    out = out.withColumn("bins", F.aggregate(times(F.size("bins") - bars), F.col("bins"), merge))
    out = out.withColumn("bins", F.aggregate(times(F.size("bins")), F.col("bins"), absorb))
    single = F.transform("ys", one)
    out = out.select(group, F.explode(F.when(F.size("ys") <= bars, single).otherwise(F.col("bins"))).alias("bin"))
    first, last = F.col("bin.years")[0], F.element_at("bin.years", -1)
    key = F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))
    return out.select(group, key.alias("key"), first.alias("first"), last.alias("last"), F.col("bin.count").alias("n"))


def nearest_rank(values: Column, p: float) -> Column:
    """The value of a sorted array at the place nearest to the share `p`."""
    return F.element_at(values, (F.floor((F.size(values) - 1) * p + 0.5) + 1).cast("int"))


def spread(papers: DataFrame, group: str) -> DataFrame:
    """(group, n, least, greatest, at_least, upper_median, p95, log_range) of citations. The 95th percentile counts from ten papers on, below it is the greatest."""
    c = F.col("citation_count")
    counted = papers.groupBy(group, c.alias("c")).agg(F.count("*").alias("k"))
    below = F.sum("k").over(Window.partitionBy(group).orderBy("c"))
    total = F.sum("k").over(Window.partitionBy(group))
    at = lambda p: F.floor((F.col("n") - 1) * p + 0.5)
    placed = counted.withColumn("upto", below).withColumn("n", total)
    pick = lambda place: F.min(F.when(F.col("upto") > place, F.col("c")))
    out = placed.groupBy(group).agg(
        F.max("n").alias("n"), F.min("c").alias("least"), F.max("c").alias("greatest"), F.min_by("k", "c").alias("at_least"),
        pick(F.floor(F.col("n") / 2)).alias("upper_median"), pick(at(0.95)).alias("_p95"),
    )
    top = F.when(F.col("n") >= 10, F.col("_p95")).otherwise(F.col("greatest"))
    return out.select(group, "n", "least", "greatest", "at_least", "upper_median", top.alias("p95"), F.round(F.log10(F.col("greatest") + 1) - F.log10(F.col("least") + 1), 6).alias("log_range"))


def axis_range(papers: DataFrame, group: str) -> DataFrame:
    """(group, low, high): the range of a logarithmic axis over positive citation counts, a tenth of its length wider on both sides.

    The 95th percentile counts as the greatest from ten papers on, so that one paper doesn't flatten the rest."""
    out = spread(papers.filter("citation_count > 0"), group)
    low, high = F.log10("least"), F.log10("p95")
    pad = 0.1 * F.when(high == low, F.lit(1.0)).otherwise(high - low)
    least = F.greatest(F.lit(1.0), F.pow(F.lit(10.0), low - pad))
    return out.select(group, F.round(least, 6).alias("low"), F.round(F.greatest(least, F.pow(F.lit(10.0), high + pad)), 6).alias("high"))


def in_bins(papers: DataFrame, bins: DataFrame, selected: list[str], group: str) -> DataFrame:
    """Papers in any of the selected year bins (key) of their group; all papers if none is selected. bins: what year_bins gives.

    A group has few bins, so they meet the papers as one small array for each group."""
    if not selected:
        return papers
    own = bins.filter(F.col("key").isin(selected)).groupBy(F.col(group).alias("_group")).agg(F.collect_list(F.struct("first", "last")).alias("_bins"))
    met = papers.join(own, F.col(group).eqNullSafe(F.col("_group")))
    year = P.leading_int(F.col("year"))
    return met.filter(F.exists("_bins", lambda b: year.between(b["first"], b["last"]))).drop("_group", "_bins")


def choose_bins(selected: list[str], keys: list[str], key: str, last: str | None = None, more: bool = False, upto: bool = False) -> list[str]:
    """The selected keys after one is chosen: alone (or none, if it was the only one); with `more`, switched on or off; with `upto`, all
    from the last one chosen to this one, besides the others only with `more`."""
    if upto and last in keys and key in keys:
        a, b = sorted((keys.index(last), keys.index(key)))
        out = {*keys[a : b + 1], *(selected if more else ())}
    elif more:
        out = {*selected} ^ {key}
    else:
        out = set() if selected == [key] else {key}
    return [k for k in keys if k in out]


def h_index(papers: DataFrame, author: str) -> DataFrame:
    """(author, papers, citations, average, h_index): h papers of an author have at least h citations each.

    Counted by distinct citation counts, so an author's papers are never ordered one by one."""
    c = F.greatest(F.coalesce("citation_count", F.lit(0)), F.lit(0))
    counted = papers.groupBy(author, c.alias("c")).agg(F.count("*").alias("k"))
    above = F.sum("k").over(Window.partitionBy(author).orderBy(F.desc("c")))
    best = counted.withColumn("h", F.least(above, F.col("c")))
    out = best.groupBy(author).agg(F.sum("k").alias("papers"), F.sum(F.col("k") * F.col("c")).alias("citations"), F.max("h").alias("h_index"))
    return out.withColumn("average", F.round(F.col("citations") / F.col("papers"), 6))
