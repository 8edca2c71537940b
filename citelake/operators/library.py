"""A library's items: their fields, how they meet papers, tags, and the free text in which counts and ids are kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from citelake.functions import authors as A
from citelake.functions import identifiers as I


def fields_of(data: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """(item_id, one column for each name) out of entity, attribute and value tables: data (item_id, field, value_id), values (value_id, value).

    Of several values of a field the least counts."""
    met = data.filter(F.col("field").isin(names)).join(values, "value_id")
    return met.groupBy("item_id").agg(*(F.min(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names))


def local_items(entries: DataFrame, items: DataFrame) -> DataFrame:
    """(id, item_id, by): the library item of each entry by record number, else by the number in the item's address, else by arXiv id,
    else by DOI. The smallest item id of several.

    entries: id, recid, arxiv_id, doi. items: item_id, recid, url, extra, doi. Ids are compared whole and in normal form."""
    in_extra = F.nullif(F.regexp_extract(F.coalesce("extra", F.lit("")), r"(?im)^\s*(?:arXiv|_eprint)\s*:\s*(\S+)", 1), F.lit(""))
    ways = [
        ("recid", F.col("recid").cast("string"), F.col("recid").cast("string")),
        ("url", F.col("recid").cast("string"), F.nullif(F.regexp_extract(F.coalesce("url", F.lit("")), r"/(?:literature|record)/(\d+)", 1), F.lit(""))),
        ("arxiv", I.arxiv_id(F.col("arxiv_id")), I.arxiv_id(in_extra)),
        ("doi", I.doi(F.col("doi")), I.doi(F.col("doi"))),
    ]
    found = []
    for k, (by, mine, theirs) in enumerate(ways):
        own = items.select(theirs.alias("_v"), "item_id").filter("_v is not null").groupBy("_v").agg(F.min("item_id").alias("item_id"))
        met = entries.select("id", mine.alias("_v")).filter("_v is not null").join(own, "_v")
        found.append(met.select("id", F.lit(k).alias("_order"), "item_id", F.lit(by).alias("by")))
    best = reduce(DataFrame.union, found).groupBy("id").agg(F.min(F.struct("_order", "item_id", "by")).alias("b"))
    return best.select("id", "b.item_id", "b.by")


def tag_names(items: DataFrame, item_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(name): the names of all tags on the items."""
    return items.select("item_id").join(item_tags, "item_id").join(tags, "tag_id").select("name").distinct()


def listed_collaborations(extra: Column) -> Column:
    """The names after tex.collaboration: in a line of an item's free text."""
    line = F.regexp_extract(F.coalesce(extra, F.lit("")), r"(?m)^tex\.collaboration:[^\S\n]*([^\n]+)$", 1)
    return F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x)), lambda x: x != "")


def collaboration_tags(items: DataFrame, template: str = "{name}") -> DataFrame:
    """(item_id, tag, old, change) for each collaboration that an item (item_id, extra, tags) names: added, updated (the old tag, which holds the
    name but not in this form, goes) or kept."""
    before, after = template.split("{name}", 1)
    each = items.select("item_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.explode(listed_collaborations(F.col("extra"))).alias("_full"))
    name = A.collaboration_name(F.col("_full"))
    named = each.select("item_id", "tags", name.alias("_name"), F.concat(F.lit(before), name, F.lit(after)).alias("tag")).dropDuplicates(["item_id", "tag"])
    old = F.try_element_at(F.filter("tags", lambda t: F.contains(t, F.col("_name"))), F.lit(1))
    has = F.array_contains("tags", F.col("tag"))
    change = F.when(has, "kept").when(old.isNotNull(), "updated").otherwise("added")
    return named.select("item_id", "tag", F.when(~has, old).alias("old"), change.alias("change"))


def tag_summary(items: DataFrame, template: str = "{name}") -> DataFrame:
    """(added, updated, skipped): changes, and items without any."""
    changes = collaboration_tags(items, template).groupBy("item_id").agg(F.count_if(F.col("change") == "added").alias("a"), F.count_if(F.col("change") == "updated").alias("u"))
    full = items.select("item_id").join(changes, "item_id", "left").fillna(0, ["a", "u"])
    return full.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("added"), F.coalesce(F.sum("u"), F.lit(0)).alias("updated"), F.count_if((F.col("a") == 0) & (F.col("u") == 0)).alias("skipped"))


_SELF = r"(?i)(?<![A-Za-z0-9_])(?:w/o|without)\s+self(?![A-Za-z0-9_])"


#: The name by which lines of the main source of counts are known; a parameter.
SOURCE = "Index"


def counts_in_text(extra: Column, without_self: bool = False, source: str = SOURCE) -> Column:
    """The citation count kept in an item's free text, in lines like `12 citations w/o self (Index 2024/1/2)`.

    Lines of the main source come first, then others; if none is of the wanted kind, the first of any kind counts."""
    lines = F.filter(F.split(F.coalesce(extra, F.lit("")), r"\r?\n"), lambda x: F.rlike(x, F.lit(r"(?i)^\d+\s+citations(?![A-Za-z0-9_])")))

    def first(own: bool, main: bool) -> Column:
        fits = F.filter(lines, lambda x: (F.rlike(x, F.lit(_SELF)) == F.lit(own)) & (F.rlike(x, F.lit(rf"(?i)\({source}(?![A-Za-z0-9_])")) == F.lit(main)))
        return F.regexp_extract(F.try_element_at(fits, F.lit(1)), r"^(\d+)", 1).try_cast("long")

    wanted = [first(without_self, True), first(without_self, False)]
    return F.coalesce(*wanted, first(False, True), first(False, False), first(True, True), first(True, False))


def with_counts(extra: Column, count: Column, without_self: Column, today: Column, source: str = SOURCE) -> Column:
    """The free text with both counts in its first two lines and no other citation lines. The date stays if the counts do."""
    text = F.coalesce(extra, F.lit(""))
    numbers = F.regexp_extract_all(text, F.lit(r"(?m)^(\d+)\scitations"), F.lit(1))
    same = (F.size(numbers) >= 2) & (F.get(numbers, F.lit(0)) == count.cast("string")) & (F.get(numbers, F.lit(1)) == without_self.cast("string"))
    date = F.when(same, F.coalesce(F.nullif(F.regexp_extract(text, rf"{source}\s([\d/-]+)", 1), F.lit("")), today)).otherwise(today)
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.contains(x, F.lit("citations"))), "\n")
    head = F.concat(count.cast("string"), F.lit(f" citations ({source} "), date, F.lit(")\n"), without_self.cast("string"), F.lit(f" citations w/o self ({source} "), date, F.lit(")\n"))
    return F.concat(head, F.regexp_replace(rest, r"^\n+", ""))


def ordered_lines(extra: Column) -> Column:
    """Lines with arXiv ids first, then others, citation lines last; empty lines go."""
    lines = F.split(F.coalesce(extra, F.lit("")), "\n")
    cites = lambda x: F.rlike(x, F.lit(r"^\d+\scitations"))
    arxiv = lambda x: F.rlike(x, F.lit(r"(?i)^(?:arXiv:|_eprint:)"))
    return F.array_join(F.concat(F.filter(lines, lambda x: arxiv(x) & ~cites(x)), F.filter(lines, lambda x: ~arxiv(x) & ~cites(x) & (F.trim(x) != "")), F.filter(lines, cites)), "\n")


def arxiv_category(extra: Column) -> Column:
    """The category in brackets after an arXiv id, or the part before the slash of an old one; null if there is none."""
    text = F.coalesce(extra, F.lit(""))
    new, old = F.regexp_extract(text, r"(?i)arXiv:\d{4}\.\d{4,5}\s*\[([^\]]+)\]", 1), F.regexp_extract(text, r"(?i)arXiv:([a-z-]+)/\d{7}", 1)
    return F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")))


def timings(measures: DataFrame) -> DataFrame:
    """(name, count, total, average, least, greatest, last) of measures (name, ts, value); last by time, then value."""
    out = measures.groupBy("name").agg(
        F.count("value").alias("count"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.max_by("value", F.struct("ts", "value")).alias("last")
    )
    return out.select("name", "count", "total", (F.col("total") / F.col("count")).alias("average"), "least", "greatest", "last")


def cache_statistics(entries: DataFrame) -> DataFrame:
    """(kind, entries, rows, hits, misses, hit_rate) of cache entries (kind, n_rows, hits, misses)."""
    out = entries.groupBy("kind").agg(F.count("*").alias("entries"), F.sum("n_rows").alias("rows"), F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    asked = F.col("hits") + F.col("misses")
    return out.withColumn("hit_rate", F.when(asked > 0, F.round(F.col("hits") / asked, 6)).otherwise(F.lit(0.0)))
