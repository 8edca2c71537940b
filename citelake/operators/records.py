"""Records: search, duplicates, matching, field differences, watched preprints, cache entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from citelake.functions import authors as A
from citelake.functions import identifiers as I
from citelake.functions import text as T
from citelake.operators import matching as M
from citelake.operators.pairs import pairs_of


def text_filter(rows: DataFrame, query: str, column: str = "search_text", journals: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows whose search text holds, of every token of the query, one of its forms."""
    fits = [reduce(lambda a, b: a | b, [F.contains(F.col(column), F.lit(v)) for v in T.query_variants(t, q, journals)], F.lit(False)) for t, q in T.query_tokens(query)]
    return rows.filter(reduce(lambda a, b: a & b, fits, F.lit(True)))


def find_duplicates(entries: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """(id, item_id, match): for each entry the library item that it equals in the first of `keys` that meets one; the smallest item id of several.

    entries: id and the keys; items: item_id and the keys. Null keys meet nothing."""
    found = []
    for k, key in enumerate(keys):
        own = items.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("item_id").alias("item_id"))
        found.append(entries.select("id", key).join(own, key).select("id", "item_id", F.lit(k).alias("order"), F.lit(key).alias("match")))
    best = reduce(DataFrame.union, found).groupBy("id").agg(F.min(F.struct("order", "item_id", "match")).alias("best"))
    return best.select("id", "best.item_id", "best.match")


def field_changes(local: DataFrame, remote: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, local_value, remote_value, was_empty): fields whose remote value isn't empty and differs in comparable form."""
    a = local.select(F.col(key).alias("_k"), *(F.col(f).cast("string").alias(f"_l_{f}") for f in fields))
    b = remote.select(key, *(F.col(f).cast("string").alias(f"_r_{f}") for f in fields))
    met = b.join(a, F.col(key) == F.col("_k"))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_l_{f}").alias("local_value"), F.col(f"_r_{f}").alias("remote_value")) for f in fields))
    long = met.select(key, F.explode(pairs).alias("x")).select(key, "x.*")
    differs = (T.comparable(F.col("remote_value")) != "") & (T.comparable(F.col("local_value")) != T.comparable(F.col("remote_value")))
    return long.filter(differs).withColumn("was_empty", T.comparable(F.col("local_value")) == "")


def protect(changes: DataFrame, protected: list[str]) -> DataFrame:
    """Changes without those to protected fields that hold something."""
    return changes.filter(~(F.col("field").isin(protected) & ~F.col("was_empty")))


def merge_creators(local: DataFrame, remote: DataFrame, protected: list[str]) -> DataFrame:
    """(item, pos, name, kept): remote names, in place of which the local one stays if it is protected or has the accents that the remote lacks.

    Names meet by their folded form within an item; of several local ones the last counts."""
    own = local.select("item", T.fold(F.col("name")).alias("_key"), "pos", F.col("name").alias("_local")).groupBy("item", "_key").agg(F.max_by("_local", "pos").alias("_local"))
    met = remote.select("item", "pos", "name", T.fold(F.col("name")).alias("_key")).join(own, ["item", "_key"], "left")
    names = [x.lower() for x in protected if x]
    stays = F.col("_local").isNotNull() & (F.lower("_local").isin(names) | ((T.fold(F.col("_local")) != F.lower("_local")) & (F.lower("_local") != F.lower("name"))))
    return met.select("item", "pos", F.when(stays, F.col("_local")).otherwise(F.col("name")).alias("name"), stays.alias("kept"))


def is_unpublished(item_type: Column, journal: Column, doi: Column, extra: Column, volume: Column, pages: Column) -> Column:
    """Whether an item is a preprint still, or a publication with parts missing."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    real = filled(doi) & ~I.is_arxiv_doi(doi)
    preprint = F.coalesce(F.rlike(journal, F.lit("(?i)^arxiv:")), F.lit(False))
    done = real & filled(volume) & filled(pages)
    mentioned = F.coalesce(F.contains(extra, F.lit("arXiv:")), F.lit(False)) | I.is_arxiv_doi(doi)
    return (item_type == "journalArticle") & F.when(preprint, ~done).otherwise(~filled(journal) & mentioned)


def latest_state(changes: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key in the given order, pre-aggregated: a hot key costs no task more than its share."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return changes.groupBy(key).agg(last.alias("_last")).select(key, *(F.col(f"_last.{c}") for c in columns))


def upsert(state: DataFrame, changes: DataFrame, key: str, order: list[str], columns: list[str], drop: Column | None = None) -> DataFrame:
    """The state after changes: the later of both for each key, without rows for which `drop` holds."""
    out = latest_state(state.select(key, *columns).union(changes.select(key, *columns)), key, order, columns)
    return out if drop is None else out.filter(~F.coalesce(drop, F.lit(False)))


#: Version of cache entries; hours that a kind of entry is good for, -1 for ever.
VERSION, HOURS = 2, {"refs": -1, "graph": -1, "profile": 2}


def ttl_hours(kind: Column, other: int = 24) -> Column:
    return F.coalesce(*(F.when(kind == k, h) for k, h in HOURS.items()), F.lit(other))


def cache_status(entries: DataFrame, now: Column, other: int = 24) -> DataFrame:
    """entries (kind, version, complete, total, n_rows, ts) with age_hours, status (bad, expired, valid) and whole (sorting it locally is right)."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("ts"))) / 3_600_000_000
    ttl = ttl_hours(F.col("kind"), other)
    bad = (F.coalesce("version", F.lit(0)) != VERSION) | ~F.coalesce("complete", F.lit(False))
    status = F.when(bad, "bad").when((ttl > 0) & (age > ttl), "expired").otherwise("valid")
    return entries.withColumn("age_hours", F.floor(age + 0.5)).withColumn("status", status).withColumn("whole", F.coalesce(F.col("total") <= F.col("n_rows"), F.lit(True)))


def purge(entries: DataFrame, now: Column, other: int = 24) -> DataFrame:
    return cache_status(entries, now, other).filter(F.col("status") == "valid")


#: What equal parts are worth in a match.
ARXIV, DOI, AUTHOR, AUTHOR_PART, AUTHOR_IN_LINE, PAGE, JOURNAL = 10.0, 9.0, 4.0, 3.0, 2.0, 2.0, 4.0
YEARS = {0: 2.0, 1: 1.5, 2: 1.0, 3: 0.5}
_PARTS = ["arxiv", "doi", "author", "year", "page", "journal", "volume"]


def normal_parts(rows: DataFrame, parsed: bool) -> list[Column]:
    """The columns arxiv, doi, author, year, page, journal, volume in the forms in which they are compared, and text: of a parsed reference what it says (its
    column raw, if there is one), of an entry its authors' line (line). An entry's author is a whole name, a parsed one a last name."""
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    author = F.col("author") if parsed else A.last_name(F.col("author"))
    more = "raw" if parsed else "line"
    text = F.lower(F.col(more)) if more in rows.columns else F.lit(None).cast("string")
    return [
        I.arxiv_id(F.col("arxiv")).alias("arxiv"), I.doi(F.col("doi")).alias("doi"), A.compact(author).alias("author"), F.col("year").cast("int").alias("year"), filled("page").alias("page"),
        M.journal_key(F.col("journal")).alias("journal"), filled("volume").alias("volume"), text.alias("text"),
    ]


def match_score(a: str = "a_", b: str = "b_") -> Column:
    """How well a parsed reference (columns a_*) fits an entry (b_*), both as normal_parts gives them.

    Equal arXiv ids or DOIs decide; otherwise parts add up: the author (equal, a part, or only named in the authors' line, or both speak of a data group), the
    year by its distance, the page, and the publication, which fits by journal and volume (and page, if both have one) or by volume and page."""
    x, y = (lambda c: F.col(a + c)), (lambda c: F.col(b + c))
    same = lambda c: F.coalesce(x(c) == y(c), F.lit(False))
    sure = lambda c: F.coalesce(c, F.lit(False))
    group = sure(F.contains(x("text"), F.lit("data group")) & F.contains(y("text"), F.lit("data group")))
    named = sure(F.contains(y("text"), x("author"))) | group
    part = sure(F.contains(y("author"), x("author")) | F.contains(x("author"), y("author")))
    author = F.when(same("author"), AUTHOR).when(part, AUTHOR_PART).when(named, AUTHOR_IN_LINE).otherwise(0.0)
    delta = F.abs(x("year") - y("year"))
    year = F.coalesce(*(F.when(delta == k, v) for k, v in YEARS.items()), F.lit(0.0))
    fits = x("journal").isNotNull() & M.publication_matches(M.keys_similar(x("journal"), y("journal")), x("volume") == y("volume"), x("page") == y("page"))
    return F.when(same("arxiv"), ARXIV).when(same("doi"), DOI).otherwise(author + year + F.when(same("page"), PAGE).otherwise(0.0) + F.when(fits, JOURNAL).otherwise(0.0))


def scored_pairs(parsed: DataFrame, entries: DataFrame, least: float = 3.0) -> DataFrame:
    """(doc, ref, entry, score, a_*, b_*): the pairs of parsed references and entries of one document that score at least `least`, with the forms in which they
    were compared (see normal_parts).

    Pairs are made only where a key is shared that a score of `least` (3 or more) can't do without: arXiv id, DOI, a part of the author, volume, page,
    or a year at most two away together with a part of the authors' line (or a data group). Null and empty parts are equal to nothing;
    empty tables give none. parsed: doc, ref and entries: doc, entry, both with arxiv, doi, author, year, page,
    journal, volume; parsed may have raw (its text), entries line (all authors). (doc, ref) and (doc, entry) don't repeat."""
    if least < 3:
        raise ValueError("scores below 3 need no shared key")
    listed = lambda *c: F.array_compact(F.array(*c))
    key = lambda kind, c: F.concat(F.lit(f"{kind} "), c)

    def keys(p: str, left: bool) -> Column:
        plain = listed(*(key(c, F.col(p + c)) for c in ("arxiv", "doi", "volume", "page")))
        years = F.transform(F.array(*map(F.lit, range(-2, 3) if left else [0])), lambda k: (F.col(p + "year") + k).cast("string"))
        own, group = F.left(p + "author", F.lit(3)), F.when(F.contains(F.col(p + "text"), F.lit("data group")), F.array(F.lit("data group")))
        short = F.length(p + "author") < 3  # such an author may stand anywhere
        if left:
            said = F.array_compact(F.array(F.when(short, F.lit("any")).otherwise(own)))
        else:
            line = F.coalesce(p + "text", F.lit(""))
            said = F.when(line != "", F.concat(F.array(F.lit("any")), F.transform(F.sequence(F.lit(1), F.greatest(F.length(line) - 2, F.lit(1))), lambda i: F.substr(line, i, F.lit(3)))))
        said = F.concat(F.coalesce(said, F.array().cast("array<string>")), F.coalesce(group, F.array().cast("array<string>")))
        dated = F.flatten(F.transform(F.array_compact(years), lambda y: F.transform(F.array_distinct(said), lambda t: F.concat(F.lit("said "), y, F.lit(" "), t))))
        return F.concat(plain, T.part_keys(F.col(p + "author"), left), dated)

    # The normal forms are wanted twice: for the keys, and for the score.
    a = parsed.select("doc", "ref", *normal_parts(parsed, True))
    b = entries.select("doc", "entry", *normal_parts(entries, False))
    named = lambda rows, name, p: rows.select("doc", name, *(F.col(c).alias(p + c) for c in [*_PARTS, "text"]))
    met = pairs_of(named(a, "ref", "a_"), named(b, "entry", "b_"), ["ref", "entry"], keys("a_", True), keys("b_", False))
    return met.select("*", F.explode(F.filter(F.array(match_score()), lambda x: x >= least)).alias("score"))


def best_matches(parsed: DataFrame, entries: DataFrame, least: float = 3.0) -> DataFrame:
    """(doc, ref, entry, score): each parsed reference's best entry of the same document, if it scores at least `least` (3 or more; see scored_pairs); of equal
    scores the first entry counts."""
    best = F.max_by(F.struct("entry", "score"), F.struct(F.col("score"), -F.col("entry")))
    return scored_pairs(parsed, entries, least).groupBy("doc", "ref").agg(best.alias("b")).select("doc", "ref", "b.entry", "b.score")
