"""List entries out of literature records, and what is filled into them from other sources.

A record is a nested row: recid, titles (array of struct title), authors (array of struct full_name, ids of struct schema and value,
record), collaborations, author_count, earliest_date, publication_info (array of struct journal_title, journal_title_abbrev, journal_volume,
artid, page_start, page_end, year, material), arxiv_eprints (array of struct value, categories), dois (array of struct value),
texkeys, document_type, citation_count, citation_count_without_self_citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citelake.functions import authors as A
from citelake.functions import papers as P

RECORD = (
    "recid long, titles array<struct<title:string>>, authors array<struct<full_name:string,ids:array<struct<schema:string,value:string>>,record:string>>, collaborations array<string>, author_count int, earliest_date string, "
    "publication_info array<struct<journal_title:string,journal_title_abbrev:string,journal_volume:string,artid:string,page_start:string,page_end:string,year:int,material:string>>, "
    "arxiv_eprints array<struct<value:string,categories:array<string>>>, dois array<struct<value:string>>, texkeys array<string>, document_type array<string>, citation_count long, citation_count_without_self_citations long"
)
#: Titles shorter than this may have been cut, as those that end in a blank or a dash.
SHORT_TITLE = 20


def first_of(array: Column, field: str | None = None) -> Column:
    """The first element (or its field) that is there and holds more than blanks; null if none does."""
    values = array if field is None else F.transform(array, lambda x: x[field])
    return F.try_element_at(F.filter(values, lambda v: F.coalesce(F.rlike(v, F.lit(r"[^\p{Zs}]")), F.lit(False))), F.lit(1))


def without_blanks(text: Column) -> Column:
    """A text without the blanks of any kind (no-break, wide) at its ends."""
    return F.regexp_replace(text, r"\A\p{Zs}+|\p{Zs}+\z", "")


def note_of(info: Column) -> Column:
    """Erratum or Addendum if the material of a publication says so, else null."""
    return F.when(F.rlike(info["material"], F.lit("(?i)erratum")), "Erratum").when(F.rlike(info["material"], F.lit("(?i)addendum")), "Addendum")


def primary_publication(infos: Column) -> Column:
    """The first publication that is no erratum or addendum, else the first of all."""
    return F.coalesce(F.try_element_at(F.filter(infos, lambda i: note_of(i).isNull()), F.lit(1)), F.try_element_at(infos, F.lit(1)))


def publication_line(info: Column, year: Column, journal: bool = True) -> Column:
    """Journal, volume, year in parentheses, article id or pages."""
    name = F.nullif(F.trim(F.regexp_replace(F.coalesce(F.nullif(info["journal_title"], F.lit("")), info["journal_title_abbrev"]), r"\.\s|\.", ". ")), F.lit(""))
    when = F.coalesce(info["year"].cast("string"), F.nullif(F.regexp_extract(F.coalesce(year, F.lit("")), r"\d{4}", 0), F.lit("")), F.nullif(year, F.lit("")))
    start, end = F.nullif(info["page_start"], F.lit("")), F.nullif(info["page_end"], F.lit(""))
    pages = F.when(end.isNotNull() & (end != start), F.concat(start, F.lit("-"), end)).otherwise(start)
    parts = [name] if journal else []
    return F.concat_ws(" ", *parts, F.nullif(info["journal_volume"], F.lit("")), F.concat(F.lit("("), when, F.lit(")")), F.coalesce(F.nullif(info["artid"], F.lit("")), pages))


def publication_summary(infos: Column, arxiv: Column, year: Column) -> Column:
    """The primary publication, the arXiv id in brackets, and errata and addenda in brackets."""
    primary = primary_publication(infos)
    first = F.array_position(F.transform(infos, lambda i: F.coalesce(note_of(i), F.lit(""))), "")  # 0: all are notes
    notes = F.filter(F.transform(infos, lambda i, k: F.when(note_of(i).isNotNull() & ~((first == 0) & (k == 0)), F.concat(note_of(i), F.lit(": "), publication_line(i, year, journal=False)))), lambda x: x.isNotNull())
    main = F.when(primary.isNotNull(), publication_line(primary, year))
    return F.concat_ws(" ", F.nullif(main, F.lit("")), F.concat(F.lit("[arXiv:"), F.nullif(arxiv, F.lit("")), F.lit("]")), F.when(F.size(notes) > 0, F.concat(F.lit("["), F.array_join(notes, "; "), F.lit("]"))))


def author_infos(authors: Column, limit: int = A.ID_LIMIT) -> Column:
    """(full_name, bai, recid) of the first authors, in their places: an author without a name keeps an empty place."""

    def one(a: Column) -> Column:
        bai = first_of(F.filter(a["ids"], lambda i: F.endswith(i["schema"], F.lit("BAI")) & A.is_author_id(i["value"])), "value")
        recid = F.nullif(F.regexp_extract(F.coalesce(a["record"], F.lit("")), r"/authors/(\d+)", 1), F.lit(""))
        named = F.coalesce(a["full_name"] != "", F.lit(False))
        return F.struct(F.coalesce(a["full_name"], F.lit("")).alias("full_name"), F.when(named, bai).alias("bai"), F.when(named, recid).alias("recid"))

    return F.transform(F.slice(authors, F.lit(1), F.when(F.size(authors) > A.LARGE, 1).otherwise(limit)), one)


def entries_of(records: DataFrame, shown: int = A.SHOWN, large: int | None = A.LARGE) -> DataFrame:
    """One list entry for each record, with the first `shown` authors; of more than `large` (None: of no list) only the first is shown."""
    names = F.coalesce(F.filter(F.transform("authors", lambda a: a["full_name"]), lambda n: F.coalesce(n != "", F.lit(False))), F.array().cast("array<string>"))
    total = F.coalesce("author_count", F.size("authors"), F.lit(0))
    people = F.when(F.size(names) > 0, A.capped(names, shown, large)).otherwise(F.slice(F.coalesce("collaborations", F.array().cast("array<string>")), 1, shown))
    info, eprint = primary_publication(F.col("publication_info")), F.try_element_at("arxiv_eprints", F.lit(1))
    year = F.coalesce(F.nullif(F.left("earliest_date", F.lit(4)), F.lit("")), info["year"].cast("string"))
    out = records.select(
        "recid", F.coalesce(without_blanks(first_of(F.col("titles"), "title")), F.lit("No title")).alias("title"), people.alias("authors"), total.cast("int").alias("total_authors"), year.alias("year"), "earliest_date",
        "citation_count", F.col("citation_count_without_self_citations").alias("citation_count_wo_self"), info["journal_title"].alias("journal_title"), eprint["value"].alias("arxiv_id"), eprint["categories"].alias("arxiv_categories"),
        first_of(F.col("dois"), "value").alias("doi"), F.try_element_at("texkeys", F.lit(1)).alias("texkey"), "document_type", publication_summary(F.col("publication_info"), eprint["value"], year).alias("summary"),
    )
    out = out.withColumn("author_text", A.author_line(F.col("authors"), F.col("total_authors"), large=large))
    return out.withColumn("url", entry_url(F.col("recid"), F.col("doi"), F.col("arxiv_id")))


def entry_url(recid: Column, doi: Column, arxiv: Column, base: str = "https://records.example/literature/") -> Column:
    """A record's own address, else its DOI's, else that of its arXiv id."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.concat(F.lit(base), recid.cast("string")), F.concat(F.lit("https://doi.org/"), filled(doi)), F.concat(F.lit("https://arxiv.org/abs/"), filled(arxiv)))


def is_complete() -> Column:
    """Whether a record has a title, authors or collaborations, and a citation count."""
    people = (F.coalesce(F.size("authors"), F.lit(0)) > 0) | (F.coalesce(F.size("collaborations"), F.lit(0)) > 0)
    return first_of(F.col("titles"), "title").isNotNull() & people & F.col("citation_count").isNotNull()


def enrich(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Entries (recid, title, authors, total_authors, year, doi, citation_count, author_text) with what their records know better.

    Counts are always taken over; a title if there is none, if it may have been cut, or if it only repeats authors and year; authors and year
    if there are none; the number of authors if it is greater; a DOI if there is none. Entries without a record stay."""
    r = entries_of(records, A.ID_LIMIT).select("recid", *(F.col(c).alias(f"_{c}") for c in ("title", "authors", "total_authors", "year", "doi", "citation_count")))
    met = entries.join(r, "recid", "left")
    title = F.trim(F.coalesce("title", F.lit("")))
    cut = F.rlike(F.coalesce("title", F.lit("")), F.lit("[ —-]$")) | (F.length("title") < SHORT_TITLE)
    repeats = title == F.concat(F.col("author_text"), F.lit(" ("), F.col("year"), F.lit(")"))
    weak = (title == "") | F.coalesce(cut, F.lit(False)) | F.coalesce(repeats, F.lit(False))
    own = {
        "title": F.when(weak & (F.col("_title") != "No title"), F.col("_title")).otherwise(F.col("title")),
        "authors": F.when((F.coalesce(F.size("authors"), F.lit(0)) == 0) & (F.size("_authors") > 0), F.col("_authors")).otherwise(F.col("authors")),
        "total_authors": F.greatest("total_authors", "_total_authors"),
        "year": F.coalesce(F.nullif("year", F.lit("")), "_year"),
        "doi": F.coalesce(F.nullif("doi", F.lit("")), "_doi"),
        "citation_count": F.coalesce("_citation_count", "citation_count"),
    }
    return met.select(*(own.get(c, F.col(c)).alias(c) for c in entries.columns))


def with_second_source(entries: DataFrame, counts: DataFrame) -> DataFrame:
    """Entries whose missing citation counts come from another source: counts (doi, count); DOIs meet in normal form."""
    from citelake.functions.identifiers import doi

    other = counts.select(doi(F.col("doi")).alias("_doi"), F.col("count").alias("_count")).filter("_doi is not null").groupBy("_doi").agg(F.max("_count").alias("_count"))
    met = entries.join(other, doi(F.col("doi")) == F.col("_doi"), "left")
    return met.select(*(F.coalesce("citation_count", "_count").alias(c) if c == "citation_count" else F.col(c) for c in entries.columns))


def find_authors(wanted: DataFrame, profiles: DataFrame) -> DataFrame:
    """(key, author, by): the profile of each wanted author (key, recid, bai, name) by record number, else by author id, else by name.

    Of several profiles with one id or search key the smallest record number counts. profiles: author, bai, name."""
    name = A.search_key(F.col("name"))
    ways = [("recid", F.col("recid").cast("string"), F.col("author").cast("string")), ("bai", F.col("bai"), F.col("bai")), ("name", name, name)]
    out = None
    for k, (by, mine, theirs) in enumerate(ways):
        left = wanted.select("key", mine.alias("_v")).filter("_v <> ''")
        right = profiles.select(theirs.alias("_v"), "author").filter("_v <> ''").groupBy("_v").agg(F.min("author").alias("author"))
        found = left.join(right, "_v").select("key", F.lit(k).alias("_order"), "author", F.lit(by).alias("by"))
        out = found if out is None else out.union(found)
    return out.groupBy("key").agg(F.min(F.struct("_order", "author", "by")).alias("best")).select("key", "best.author", "best.by")
