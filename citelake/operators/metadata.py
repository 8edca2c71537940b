"""Remote metadata written to library items: which field takes which value.

Items and metadata are one row each; a field that the metadata doesn't have keeps its value. Text fields are null where an item has none, and an empty text of the
metadata counts as none. Defined results: items without metadata stay as they are; repeated ids are an error of the caller; empty tables give none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fields of an item and of its metadata.
ITEM_FIELDS = ["item_type", "title", "abstract", "journal", "journal_abbreviation", "series", "series_number", "volume", "issue", "pages", "date", "doi", "isbn", "publisher", "url", "extra"]
META_FIELDS = ["document_type", "title", "abstract", "journal_abbreviation", "volume", "issue", "pages", "date", "doi", "isbn", "publisher", "arxiv", "category", "arxiv_url"]
DOI_ADDRESS = "https://doi.org/"


def metadata_columns(item: str = "old", meta: str = "new", fields: list[str] | None = None) -> dict[str, Column]:
    """The new value of each field of an item (columns `item`.x, ITEM_FIELDS) by its metadata (`meta`.x, META_FIELDS); only of `fields`, if given.

    Journals go to the abbreviation and, where the item shows none or an arXiv one, to the title of a journal article, to the series of a book, else to the title; volumes
    of books to their number in the series; DOIs of items that have no such field to their address; ISBN, publisher of books and arXiv address only where the item
    has none. A journal article without a published journal isn't shown under its arXiv one any more; the line of the arXiv id in extra is set, once."""
    x = lambda c: F.nullif(F.col(f"{item}.{c}"), F.lit(""))
    m = lambda c: F.nullif(F.col(f"{meta}.{c}"), F.lit(""))
    kind, book = F.coalesce(x("item_type"), F.lit("")), F.coalesce(m("document_type") == "book", F.lit(False))
    article, series = kind == "journalArticle", book & (kind == "book")
    shows_arxiv = F.coalesce(F.contains(F.lower(x("journal")), F.lit("arxiv")), F.lit(False))
    journal = m("journal_abbreviation")
    has_doi = kind.isin("journalArticle", "preprint")
    old_form = F.rlike(m("arxiv"), F.lit(r"^\d"))
    line = F.concat(F.lit("arXiv:"), m("arxiv"), F.when(old_form & m("category").isNotNull(), F.concat(F.lit(" ["), m("category"), F.lit("]"))).otherwise(F.lit("")))
    extra = F.coalesce(x("extra"), F.lit(""))
    lines = F.filter(F.split(extra, "\n"), lambda t: ~F.rlike(t, F.lit(r"(?i)(arXiv:|_eprint:)")) & ~F.rlike(t, F.lit("type: article")))
    kept = F.array_join(lines, "\n")
    with_line = F.when(m("arxiv").isNull(), x("extra")).otherwise(F.when(kept == "", line).otherwise(F.concat(F.regexp_replace(kept, r"\n$", ""), F.lit("\n"), line)))
    set_ = lambda c: F.coalesce(m(c), x(c))
    out = {
        "title": set_("title"), "abstract": set_("abstract"), "issue": set_("issue"), "date": set_("date"),
        "journal_abbreviation": F.when(article, F.coalesce(journal, x("journal_abbreviation"))).otherwise(x("journal_abbreviation")),
        "journal": F.when(journal.isNull(), F.when(m("arxiv").isNotNull() & shows_arxiv, None).otherwise(x("journal"))).when(article, F.when(x("journal").isNull() | shows_arxiv, journal).otherwise(x("journal"))).when(series, x("journal")).otherwise(journal),
        "series": F.when(series & journal.isNotNull(), journal).otherwise(x("series")),
        "series_number": F.when(book & m("volume").isNotNull(), m("volume")).otherwise(x("series_number")), "volume": F.when(~book, F.coalesce(m("volume"), x("volume"))).otherwise(x("volume")), "pages": F.when(~book, F.coalesce(m("pages"), x("pages"))).otherwise(x("pages")),
        "doi": F.when(has_doi, F.coalesce(m("doi"), x("doi"))).otherwise(x("doi")), "isbn": F.coalesce(x("isbn"), m("isbn")), "publisher": F.when(kind.isin("book", "bookSection"), F.coalesce(x("publisher"), m("publisher"))).otherwise(x("publisher")),
        "url": F.when(~has_doi & m("doi").isNotNull(), F.concat(F.lit(DOI_ADDRESS), m("doi"))).otherwise(F.coalesce(x("url"), m("arxiv_url"))), "extra": with_line,
    }
    return {c: v for c, v in out.items() if fields is None or c in fields}


def with_metadata(items: DataFrame, meta: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The items (item_id, ITEM_FIELDS) with their metadata (item_id, META_FIELDS) written to them, or to some fields of them."""
    new = metadata_columns(fields=fields)
    met = items.alias("old").join(meta.alias("new"), F.col("old.item_id") == F.col("new.item_id"), "left")
    known = F.col("new.item_id").isNotNull()
    return met.select(*(F.when(known, new[c]).otherwise(F.col(f"old.{c}")).alias(c) if c in new else F.col(f"old.{c}") for c in items.columns))
