"""Column functions on identifiers: arXiv ids, DOIs, record numbers, sortable keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Forms of arXiv ids (since 2007, before 2007), and prefixes that are taken off.
NEW_ID, OLD_ID = r"^\d{4}\.\d{4,5}$", r"^[a-z-]+/\d{7}$"
ARXIV_DOI = "10.48550/arxiv"


def arxiv_id(value: Column) -> Column:
    """An arXiv id without address, prefix, version and file ending, in lower case; null if it doesn't look like one."""
    out = F.lower(F.trim(value))
    for pattern in (r"^https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/", r"^arxiv\s*:\s*", r"v\d{1,2}$", r"\.pdf$"):
        out = F.regexp_replace(out, pattern, "")
    return F.when(F.rlike(out, F.lit(r"^\d{4}\.\d+|^[a-z-]+/\d+")), out)


def doi(value: Column) -> Column:
    """A DOI in lower case without closing punctuation; null if it is empty."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(value), r"[),.;]+$", "")), F.lit(""))


def is_arxiv_doi(value: Column) -> Column:
    return F.coalesce(F.startswith(F.lower(value), F.lit(ARXIV_DOI)), F.lit(False))


def record_number(url: Column) -> Column:
    """The number that ends a URL's path, a file ending or slash after it aside; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"^[^?#]*/(\d+)(?:\.[a-z]+)?/?(?:[?#].*)?$", 1), F.lit(""))


def padded(count: Column, width: int = 10) -> Column:
    """A count as a text that sorts like the number; empty for null and negative ones."""
    text = F.floor(count).cast("string")
    return F.when(count >= 0, F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))).otherwise(F.lit(""))


def arxiv_sort_key(value: Column, width: int = 6) -> Column:
    """Year, month and padded number of an arXiv id, so that ids sort by time; digits alone for odd forms."""
    bare = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"(?i)v\d+$", "")
    century = lambda yy: F.when(yy.cast("int") >= 91, F.concat(F.lit("19"), yy)).otherwise(F.concat(F.lit("20"), yy))
    new, old = r"^(\d{2})([01]\d)\.(\d{4,5})$", r"(?i)^[a-z-]+/(\d{2})([01]\d)(\d{3})$"
    key = lambda p: F.concat(century(F.regexp_extract(bare, p, 1)), F.regexp_extract(bare, p, 2), F.lpad(F.regexp_extract(bare, p, 3), width, "0"))
    digits = F.regexp_replace(bare, r"\D", "")
    long = F.when(F.length(digits) >= 11, digits).otherwise(F.lpad(digits, 11, "0"))
    return F.when(F.rlike(bare, F.lit(new)), key(new)).when(F.rlike(bare, F.lit(old)), key(old)).when(digits != "", long).otherwise(bare)


def first_identifier(*named: tuple[str, Column]) -> Column:
    """The first identifier that is there, as struct (kind, value); null if none is."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit("")) != "", F.struct(F.lit(kind).alias("kind"), c.alias("value"))) for kind, c in named))
