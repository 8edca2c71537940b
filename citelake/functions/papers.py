"""Column functions over papers: values with their defaults, review and publication classes, buckets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Keys of review journals by substring and by prefix, after all but letters and digits is taken out.
REVIEW_JOURNALS = ["rmp", "revmodphys", "reviewsofmodernphysics", "physrep", "physrept", "physicsreports", "ppnp", "progpartnuclphys", "progressinparticleandnuclearphysics", "rpp", "repprogphys", "reptprogphys", "reportsonprogressinphysics"]
ANNUAL_REVIEWS = ["annualreview", "annurev", "annrev"]
#: A word's edges in ASCII, so that a letter outside ASCII doesn't count as part of a word.
_EDGE_LEFT, _EDGE_RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def citations(missing: int | None = -1) -> Column:
    """Citations without self-citations, else all citations, else `missing`."""
    return F.coalesce(F.col("citation_count_wo_self"), F.col("citation_count"), F.lit(missing).cast("long"))


def year_number(year: Column) -> Column:
    """The year if it is a number as a whole, else null."""
    return year.try_cast("int")


def leading_int(text: Column) -> Column:
    """The integer that a text begins with, else null."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def base_year(year: Column) -> Column:
    """A year without its letter suffix; null for an empty one."""
    return F.nullif(F.regexp_replace(year, "(?i)[a-z]$", ""), F.lit(""))


def is_general_review_title(title: Column) -> Column:
    """Whether a title names the field's general review, which too many papers cite."""
    return F.coalesce(F.rlike(title, F.lit(f"(?i){_EDGE_LEFT}review of particle physics{_EDGE_RIGHT}")), F.lit(False))


def is_review_type(document_type: Column) -> Column:
    return F.coalesce(F.exists(document_type, lambda t: F.rlike(t, F.lit(f"(?i){_EDGE_LEFT}review{_EDGE_RIGHT}"))), F.lit(False))


def is_review_journal(journal: Column) -> Column:
    key = F.regexp_replace(F.lower(journal), "[^a-z0-9]+", "")
    return F.coalesce(F.rlike(key, F.lit(f"^({'|'.join(ANNUAL_REVIEWS)})|{'|'.join(REVIEW_JOURNALS)}")), F.lit(False))


def is_review(document_type: str = "document_type", journal: str = "journal_title") -> Column:
    return is_review_type(F.col(document_type)) | is_review_journal(F.col(journal))


def is_published(journal: Column) -> Column:
    return F.coalesce(journal != "", F.lit(False))


def has_arxiv(arxiv_id: Column) -> Column:
    return F.coalesce(F.trim(arxiv_id) != "", F.lit(False))


def anchor_weight(cites: Column) -> Column:
    """1 / (1 + ln(1 + c)); a quarter if c is unknown or negative."""
    return F.when(cites >= 0, 1 / (1 + F.log1p(cites))).otherwise(F.lit(0.25))


def anchor_bucket(cites: Column) -> Column:
    """How good an anchor is by its citations, best first: 5 to 300, to 1500, unknown, below 5, above 1500."""
    return F.when(cites.isNull() | (cites < 0), 2).when(cites < 5, 3).when(cites <= 300, 0).when(cites <= 1500, 1).otherwise(4)


def cocitation_cosine(together: Column, a: Column, b: Column) -> Column:
    """Papers citing both over the geometric mean of those citing either; within 0 and 1, 0 if any is not positive."""
    fits = (together > 0) & (a > 0) & (b > 0)
    return F.when(fits, F.least(F.lit(1.0), together / F.sqrt(a.cast("double") * b))).otherwise(F.lit(0.0))


def blend_weight(cites: Column) -> Column:
    """The share of co-citation in a blended score: 0 below 5 citations, then half of a sigmoid around 30."""
    return F.when(cites >= 5, 0.5 / (1 + F.exp(-0.15 * (cites - 30)))).otherwise(F.lit(0.0))


def fractional_year(date: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD as a number: the middle of a year, or days (15 if unknown) of months of 30.44 days over 365."""
    part = lambda k: F.regexp_extract(date, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", k).try_cast("int")
    year, month, day = part(1), part(2), part(3)
    return F.when(month.isNull(), year + 0.5).otherwise(year + ((month - 1) * 30.44 + F.coalesce(day, F.lit(15))) / 365)


def node_radius(cites: Column) -> Column:
    """A node's size by its citations."""
    return F.when(cites >= 2000, 14).when(cites >= 500, 12).when(cites >= 100, 10).when(cites >= 50, 8).when(cites >= 10, 7).otherwise(6)
