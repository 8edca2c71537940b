"""Items that remote records may update: whether a preprint was published, which journal an item shows, whose names stay, which entry is meant.

Defined results are said at each function; rows that repeat are judged row by row, and empty tables give none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from citelake.functions import identifiers as I
from citelake.functions import text as T
from citelake.operators.pairs import pairs_of

#: Hours for which a check of a preprint is good; names that end a list of authors.
FRESH_HOURS, ENDINGS = 24, ["others", "et al.", "et al", "and others", "collaboration"]
#: What a matched author, a part of one, its standing in the authors' line, a year and a page earn, and the least mean of what was compared.
AUTHOR, AUTHOR_PART, IN_LINE, YEAR, PAGE, LEAST = 4, 3, 2, 2, 2, 1.5


def publication_of(records: DataFrame) -> DataFrame:
    """(recid, published, journal, volume, page, year, doi): the first publication with a journal that is no erratum, and the first DOI that isn't
    arXiv's; without such a publication all but recid and published are null. records: recid, publication_info, dois (arrays, null for none)."""
    real = lambda p: F.coalesce(p["journal_title"] != "", F.lit(False)) & F.coalesce(p["material"] != "erratum", F.lit(True))
    first = F.get(F.filter("publication_info", real), F.lit(0))
    doi = F.get(F.filter(F.transform("dois", lambda d: d["value"]), lambda d: F.coalesce(d != "", F.lit(False)) & ~I.is_arxiv_doi(d)), F.lit(0))
    out = records.select("recid", first.alias("p"), doi.alias("d"))
    known = F.col("p").isNotNull()
    journal = F.regexp_replace(F.col("p.journal_title"), r"\.\s?", ". ")
    page = F.coalesce(F.nullif(F.col("p.page_start"), F.lit("")), F.col("p.artid"))
    return out.select("recid", F.coalesce(known, F.lit(False)).alias("published"), journal.alias("journal"), F.col("p.journal_volume").alias("volume"), page.alias("page"), F.col("p.year").alias("year"), F.when(known, F.col("d")).alias("doi"))


def is_fresh(checked: Column, now: Column, hours: int = FRESH_HOURS) -> Column:
    """Whether a check (a time, null for none) is less than `hours` old."""
    return F.coalesce((F.unix_micros(now) - F.unix_micros(checked)) < hours * 3_600_000_000, F.lit(False))


def effective_journal(journal: Column, arxiv: Column, category: Column, item_type: Column) -> Column:
    """The journal that an item shows: its own, else, for a journal article with an arXiv id, that id; ids of the new form with their category. Else null."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    shown = F.concat(F.lit("arXiv:"), arxiv, F.when(F.rlike(arxiv, F.lit("^[0-9]")) & filled(category), F.concat(F.lit(" ["), category, F.lit("]"))).otherwise(F.lit("")))
    return F.when(filled(journal), journal).when(filled(arxiv) & F.coalesce(item_type == "journalArticle", F.lit(False)), shown)


def _same_name(a: Column, b: Column) -> Column:
    """Equal but for case and blanks beside points and hyphens, and, if not so, but for accents or their written-out forms, or else but for hyphens
    in the place of blanks and points at the end."""
    tidy = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " "), r"\s*\.\s*", "."), r"\s*-\s*", "-")
    open_ = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[-\s]+", " "), r"\.+$", ""))
    x, y = tidy(a), tidy(b)
    return reduce(lambda p, q: p | q, [F.lower(x) == F.lower(y), open_(x) == open_(y), *(f(x) == g(y) for f in (T.fold, T.expand_umlauts) for g in (T.fold, T.expand_umlauts))])


def author_lists_equal(local: Column, remote: Column) -> Column:
    """Whether two lists of authors (arrays of first, last; a name that isn't parted stands in last) agree as far as the local one goes.

    Entries that end a list (see ENDINGS) don't count; a local list of such alone agrees with any. An empty or null list agrees with an
    empty or null one only."""
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    ends = lambda c: reduce(lambda p, q: p | q, [F.contains(F.lower(F.trim(F.coalesce(c["last"], F.lit("")))), F.lit(x)) for x in ENDINGS])
    own = F.filter(local, lambda c: ~ends(c))
    pairs = F.slice(F.arrays_zip(own.alias("a"), remote.alias("b")), 1, F.least(size(own), size(remote)))
    agree = F.forall(pairs, lambda p: _same_name(p["a"]["first"], p["b"]["first"]) & _same_name(p["a"]["last"], p["b"]["last"]))
    return F.when((size(local) == 0) | (size(remote) == 0), size(local) == size(remote)).when(size(own) == 0, True).otherwise(agree)


def is_protected(first: Column, last: Column, protected: list[str]) -> Column:
    """Whether a name is protected: a part of it, or the whole in either order, equals a protected name, holds it or is held by it.

    An empty part is held by every name, so of names with one part all are protected, if any name is."""
    a, b = (F.lower(F.coalesce(c, F.lit(""))) for c in (first, last))
    whole = [F.trim(F.concat_ws(" ", x, y)) for x, y in ((a, b), (b, a))]
    fits = [reduce(lambda p, q: p | q, [*(w == n for w in whole), *(F.contains(x, F.lit(n)) | F.contains(F.lit(n), x) for x in (a, b))]) for n in (p.lower() for p in protected)]
    return reduce(lambda p, q: p | q, fits, F.lit(False))


def mean_matches(parsed: DataFrame, entries: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc, ref, entry, score): each parsed reference's best entry of the same document by the mean of what author, year and page earn.

    What the reference doesn't have isn't compared, nor is a page where the entry has no publication data; one that has but no page earns nothing for it. Pairs
    are made only where a year, a page or a part of the author is shared, as without one nothing is earned; of equal scores the first entry
    counts. parsed: doc, ref, author, year, page; entries: doc, entry, author (the first one's last name), line (all authors), year, page and, if there is such a
    column, published (whether it has publication data; else those with a page have). Nulls and empty texts earn nothing."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))

    published = F.col("published") if "published" in entries.columns else F.col("page").isNotNull()
    left = parsed.select("doc", "ref", low("author").alias("_a"), F.col("year").alias("_y"), F.col("page").alias("_p"))
    right = entries.select("doc", "entry", low("author").alias("_b"), low("line").alias("_l"), F.col("year").alias("_ey"), F.col("page").alias("_ep"), F.coalesce(published, F.lit(False)).alias("_pub"))
    one = lambda kind, c: F.when(filled(F.col(c)), F.concat(F.lit(f"{kind} "), F.col(c)))
    mine = F.concat(F.array_compact(F.array(one("year", "_y"), one("page", "_p"))), T.part_keys(F.col("_a"), True))
    theirs = F.concat(F.array_compact(F.array(one("year", "_ey"), one("page", "_ep"))), T.part_keys(F.col("_b"), False), T.part_keys(F.col("_l"), False))
    a, b = F.col("_a"), F.col("_b")
    person = F.when(b == "", 0).when(a == b, AUTHOR).when(F.contains(a, b) | F.contains(b, a), AUTHOR_PART).otherwise(0)
    person = F.when(a == "", 0).when((person < AUTHOR_PART) & F.contains(F.col("_l"), a), person + IN_LINE).otherwise(person)
    paged = filled(F.col("_p")) & F.col("_pub")
    earned = person + F.when(filled(F.col("_y")) & F.coalesce(F.col("_y") == F.col("_ey"), F.lit(False)), YEAR).otherwise(0) + F.when(paged & F.coalesce(F.col("_p") == F.col("_ep"), F.lit(False)), PAGE).otherwise(0)
    checks = (a != "").cast("int") + filled(F.col("_y")).cast("int") + paged.cast("int")
    met = pairs_of(left, right, ["ref", "entry"], mine, theirs)
    scored = met.filter(checks > 0).select("doc", "ref", "entry", (earned / checks).alias("score")).filter(F.col("score") >= least)
    best = F.max_by(F.struct("entry", "score"), F.struct(F.col("score"), -F.col("entry")))
    return scored.groupBy("doc", "ref").agg(best.alias("b")).select("doc", "ref", "b.entry", "b.score")
