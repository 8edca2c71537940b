"""Bibliographies in full texts: where they begin, their numbered entries, the papers in an entry and what is known of each.

An entry is cut into words once, commas and colons being words of their own; what is known of it is read from the classes of neighbouring words: a
name beside initials, a capitalized run before a volume and a page, a year.

Defined results: a null text has no entries; of entries with one label the first counts; repeated ids are one document; what isn't
found is null; empty tables give none."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from citelake.functions import text as T
from citelake.functions import unlabelled as U
from citelake.functions.places import bound

#: Headings of a list of references; the greatest label; labels that are years.
HEADINGS = ["references and notes", "references", "bibliography", "literature cited", "参考文献"]
MOST_LABEL, YEARS = 500, (1900, 2099)
#: Labels from which on a list that isn't surely right is of medium confidence, and the share of entries that may hold several papers.
MANY, SEVERAL = 10, 0.3
#: Words that begin with a capital in entries and are no names; beginnings of journals' names.
NO_NAMES = ["Phys", "Rev", "Lett", "Nucl", "Part", "Theor", "Prog", "Report"]
JOURNALS = ["phys", "nucl", "ann", "physica", "rev", "lett", "j."]
_LABEL = r"(?m)^[^\S\n]*\[(\d{1,4})\][^\S\n]*"
#: Classes of words.
_NAME, _INITIALS, _CAPITAL = r"^[A-Z][a-z]+(?:[-'’][A-Z][a-z]+)*$", r"^(?:[A-Z]\.?-?)+\.$|^[A-Z]$", r"^[A-Z][A-Za-z.-]*$"
_VOLUME, _PAGE, _YEAR = r"^[A-Z]?\d{1,4}$", r"^[A-Za-z]?\d{1,6}(?:[-–]\d{1,6})?\.?$", r"^(?:19|20)\d{2}$"


def section(text: Column) -> Column:
    """What follows the last heading of a list of references; the whole text without one."""
    listed = "|".join(r"\s+".join(x.split()) for x in HEADINGS)
    parts = F.split(text, rf"(?im)^[^\S\n]*(?:\d+\.?[^\S\n]+)?(?:{listed})[^\S\n]*:?[^\S\n]*$")
    return bound(parts, lambda p: F.when(F.size(p) > 1, F.element_at(p, -1)).otherwise(text))


def entries(docs: DataFrame) -> DataFrame:
    """(id, label, text, place): the entries that begin a line with a number in brackets, and which of the lines with labels it is. docs: id, text.

    A text's part before its first label is no entry; labels above MOST_LABEL and those that are years are none."""
    own = docs.select("id", "text").repartition("id").select("id", section(F.coalesce("text", F.lit(""))).alias("_s"))
    labels = F.regexp_extract_all("_s", F.lit(_LABEL), F.lit(1))
    pairs = bound(F.split("_s", _LABEL, -1), lambda cut: F.transform(labels, lambda n, i: F.struct(n.cast("int").alias("label"), F.regexp_replace(F.get(cut, i + 1), r"^\s+|\s+$", "").alias("text"), i.alias("place"))))
    each = own.select("id", F.explode(pairs).alias("e")).select("id", "e.*")
    fits = F.col("label").between(1, MOST_LABEL) & ~F.col("label").between(*YEARS)
    return each.filter(fits).groupBy("id", "label").agg(F.min_by("text", "place").alias("text"), F.min("place").alias("place"))


def words_of(text: Column, bare: bool = False) -> Column:
    """The words of an entry; bare: without what stands in parentheses."""
    text = F.regexp_replace(text, r"\([^)]*\)", " ") if bare else text
    return F.filter(F.split(F.regexp_replace(text, "([,:])", " $1 "), r"[\s()]+"), lambda w: w != "")


def doi_in(text: Column) -> Column:
    found = F.regexp_extract(text, r"10\.\d{4,9}/[^\s;]+", 0)
    return F.nullif(F.regexp_replace(found, r"[\W_]+$", ""), F.lit(""))


def arxiv_in(text: Column) -> Column:
    """An arXiv id of the new form where arXiv is named, or of the old form."""
    new = F.when(F.rlike(text, F.lit("(?i)arxiv")), F.regexp_extract(text, r"(?<![\d./])\d{4}\.\d{4,5}(?!\d)|(?<=/)\d{4}\.\d{4,5}(?!\d)", 0))
    old = F.lower(F.regexp_extract(text, r"(?i)(?<![a-z])[a-z]+(?:-[a-z]+)?(?:\.[a-z]{2})?/\d{7}(?!\d)", 0))
    return F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")))


def _is(word: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(word, F.lit(pattern)), F.lit(False))


def person_in(words: Column) -> Column:
    """The first last name beside initials or before et al."""

    def named(words: Column, w: Column, i: Column) -> Column:
        before, next_, after = F.get(words, i - 1), F.get(words, i + 1), F.get(words, i + 2)
        beside = (_is(before, _INITIALS) & (i > 0)) | (_is(next_, "^,$") & _is(after, _INITIALS)) | (_is(next_, "(?i)^et$") & _is(after, "(?i)^al"))
        return F.when(_is(w, _NAME) & ~_is(w, "^(?:Collaboration|Group)$") & beside, w)

    return bound(words, lambda ws: F.get(F.filter(F.transform(ws, lambda w, i: named(ws, w, i)), lambda x: x.isNotNull()), F.lit(0)))


def group_in(words: Column) -> Column:
    """The word before Collaboration."""
    return bound(words, lambda ws: F.get(F.filter(F.transform(ws, lambda w, i: F.when(_is(w, "(?i)^collaboration") & (i > 0), F.get(ws, i - 1))), lambda x: x.isNotNull()), F.lit(0)))


def author_in(text: Column) -> Column:
    """The first author's last name: a Chinese or Korean family name, a name beside initials, a collaboration, or the first long capitalized word."""
    chinese, korean = F.regexp_extract(text, "^[一-鿿㐀-䶿]{2,4}", 0), F.regexp_extract(text, "^[가-힯]{2,5}", 0)
    long = lambda words: F.get(F.filter(F.transform(words, lambda w: F.regexp_extract(w, "[A-Z][a-z]{3,}", 0)), lambda w: w != ""), F.lit(0))
    western = bound(words_of(text), lambda words: F.coalesce(person_in(words), group_in(words), bound(long(words), lambda x: F.when(~x.isin(NO_NAMES), x))))
    return F.coalesce(
        F.nullif(F.left(chinese, F.lit(1)), F.lit("")), F.when(F.length(korean) > 2, F.left(korean, F.lit(2))), F.nullif(F.left(korean, F.lit(1)), F.lit("")),
        western,
    )


def publication_in(text: Column) -> Column:
    """(journal, volume, page): the first volume with a page behind and capitalized words before it; null if there is none."""

    def at(words: Column, w: Column, i: Column) -> Column:
        next_, after = F.get(words, i + 1), F.get(words, i + 2)
        page = F.when(_is(next_, _PAGE), next_).when(_is(next_, "^,$") & _is(after, _PAGE), after)
        return F.when(_is(w, _VOLUME) & (i > 0) & _is(F.get(words, i - 1), _CAPITAL), F.struct(i.alias("at"), w.alias("volume"), page.alias("page")))

    def known(words: Column, first: Column) -> Column:
        start = F.coalesce(F.array_max(F.transform(words, lambda w, i: F.when((i < first["at"]) & ~_is(w, _CAPITAL), i))) + 1, F.lit(0))
        journal = bound(start, lambda x: F.array_join(F.slice(words, x + 1, first["at"] - x), " "))
        return F.when(first.isNotNull(), F.struct(journal.alias("journal"), F.regexp_replace(first["volume"], "^[A-Z]", "").alias("volume"), F.regexp_extract(first["page"], r"^[A-Za-z]?\d+", 0).alias("page")))

    found = lambda words: F.get(F.filter(F.transform(words, lambda w, i: at(words, w, i)), lambda x: x["page"].isNotNull()), F.lit(0))
    return bound(words_of(text, bare=True), lambda words: bound(found(words), lambda first: known(words, first)))


def year_in(text: Column) -> Column:
    """The last year of an entry."""
    return F.try_element_at(F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda w: _is(w, _YEAR)), F.lit(-1))


def looks_like_reference(text: Column) -> Column:
    """Whether a text has a year, and an author or a journal with volume and page."""
    author = bound(words_of(text), lambda words: person_in(words).isNotNull() | F.exists(words, lambda w: _is(w, "(?i)^collaboration")))
    listed = F.lit(False) if not JOURNALS else F.exists(F.split(F.lower(publication_in(text)["journal"]), " "), lambda w: _is(w, "^(?:" + "|".join(x.replace(".", r"\.") for x in JOURNALS) + ")"))
    return (F.length(text) >= 5) & year_in(text).isNotNull() & (author | F.coalesce(listed, F.lit(False)))


def by_years(text: Column) -> Column:
    """An entry's stretches that end with a year each, where they look like references of their own; what follows the last year is none."""
    year = r"(?<![A-Za-z0-9_])(?:19|20)\d{2}(?![A-Za-z0-9_])"
    years = F.regexp_extract_all(text, F.lit(f"({year})"), F.lit(1))
    stretches = bound(F.split(text, year, -1), lambda between: F.transform(years, lambda y, i: F.trim(F.concat_ws(" ", F.get(between, i), y))))
    return F.filter(stretches, looks_like_reference)


def papers_in(found: DataFrame, split_years: bool = True) -> DataFrame:
    """(id, label, part, text, is_erratum, doi, arxiv, journal, volume, page, author, year): the papers of each entry, which semicolons part, or years.

    A part between semicolons counts if it looks like a reference or holds a year, DOI or arXiv id. With fewer than two such parts the stretches up to each
    year are papers, if two or more look like references (by_years; not without split_years); else the entry is one paper. A part without an author has that
    of the part before."""
    parts = F.transform(F.split("text", r";\s*"), lambda p: F.trim(p))
    counts = lambda p: year_in(p).isNotNull() | doi_in(p).isNotNull() | arxiv_in(p).isNotNull() | F.contains(F.lower(p), F.lit("doi"))
    # A part that looks like a reference holds a year.
    good = F.filter(parts, counts)
    several = F.rlike("text", F.lit(r"(?s)(?:19|20)\d{2}.*(?:19|20)\d{2}"))  # fewer years are fewer than two stretches
    dated = F.when(several, bound(by_years(F.col("text")), lambda d: F.when(F.size(d) >= 2, d).otherwise(F.array("text")))).otherwise(F.array("text")) if split_years else F.array("text")
    each = found.select("id", "label", F.posexplode(bound(good, lambda g: F.when(F.size(g) >= 2, g).otherwise(dated))).alias("part", "text"))
    text = F.col("text")
    known = each.withColumn("_p", publication_in(text)).select(
        "id", "label", "part", "text", F.rlike(text, F.lit(r"(?i)\(E\)|erratum")).alias("is_erratum"), doi_in(text).alias("doi"), arxiv_in(text).alias("arxiv"),
        F.col("_p.journal").alias("journal"), F.col("_p.volume").alias("volume"), F.col("_p.page").alias("page"), author_in(text).alias("author"), year_in(text).alias("year"),
    )
    before = Window.partitionBy("id", "label").orderBy("part")  # an entry's parts are few
    return known.withColumn("author", F.last("author", ignorenulls=True).over(before))


#: What a bibliography without labels must have to be one: characters, entries and keys; the shares of keys with journals above which it is of high
#: and of medium confidence.
CHARACTERS, FEWEST, MOSTLY, PARTLY = 500, 5, 0.7, 0.4
_UNLABELLED = ["authors", "year", "journal", "volume", "page", "doi", "arxiv", "text"]


def unlabelled_entries(docs: DataFrame) -> DataFrame:
    """(doc, ref, authors, year, journal, volume, page, doi, arxiv, raw): the entries of bibliographies without labels (see functions.unlabelled), ref being their place.
    A null text has none; docs: id (distinct), text."""
    kind = docs.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [U.entries(t) for t in batch.column("_s").to_pylist()]
            owner = pa.array([i for i, own in enumerate(found) for _ in own], pa.int64())
            place = pa.array([k for own in found for k in range(len(own))], pa.int32())
            values = [pa.array([getattr(e, c) for own in found for e in own], pa.list_(pa.string()) if c == "authors" else pa.string()) for c in _UNLABELLED]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(owner), place, *values], names=["doc", "ref", *_UNLABELLED[:-1], "raw"])

    schema = f"doc {kind}, ref int, authors array<string>, year string, journal string, volume string, page string, doi string, arxiv string, raw string"
    return docs.select("id", section(F.col("text")).alias("_s")).mapInArrow(read, schema)


def unlabelled_confidence(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, n_entries, n_keys, confidence): of documents whose bibliography is long enough and has FEWEST entries and keys (first author and year, as they are and
    without accents), how far it is to be trusted, by the entries with journals for each key. found: unlabelled_entries of docs."""
    long = docs.filter(F.length(section(F.col("text"))) >= CHARACTERS).select(F.col("id").alias("doc"))
    key = F.lower(F.concat(F.get("authors", F.lit(0)), F.lit(" "), F.col("year")))
    plain = F.array_distinct(F.array(key, T.fold(key)))
    # A document's keys are no more than twice its entries, which were in one row before.
    own = found.select("doc", "journal", F.array_compact(plain).alias("_k")).groupBy("doc").agg(F.count("*").alias("n_entries"), F.count("journal").alias("_j"), F.size(F.array_distinct(F.flatten(F.collect_set("_k")))).cast("long").alias("n_keys"))
    met = long.join(own, "doc").filter((F.col("n_entries") >= FEWEST) & (F.col("n_keys") >= FEWEST))
    return met.select("doc", "n_entries", "n_keys", F.when(F.col("_j") > F.col("n_keys") * MOSTLY, "high").when(F.col("_j") > F.col("n_keys") * PARTLY, "medium").otherwise("low").alias("confidence"))


def confidence(found: DataFrame, papers: DataFrame) -> DataFrame:
    """(id, labels, confidence): high if each label is the one before plus one, wherever they begin, and at most SEVERAL of the entries hold several
    papers; else medium from MANY labels on, else low."""
    several = papers.groupBy("id", "label").agg(F.count("*").alias("_n"))
    met = found.select("id", "label", "place").join(several, ["id", "label"], "left")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda x: x["label"])  # a document has at most MOST_LABEL labels
    out = met.groupBy("id").agg(F.count("*").alias("labels"), listed.alias("_labels"), F.count_if(F.col("_n") > 1).alias("_several"))
    runs = ~F.exists(F.transform("_labels", lambda x, i: F.when(i > 0, x - F.get(F.col("_labels"), i - 1))), lambda d: F.coalesce(d != 1, F.lit(False)))
    return out.select("id", "labels", F.when(runs & (F.col("_several") <= SEVERAL * F.col("labels")), "high").when(F.col("labels") >= MANY, "medium").otherwise("low").alias("confidence"))
