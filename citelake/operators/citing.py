"""What texts cite: markers, and citations by author and year, a row for each.

Defined results: a null text has none; repeated ids are documents of their own (their rows come once for each); other columns aren't read; empty tables give none."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citelake.functions import citing, markers as M


def markers_in(docs: DataFrame) -> DataFrame:
    """(id, place, kind, raw, labels): the markers of each text (see functions.markers.markers). docs: id, text."""
    return docs.select("id", F.posexplode(M.markers(F.col("text"))).alias("place", "m")).select("id", "place", "m.*")


def loose_labels(docs: DataFrame, *keep: str) -> DataFrame:
    """(id, loose, *keep): the numbers of pieces of text that may be labels where there is no marker. Ranges, lists, numbers after Ref. and after a word like a name
    count, and then all others; where there is none of these, the first number, unless parentheses, formulas or several numbers stand there. Numbers of
    figures, sections and the like (PLACES) count only after Ref. or a name; a text that is only such a one has none. docs: id, text."""
    start, end, places = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])", "|".join(M.PLACES)
    every = lambda p, k=1: F.regexp_extract_all("text", F.lit(p), F.lit(k))
    digits = lambda x: F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1))
    fits = lambda x: F.coalesce(x.try_cast("int").between(1, M.MOST), F.lit(False))
    none = F.array().cast("array<string>")
    # Step by step, so that each is worked out once.
    read = docs.select("id", *keep, F.coalesce("text", F.lit("")).alias("text")).select(
        "id", *keep, "text",
        every(rf"(?i){start}(?:{places})\.?\s*([\d,\s–-]+)").alias("placed"), every(rf"{start}(\d{{1,4}}\s*[–-]\s*\d{{1,4}}){end}").alias("ranges"), every(rf"{start}(\d{{1,4}}(?:\s*,\s*\d{{1,4}})+){end}").alias("lists"),
        F.regexp_extract("text", rf"(?i){start}refs?\.?\s*([\d,\s–-]+)", 1).alias("marked"), every(rf"({start}[A-Z][a-z]+\s+\d{{1,4}}){end}").alias("named"), every(rf"{start}(\d{{1,4}}){end}").alias("alone"), every(rf"{start}(\d+){end}").alias("numbers"),
    )
    spread = lambda a, b: F.when((a >= 1) & (b >= a) & (b <= M.MOST), M.expand_range(a, b)).otherwise(none)
    at = lambda x, k: F.get(digits(x), F.lit(k)).try_cast("int")
    author = lambda x: ~F.rlike(F.lower(F.regexp_extract(x, "^([A-Za-z]+)", 1)), F.lit(f"^(?:{'|'.join(M.NO_CITING)})$"))
    numbers = read.select(
        "id", *keep, "text", "alone", F.flatten(F.transform("placed", digits)).alias("placed"), F.flatten(F.transform("ranges", lambda x: spread(at(x, 0), at(x, 1)))).alias("ranges"),
        F.transform(F.flatten(F.transform("lists", digits)), lambda x: x.try_cast("int").cast("string")).alias("lists"), M.labels_of(F.col("marked")).alias("marked"),
        F.filter(F.transform(F.filter("named", author), lambda x: F.get(digits(x), F.lit(0))), fits).alias("named"), F.size(F.filter("numbers", lambda x: ~F.coalesce(x.try_cast("int").between(1900, 2099), F.lit(False)))).alias("n"),
    )
    free = lambda c: F.filter(c, lambda x: fits(x) & ~F.array_contains("placed", x))
    parted = numbers.select("id", *keep, "text", "n", F.array_distinct(F.concat(free("ranges"), free("lists"), "marked", "named")).alias("explicit"), free("alone").alias("alone"))
    doubtful = F.rlike("text", F.lit(r"[()=+*/^~]|\d\s*-\s*\d|-\s*\d|[αβγδεζηθικλμνξοπρστυφχψωΓΔΘΛΞΠΣΦΨΩ]")) | (F.col("n") >= 2)
    rest = F.when(F.size("explicit") > 0, F.col("alone")).when(doubtful, none).otherwise(F.slice("alone", 1, 1))
    whole = F.rlike("text", F.lit(rf"(?i)^\s*(?:{places})\.?\s*[\d,\s–-]+\s*$"))
    return parted.select("id", *keep, F.when(whole, none).otherwise(F.array_distinct(F.concat("explicit", rest))).alias("loose"))


def selections(docs: DataFrame, lenient: bool = False) -> DataFrame:
    """(id, kind, labels): what pieces of text that readers have marked cite, by the first rule that finds something: labels in brackets, authors with years, a
    bare list of numbers and ranges, raised numbers, numbers that follow a letter at once, and, if `lenient`, loose_labels. A single number that must be a
    range whose dash was lost is written out; pieces without anything aren't returned. docs: id, text."""
    none = F.array().cast("array<string>")
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[\s.,;:()\[\]]+|[\s.,;:()\[\]]+$", ""), r"\s+", "")
    read = docs.select("id", M.repair_brackets(F.coalesce("text", F.lit(""))).alias("text"))
    read = read.select("id", "text", F.regexp_extract_all("text", F.lit(M.BRACKETS), F.lit(1)).alias("held"), M.author_year_citations(F.col("text")).alias("cited"), tidy(F.col("text")).alias("bare"), M.superscripts(F.col("text")).alias("raised"))
    listed = F.when(F.rlike("bare", F.lit(r"^\d{1,4}(?:[,–-]\d{1,4})*$")), F.array("bare")).otherwise(none)
    read = read.select("id", "text", F.when(F.size("held") > 0, F.col("held")).when(F.size("cited") > 0, none).otherwise(listed).alias("numbers"), F.transform("cited", lambda c: F.concat(c["authors"][0], F.lit(" "), c["year"])).alias("cited"), F.array_distinct("raised").alias("raised"))
    read = read.select("id", "text", F.array_distinct(F.flatten(F.transform("numbers", M.labels_of))).alias("numbers"), "cited", "raised")
    plain = (F.size("numbers") == 0) & (F.size("cited") == 0) & (F.size("raised") == 0)
    kinds = F.when(F.size("numbers") > 0, "numeric").when(F.size("cited") > 0, "author-year").when(F.size("raised") > 0, "superscript").otherwise("numeric")
    read = read.select("id", "text", kinds.alias("kind"), F.when(F.size("numbers") > 0, F.col("numbers")).when(F.size("cited") > 0, F.col("cited")).when(F.size("raised") > 0, F.col("raised")).otherwise(M.attached_numbers(F.col("text"))).alias("labels"), plain.alias("plain"))
    if lenient:
        more = loose_labels(read.select("id", "text", "kind", "labels", "plain"), "labels", "kind", "plain")
        read = more.select("id", "kind", F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.col("loose")).alias("labels"), "plain")
    single = (F.size("labels") == 1) & (F.col("kind") == "numeric")
    out = read.filter(F.size("labels") > 0).select("id", "kind", "labels", F.when(single, M.lost_range(F.get("labels", F.lit(0)))).alias("range"))
    return out.select("id", "kind", F.coalesce("range", "labels").alias("labels"))


def citations_in(docs: DataFrame) -> DataFrame:
    """(id, place, authors, initials, et_al, year, label): the citations by author and year of each text, in its order, each first author and year once, read by
    the grammar of functions.citing. initials: those of each author, null where none stand. docs: id, text."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "place", "authors", "initials", "et_al", "year", "label"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, longs = pa.list_(pa.string()), pa.int32()
        for batch in batches:
            found = [citing.citations(t) for t in batch.column("text").to_pylist()]
            rows = [(place, c.authors, c.initials, c.et_al, c.year, c.label()) for own in found for place, c in enumerate(own)]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            owner = pa.array([i for i, own in enumerate(found) for _ in own], pa.int64())
            kinds = [longs, strings, strings, pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(owner), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return docs.select("id", "text").mapInArrow(read, f"id {kind}, place int, authors array<string>, initials array<string>, et_al boolean, year string, label string")
