"""Column functions on citation markers in text: numbers in brackets, ranges, superscripts, author and year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Superscript digits; the greatest span that a range is written out for; bounds of years.
SUPERSCRIPTS, SPAN, LOST_SPAN = "⁰¹²³⁴⁵⁶⁷⁸⁹", 100, 50
BRACKETS = r"\[([\d,\s–-]+)\]"
AUTHOR_YEAR = r"[A-Z][A-Za-z'-]+(?: et al\.?| and [A-Z][A-Za-z'-]+)?,? \(?(?:19|20)\d{2}[a-z]?\)?"


def repair_brackets(text: Column) -> Column:
    """Words that are f, g and between them what a bracket may hold: there the letters were brackets."""
    held = r"[0-9,–\-\s]+"
    return F.regexp_replace(text, rf"(?<!\w)f({held})g(?!\w)", "[$1]")


def expand_range(start: Column, end: Column, span: int = SPAN) -> Column:
    """All numbers of a range as texts; only its ends if it runs backwards or is too long."""
    ends = F.array(start.cast("string"), end.cast("string"))
    return F.when((end < start) | (end - start > span), ends).otherwise(F.transform(F.sequence(start, F.greatest(start, F.least(end, start + span))), lambda x: x.cast("string")))


def labels_of(content: Column) -> Column:
    """The labels of a bracket's content: numbers and ranges between commas, in order."""

    def part(p: Column) -> Column:
        a, b = (F.regexp_extract(p, r"^(\d{1,9})[-–](\d{1,9})$", k).try_cast("int") for k in (1, 2))
        single = F.when(F.rlike(p, F.lit(r"^\d+$")), F.array(p)).otherwise(F.array().cast("array<string>"))
        return F.when(F.rlike(p, F.lit(r"^\d{1,9}[-–]\d{1,9}$")), expand_range(a, b)).otherwise(single)

    return F.flatten(F.transform(F.split(content, ","), lambda p: part(F.regexp_replace(p, r"^\s+|\s+$", ""))))


def bracket_labels(text: Column) -> Column:
    """The distinct labels of all brackets of a text, first ones first."""
    found = F.regexp_extract_all(text, F.lit(BRACKETS), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(found, labels_of)))


def superscripts(text: Column) -> Column:
    """Numbers written as superscripts; neighbouring digits are one number."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"([{SUPERSCRIPTS}]+)"), F.lit(1)), lambda x: F.translate(x, SUPERSCRIPTS, "0123456789"))


def lost_range(label: Column, known: Column | None = None) -> Column:
    """The labels of a range whose dash was lost (6264 for 62-64); null if the number is a label or year itself.

    With the greatest known label, a greater number of three digits or more is split; without, only four digits that
    aren't a year and fall into two numbers below 100. The first place that gives a rising range of at most LOST_SPAN counts."""
    n = F.when(F.rlike(label, F.lit(r"^\d{3,9}$")), label.try_cast("int"))
    is_year = (F.length(label) == 4) & n.between(1500, 2099)
    has = F.lit(False) if known is None else F.coalesce(known > 0, F.lit(False))
    top = F.lit(99) if known is None else F.when(has, known).otherwise(F.lit(99))
    eligible = n.isNotNull() & ~is_year & F.when(has, n > top).otherwise((F.length(label) >= 4) & (n >= 1000))

    def at(i: int) -> Column:
        head, tail = F.substring(label, 1, i), F.substring(label, i + 1, 20)
        a, b = head.try_cast("int"), tail.try_cast("int")
        fits = (F.length(tail) > 0) & ((F.length(tail) == 1) | ~F.startswith(tail, F.lit("0"))) & (a >= 1) & (a < b) & (b <= top) & (b - a <= LOST_SPAN) & (has | (a < 100))
        return F.when(fits, expand_range(a, b))

    return F.when(eligible, F.coalesce(*(at(i) for i in range(1, 9))))


#: Words that begin like a name before a year and are none.
NO_AUTHORS = "In Since From Until After Before During The Year Section Ref Refs Figure Fig Table Eq January February March April May June July August September October November December".split()
_NAME = r"[A-Z\u00C0-\u00DE][\p{L}'’-]+"
_CITED = rf"({_NAME}(?:,\s{_NAME})*(?:,?\s(?:and|&)\s{_NAME})?(?:,?\set\sal\.?)?),?\s\(?((?:19|20)\d{{2}}[a-z]?(?:,\s?(?:19|20)\d{{2}}[a-z]?)*)"


def author_year_citations(text: Column) -> Column:
    """Array of (authors, et_al, year) of citations like Smith et al. (2008, 2010) or (Bahr and Lee, 2008a; Wu, 1999): one for each year, each once."""
    text = F.coalesce(text, F.lit(""))
    who, when = (F.regexp_extract_all(text, F.lit(_CITED), F.lit(k)) for k in (1, 2))

    def one(w: Column, i: Column) -> Column:
        names = F.split(F.regexp_replace(w, r",?\set\sal\.?$", ""), r",?\s(?:and|&)\s|,\s")
        return F.transform(F.split(F.get(when, i), r",\s?"), lambda y: F.struct(names.alias("authors"), F.rlike(w, F.lit(r"et\sal\.?$")).alias("et_al"), y.alias("year")))

    return F.array_distinct(F.filter(F.flatten(F.transform(who, one)), lambda c: ~c["authors"][0].isin(NO_AUTHORS)))


def separated_superscripts(raw: Column) -> Column:
    """The numbers of raised digits, with points, commas or blanks between several."""
    return F.filter(F.transform(F.split(raw, r"[·,\s]+"), lambda x: F.translate(x, SUPERSCRIPTS, "0123456789")), lambda x: x != "")


def attached_numbers(text: Column) -> Column:
    """The distinct labels of numbers, lists and ranges that follow a letter at once, as raised numbers do when their text is copied: up to MOST_ATTACHED."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z](\d{1,3}(?:[–,-]\d{1,3})*)"), F.lit(1))
    return F.array_distinct(F.filter(F.flatten(F.transform(found, labels_of)), lambda x: x.try_cast("int").between(1, MOST_ATTACHED)))


#: Forms of markers by kind, in the order in which they are looked for; the greatest label of attached numbers and of any.
SINGLE, RAISED = r"(\[\d+\])", f"([{SUPERSCRIPTS}]+(?:[·,\\s][{SUPERSCRIPTS}]+)*)"
NAMED, SHORT_NAMED = r"(?i)(\[[a-z][a-z]+(?:\s+et\s+al\.?)?\s+\d{4}[a-z]?\])", r"(\[[A-Z]+\d{2,4}\])"
NEW_ARXIV, OLD_ARXIV = r"(?i)(\[(?:arXiv:)?\d{4}\.\d{4,5}\])", r"(?i)(\[(?:hep-[a-z]+|astro-ph|gr-qc|nucl-[a-z]+|cond-mat|quant-ph)/\d+\])"
MOST_ATTACHED, MOST = 500, 1499


def markers(text: Column) -> Column:
    """Array of (kind, raw, labels) of all markers of a text: single numbers in brackets, then lists and ranges, raised numbers, names with years, short names with
    years, and arXiv ids of both forms; within a form in the text's order. A raw marker comes once, with the first form that has it; null has none."""
    text = F.coalesce(text, F.lit(""))
    of = lambda pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    inner = lambda raw: F.regexp_replace(raw, r"^\[(?:(?i:arXiv):)?|\]$", "")
    as_kind = lambda kind, raws, labels: F.transform(raws, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("raw"), labels(r).alias("labels")))
    alone = lambda r: F.array(inner(r))
    singles, lists = of(SINGLE), of(BRACKETS.replace(r"\[(", r"(\[").replace(r")\]", r"\])"))
    return F.concat(
        as_kind("numeric", singles, alone), as_kind("numeric", F.array_except(lists, singles), lambda r: labels_of(inner(r))), as_kind("numeric", of(RAISED), separated_superscripts),
        as_kind("author-year", of(NAMED), alone), as_kind("author-year", of(SHORT_NAMED), alone), as_kind("arxiv", of(NEW_ARXIV), alone), as_kind("arxiv", of(OLD_ARXIV), alone),
    )


def all_markers(text: Column) -> Column:
    """Array of (kind, raw) of all markers: brackets first, then author and year, then superscripts; a marker that comes again is left out."""
    text = F.coalesce(text, F.lit(""))
    kinds = [("bracket", rf"({BRACKETS.replace('(', '(?:')})"), ("author-year", rf"({AUTHOR_YEAR})"), ("superscript", f"([{SUPERSCRIPTS}]+)")]

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda raw: F.struct(F.lit(kind).alias("kind"), raw.alias("raw")))

    return F.array_distinct(F.concat(*(of(k, p) for k, p in kinds)))


#: Words that name a place in the document, before a number; and words before a number that are no author.
PLACES = (
    "figs? figures? tabs? tables? secs? sects? sections? eqs? eqns? equations? apps? appendix appendices chs? chaps? chapters? parts? theorems? lemmas? corollar(?:y|ies) "
    "defs? definitions? props? propositions? examples? exercises? problems? notes? cases? steps?"
).split()
NO_CITING = (
    "sections? secs? sects? chapters? chaps? ch figures? figs? tables? tabs? tbls? equations? eqs? eqns? formulas? formulae pages? pg pp lines? lns? appendix appendices app parts? pts? "
    "theorems? thms? lemmas? lems? corollary corollaries cors? propositions? props? definitions? defs? proofs? pfs? remarks? rems? examples? exs? exercises? problems? probs? solutions? sols? "
    "notes? cases? items? steps? columns? cols? rows? entry entries index indices numbers? nums? nos? versions? vers? volumes? vols? issues? iss years? yrs? days? months? "
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sept? oct nov dec "
    "runs? beams? events? samples? generations? gens? orders? ord loops? levels? lev lvl tiers? phases? stages? class classes types? category categories cat groups? grps? sets? series modes? channels? chan bins? points? "
    "degrees? deg dimensions? dims? components? comp parameters? params? models? scenarios? configurations? configs? options? opt methods? approach approaches schemes? algorithms? algo alg"
).split()


def selection_labels(text: Column, known: Column | None = None) -> Column:
    """(kind, labels) of a piece of text that a reader has marked: labels in brackets, else authors with years, else a bare list of numbers and
    ranges, else superscripts; null if there is nothing of the kind. A single number that must be a range whose dash was lost is written out."""
    text = repair_brackets(F.coalesce(text, F.lit("")))
    numbers = bracket_labels(text)
    cited = F.transform(author_year_citations(text), lambda c: F.concat(c["authors"][0], F.lit(" "), c["year"]))
    bare = F.regexp_replace(F.regexp_replace(text, r"^[\s.,;:()\[\]]+|[\s.,;:()\[\]]+$", ""), r"\s+", "")
    listed = F.when(F.rlike(bare, F.lit(r"^\d{1,4}(?:[,–-]\d{1,4})*$")), F.array_distinct(labels_of(bare))).otherwise(F.array().cast("array<string>"))
    raised = F.array_distinct(superscripts(text))
    spread = lambda labels: F.when(F.size(labels) == 1, F.coalesce(lost_range(F.get(labels, F.lit(0)), known), labels)).otherwise(labels)
    as_kind = lambda kind, labels: F.struct(F.lit(kind).alias("kind"), labels.alias("labels"))
    return F.when(F.size(numbers) > 0, as_kind("numeric", spread(numbers))).when(F.size(cited) > 0, as_kind("author-year", cited)).when(F.size(listed) > 0, as_kind("numeric", spread(listed))).when(F.size(raised) > 0, as_kind("superscript", raised))


def has_markers(text: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.rlike(text, F.lit(p)) for p in (BRACKETS, f"[{SUPERSCRIPTS}]", AUTHOR_YEAR)]), F.lit(False))


def format_vote(numeric: Column, author_year: Column) -> Column:
    """Whether a text cites by author and year: at least half of at least three citations are of that form."""
    total = numeric + author_year
    return F.when((total >= 3) & (author_year / total >= 0.5), F.lit("author-year")).otherwise(F.lit("numeric"))
