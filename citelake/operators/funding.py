"""Funding: the acknowledgment part of a text, the grant numbers in it, and their report.

Funders are data: FUNDERS lists each one's names, and its numbers' shapes in a small notation. A text is read once for tokens that have any
funder's shape; a token belongs to a funder that is named shortly before it, or to that of the token before it in the same list, or to
the one whose shape is unmistakable. Callers may bring funders of their own.

Defined results: a null text has no grants; a grant that is named again counts once, at its first place; of several funders that may be meant
the one with the highest priority is; repeated ids are one document; other columns of `docs` aren't read; empty tables give none."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from citelake.functions.places import bound, matches_at
from citelake.sources.shared import durable

#: How near a DFG number and its programme stand, how near joint funders stand, a footnote's length, characters between name and number.
SAME_PROJECT, JOINT, FOOTNOTE, REACH = 120, 50, 2000, 40
#: What confidence begins with, and what a name, a word of context, and a place between thanks and references add.
SURE, NAMED, IN_CONTEXT, IN_SECTION = 0.6, 0.25, 0.1, 0.05
CONTEXT = ["grant", "supported", "funded", "资助", "acknowledge", "致谢", "project", "项目"]
#: Headings that begin the part, best kind first, and headings that end it; those of ALONE only if nothing follows in their line.
STARTS = {
    "acknowledgments": ["acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements", "致谢"],
    "funding": ["funding and acknowledgments", "funding and acknowledgements", "funding", "financial support", "grant support", "grant information", "support information", "supporting information", "基金资助项目", "基金项目", "项目资助信息", "项目资助", "资助信息", "资助"],
    "footnote": ["收稿日期", "基金项目", "资助项目"],
}
ENDS = ["appendix", "conflict of interest", "conflicts of interest", "declaration of conflict of interest", "declaration of conflicts of interest", "data availability", "orcid"]
ALONE = ["reference", "references", "bibliography", "参考文献", "附录", "author contribution", "author contributions"]

#: Signs that follow a heading; running heads; signs and words between numbers of one list, and words before its next number.
FOLLOWING, RUNNING = [":", ".", "-", "–", "—"], ["Eur. Phys. J. C"]
LINKS, NUMBER_WORDS = [",", ";", "、", "/", "&", "and"], ["No", "No.", "Nos", "Nos."]


@dataclass(frozen=True)
class Funder:
    """names as they are written (words may stand apart by any blanks). shapes: d is a digit, c a capital letter, {m,n} repeats, (x|y) is
    either, all else stands for itself; sure: such a number needs no name. years: the bounds of a number's first four digits."""

    id: str
    category: str
    priority: int
    names: tuple[str, ...]
    shapes: tuple[str, ...]
    sure: tuple[str, ...] = ()
    years: tuple[int, int] | None = None


#: Funders, their categories and priorities, by the public formats of their numbers.
FUNDERS = [
    Funder("NSFC", "china", 100, ("NSFC", "NNSFC", "NNSF", "国家自然科学基金", "基金委", "Natural Science Foundation of China", "Nature Science Foundation of China", "Natural Science Foundations of China"), ("(1|2|3|4|5|6|7|8|9|U)d{7,10}",)),
    Funder("MoST", "china", 95, ("MoST", "MOST", "NKRDP", "重点研发计划", "National Key R&D Program", "National Key R&D Program of China", "National Key Research and Development Program", "National Key Research and Development Program of China"), (), ("20ddYFcd{7}",), (2016, 2099)),
    Funder("CAS", "china", 92, ("CAS", "中科院", "中国科学院", "Strategic Priority Research Program", "Chinese Academy of Sciences"), (), ("XDc{1,2}d{2,8}", "YSBR-d{2,4}")),
    Funder("MoST-973", "china", 90, ("973 Program", "国家重点基础研究", "National Basic Research Program"), (), ("20ddCBd{6}",), (2001, 2017)),
    Funder("MoST-863", "china", 85, ("863 Program", "国家高技术"), ("20ddAAd{6}",), (), (2001, 2017)),
    Funder("CAS-PIFI", "china", 80, ("PIFI", "国际人才计划", "President's International Fellowship Initiative"), ("20ddc{2,4}d{4,6}",)),
    Funder("CPSF", "china", 80, ("CPSF", "博士后", "China Postdoctoral Science Foundation", "Postdoctoral"), ("GZC20d{6,8}", "20dd(M|T|G)d{4,7}")),
    Funder("BNSF", "china", 60, ("Beijing Natural Science Foundation", "北京市自然科学基金"), ("(JQ|Z|L|M)?d{6,8}",)),
    Funder("DOE", "us", 90, ("DOE", "DoE", "Department of Energy"), (), ("DE-ccd{7,10}", "DE-ccdd-ddccd{5}", "d{8}cccd{6}")),
    Funder("NSF", "us", 90, ("NSF", "National Science Foundation"), (), ("(PHY|AST|DMR|CHE|DMS|MPS|ENG|BIO)-?d{7}",)),
    Funder("NIH", "us", 75, ("NIH", "National Institutes of Health"), (), ("(R|K|F|T|U)ddccd{6}",)),
    Funder("ERC", "eu", 85, ("ERC", "European Research Council", "Horizon 2020"), ("d{6,9}",)),
    Funder("DFG", "eu", 80, ("DFG", "Deutsche Forschungsgemeinschaft", "German Research Foundation"), ("d{9}",), ("(SFB|TRR|CRC) ?d{2,4}",)),
    Funder("BMBF", "eu", 78, ("BMBF", "Bundesministerium für Bildung und Forschung"), (), ("05cd{2}c{2,4}d{0,2}",)),
    Funder("MICINN", "eu", 80, ("MICINN", "MINECO", "Ministerio de Ciencia e Innovación"), (), ("PID20dd-d{6}cc-cdd", "FPA20dd-d{5}-c")),
    Funder("STFC", "eu", 75, ("STFC", "Science and Technology Facilities Council"), (), ("ST/cd{6}/d",)),
    Funder("ANR", "eu", 70, ("ANR", "Agence Nationale de la Recherche"), (), ("ANR-dd-ccccd?-d{4}",)),
    Funder("SNSF", "eu", 70, ("SNSF", "Swiss National Science Foundation"), ("(200020|200021|PP00P2)_d{6}", "d{6}")),
    Funder("JSPS", "asia", 80, ("JSPS", "KAKENHI", "Japan Society for the Promotion of Science"), ("(JP)?dd(H|K|J)d{5}",)),
    Funder("NRF-KR", "asia", 75, ("NRF of Korea", "National Research Foundation of Korea"), (), ("NRF-20ddccdcdcd{8}",)),
    Funder("NSERC", "intl", 75, ("NSERC",), ("SAPIN-20dd-d{5}", "RGPIN-20dd-d{5}")),
    Funder("ARC-AU", "intl", 75, ("Australian Research Council",), (), ("(DP|FT|DE|CE|LP)d{9}",)),
    Funder("RSF", "intl", 70, ("RSF", "Russian Science Foundation"), ("dd-dd-d{5}",)),
    Funder("RFBR", "intl", 70, ("RFBR", "Russian Foundation for Basic Research"), ("dd-dd-d{5}",)),
]


def _words(text: str) -> str:
    """An expression for a phrase whose words may stand apart by any blanks; Chinese characters too."""
    return r"\s+".join(map(re.escape, text.split())) if text.isascii() else r"\s*".join(map(re.escape, text))


def _shape(shape: str) -> str:
    return "".join({"d": "[0-9]", "c": "[A-Z]", "(": "(?:"}.get(x, x if x in ")|?{}," or x.isdigit() else re.escape(x)) for x in shape)


def _any(expressions: list[str]) -> str:
    return "(?:" + "|".join(expressions) + ")"


def acknowledgment(text: Column) -> Column:
    """(source, text): the part from the best heading to the first heading that ends it; the whole text without a heading."""
    ended = rf"(?i)(?:^|\n)\s*(?:{_any([_words(x) for x in sorted(ALONE, key=len, reverse=True)])}\s*(?:\n|$)|{_any([_words(x) for x in ENDS])})"
    out = F.struct(F.lit("full_text").alias("source"), text.alias("text"))
    for source, headings in reversed(STARTS.items()):
        listed = _any([_words(x) for x in sorted(headings, key=len, reverse=True)])
        sign = _any([re.escape(x) for x in FOLLOWING])
        # A heading begins a line and is a word of its own; the sign behind it belongs to it.
        begun = rf"{listed}[：:]\s*" if source == "footnote" else rf"(?im)^\s*{listed}(?=\s|{sign})\s*{sign}?"
        head = F.get(F.split(text, begun, 2), F.lit(1))
        part = F.get(F.split(head, ended, 2), F.lit(0))
        part = F.regexp_replace(F.left(part, F.lit(FOOTNOTE)) if source == "footnote" else part, r"^\s+|\s+$", "")
        out = F.when(head.isNotNull(), F.struct(F.lit(source).alias("source"), part.alias("text"))).otherwise(out)
    return out


def text_language(text: Column) -> Column:
    """mixed, zh or en by the letters in a text."""
    han, latin = F.rlike(text, F.lit("[一-鿿]")), F.rlike(text, F.lit("[a-zA-Z]{3,}"))
    return F.when(han & latin, "mixed").when(han, "zh").otherwise("en")


def searched(text: Column) -> Column:
    """A text as it is read, whole: full-width characters as plain ones, one line, without lines that are a number or say which page of how many this is, and without
    running heads to the end of their line."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    lines = F.split(F.translate(text, wide, "".join(chr(ord(c) - 0xFEE0) for c in wide)), r"\r?\n")

    def page(line: Column) -> Column:
        low = F.lower(line)
        words = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "")
        number = lambda w: w.try_cast("int").isNotNull()
        counted = lambda ws: F.exists(F.transform(ws, lambda w, i: (w == "page") & (F.get(ws, i + 2) == "of") & number(F.get(ws, i + 1)) & number(F.get(ws, i + 3))), lambda x: F.coalesce(x, F.lit(False)))
        alone = lambda ws: (F.size(ws) == 1) & F.coalesce(number(F.get(ws, F.lit(0))), F.lit(False))
        return F.when(F.contains(low, F.lit("page")), bound(words, counted)).when(F.rlike(line, F.lit(r"^[\s\d]+$")), bound(words, alone)).otherwise(F.lit(False))

    clean = F.transform(lines, lambda x: F.when(page(x), F.lit("")).otherwise(F.regexp_replace(x, f"(?i){_any([_words(h) for h in RUNNING])}.*", "")))
    return F.array_join(clean, " ")


def normal_number(funder: Column, grant: Column) -> Column:
    """NSF numbers with a hyphen after the letters, DOE numbers in capitals."""
    return F.when(funder == "NSF", F.regexp_replace(grant, r"^([A-Z]+)([0-9])", "$1-$2")).when(funder == "DOE", F.upper(grant)).otherwise(grant)


def _fitting(value: Column, funders: list[Funder], sure: bool) -> Column:
    """Array of (rank, funder): whose numbers may look like that, the highest priority first."""

    def fits(f: Funder) -> Column:
        shapes = f.sure if sure else (*f.shapes, *f.sure)
        if not shapes:
            return F.lit(None)
        ok = F.rlike(value, F.lit(f"^{_any([_shape(x) for x in shapes])}$"))
        return F.when(ok & F.left(value, F.lit(4)).try_cast("int").between(*f.years) if f.years else ok, F.struct(F.lit(-f.priority).alias("rank"), F.lit(f.id).alias("funder")))

    return F.sort_array(F.array_compact(F.array(*(fits(f) for f in funders), F.lit(None).cast("struct<rank:int,funder:string>"))))


def grants(docs: DataFrame, funders: list[Funder] = FUNDERS) -> DataFrame:
    """(id, funder, category, grant, position, confidence): the grants that a text (id, text) names. position counts in the part as it is read."""
    # Texts are dealt by id before they are read: a small file of many texts is one task else, and the grants of an id meet without a shuffle of their own.
    part = docs.select("id", "text").repartition("id").select("id", searched(F.coalesce(acknowledgment(F.col("text"))["text"], F.lit(""))).alias("_t"))
    shapes = sorted({_shape(x) for f in funders for x in (*f.shapes, *f.sure)}, key=len, reverse=True)
    tokens = matches_at(F.col("_t"), rf"(?<![A-Za-z0-9])({_any(shapes)})(?![A-Za-z0-9])")
    tokens = F.transform(tokens, lambda t: F.struct(t["at"].alias("at"), t["value"].alias("value"), _fitting(t["value"], funders, False).alias("may"), _fitting(t["value"], funders, True).alias("sure")))

    named = "array<struct<rank:int,funder:string,at:int,end:int>>"

    def mentions(f: Funder) -> Column:
        """Where a funder is named, if a token of the text may be its number."""
        found = matches_at(F.col("_t"), rf"(?<![A-Za-z])({_any([_words(x) for x in sorted(f.names, key=len, reverse=True)])})")
        may = F.exists("_tokens", lambda t: F.exists(t["may"], lambda x: x["funder"] == f.id))
        return F.when(may, F.transform(found, lambda m: F.struct(F.lit(-f.priority).alias("rank"), F.lit(f.id).alias("funder"), m["at"].alias("at"), (m["at"] + m["length"]).alias("end")))).otherwise(F.array().cast(named))

    part = part.withColumn("_tokens", tokens)
    between = lambda a, b: F.substr(F.col("_t"), a + 1, b - a)
    one = "struct<funder:string,grant:string,at:int,start:int,named:boolean>"
    start = F.struct(F.lit(None).cast("string").alias("funder"), F.lit(0).alias("end"), F.array().cast(f"array<{one}>").alias("out"))

    def read(names: Column, s: Column, t: Column) -> Column:
        """The owner of the next token: a funder named before it, or its list's, or the one whose shape it has."""
        gap = lambda m: (m["end"] <= t["at"]) & (t["at"] - m["end"] <= REACH) & ~F.rlike(between(m["end"], t["at"]), F.lit("[0-9]"))
        near = F.filter(names, lambda m: F.exists(t["may"], lambda x: x["funder"] == m["funder"]) & gap(m))
        best = F.array_min(F.transform(near, lambda m: F.struct(m["rank"].alias("rank"), (-m["at"]).alias("back"), m["funder"].alias("funder"))))
        # In one list: nothing stands between but links, and perhaps a word for numbers.
        said = F.filter(F.split(F.regexp_replace(between(s["end"], t["at"]), _any([re.escape(x) for x in LINKS if not x.isalpha()]), " $0 "), r"\s+"), lambda w: w != "")
        linked = bound(said, lambda w: (F.size(w) > 0) & F.get(w, F.lit(0)).isin(LINKS) & F.forall(w, lambda x: x.isin(LINKS + NUMBER_WORDS)))
        listed = F.exists(t["may"], lambda x: x["funder"] == s["funder"]) & F.coalesce(linked, F.lit(False))
        owner = lambda b: F.coalesce(b["funder"], F.when(listed, s["funder"]), F.get(t["sure"], F.lit(0))["funder"])
        row = lambda b, o: F.struct(o.alias("funder"), t["value"].alias("grant"), t["at"].alias("at"), F.coalesce(-b["back"], t["at"]).alias("start"), b.isNotNull().alias("named"))
        more = lambda b, o: F.when(o.isNotNull(), F.concat(s["out"], F.array(row(b, o)))).otherwise(s["out"])
        return bound(best, lambda b: bound(owner(b), lambda o: F.struct(o.alias("funder"), (t["at"] + F.length(t["value"])).alias("end"), more(b, o).alias("out"))))

    found = bound(F.concat(*map(mentions, funders)), lambda names: F.aggregate("_tokens", start, lambda s, t: read(names, s, t), lambda s: s["out"]))
    each = part.select("id", "_t", F.explode(F.when(F.size("_tokens") > 0, found)).alias("m")).select("id", "_t", "m.*")
    raw = F.lower(between(F.col("start"), F.col("at") + F.length("grant")))
    context = F.rlike(raw, F.lit("|".join(CONTEXT)))
    thanks, end = F.regexp_instr("_t", F.lit(r"(?i)acknowledge?ment|致\s*谢")), F.regexp_instr("_t", F.lit(r"(?i)reference|参考文献"))
    inside = (thanks > 0) & (end > 0) & (F.col("at") >= thanks) & (F.col("at") < end - 1)
    add = lambda c, x: F.when(c, x).otherwise(0.0)
    confidence = F.round(F.least(F.lit(1.0), SURE + add(F.col("named"), NAMED) + add(context, IN_CONTEXT) + add(inside, IN_SECTION)), 2)
    category = F.create_map(*(F.lit(x) for f in funders for x in (f.id, f.category)))
    found = each.select("id", "funder", F.element_at(category, F.col("funder")).alias("category"), normal_number(F.col("funder"), F.col("grant")).alias("grant"), F.col("at").alias("position"), confidence.alias("confidence"))
    return found.groupBy("id", "funder", "category", "grant").agg(F.min("position").alias("position"), F.max_by("confidence", -F.col("position")).alias("confidence"))


def merge_programmes(found: DataFrame) -> DataFrame:
    """DFG numbers with the programme that stands near them in brackets; the programme's own row goes.

    A programme meets the nearest number within SAME_PROJECT characters of the same text. `found` is written first, as it is read several times."""
    found = durable(found)
    dfg = F.col("funder") == "DFG"
    is_number = F.rlike("grant", F.lit(r"^\d{9}$"))
    ids = found.filter(dfg & is_number).select("id", F.col("grant").alias("_number"), F.col("position").alias("_at"))
    programmes = found.filter(dfg & ~is_number).select("id", F.col("grant").alias("_programme"), F.col("position").alias("_near"))
    pairs = programmes.join(ids, "id").filter(F.abs(F.col("_at") - F.col("_near")) < SAME_PROJECT)
    best = pairs.groupBy("id", "_programme").agg(F.min(F.struct(F.abs(F.col("_at") - F.col("_near")).alias("d"), "_number")).alias("b")).select("id", "_programme", F.col("b._number").alias("_number"))
    named = best.groupBy("id", F.col("_number").alias("grant")).agg(F.array_join(F.sort_array(F.collect_list("_programme")), ", ").alias("_names")).withColumn("funder", F.lit("DFG"))
    rest = found.join(best.select("id", F.col("_programme").alias("grant"), F.lit("DFG").alias("funder")), ["id", "funder", "grant"], "left_anti")
    met = rest.join(named, ["id", "funder", "grant"], "left")
    grant = F.when(F.col("_names").isNotNull(), F.concat("grant", F.lit(" ["), "_names", F.lit("]"))).otherwise(F.col("grant"))
    return met.select("id", "funder", "category", grant.alias("grant"), "position", "confidence")


def of_category(found: DataFrame, category: str = "china") -> DataFrame:
    return found.filter(F.col("category") == category)


def funding_lines(found: DataFrame) -> DataFrame:
    """(id, grants): a text's grants in one line: funders by first place, those that only stand behind one of China's within JOINT characters last. `found` is written first."""
    found = durable(found)
    near = found.filter("category = 'china'").select("id", F.col("position").alias("_c"))
    joint = found.filter("category <> 'china'").join(near, "id").filter((F.col("position") > F.col("_c")) & (F.col("position") - F.col("_c") < JOINT)).select("id", "funder", F.lit(1).alias("_joint")).distinct()
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("position", "grant"))), lambda x: x["grant"])
    one = found.groupBy("id", "funder").agg(F.min("position").alias("first"), F.array_join(ordered, ", ").alias("list")).join(joint, ["id", "funder"], "left")
    line = F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("_joint", F.lit(0)).alias("j"), "first", "funder", "list"))), lambda x: F.concat(x["funder"], F.lit(": "), x["list"]))
    return one.groupBy("id").agg(F.array_join(line, "; ").alias("grants"))


def funding_table(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(line): tab-separated title, arXiv id and grants of every document (id, title, arxiv_id)."""
    clean = F.regexp_replace(F.coalesce("title", F.lit("")), r"[\t\n]", " ")
    return docs.join(lines, "id", "left").select("id", F.concat_ws("\t", clean, F.coalesce("arxiv_id", F.lit("")), F.coalesce("grants", F.lit(""))).alias("line"))


def funding_counts(found: DataFrame) -> DataFrame:
    """(funders, grants) of all texts."""
    return found.agg(F.count_distinct("funder").alias("funders"), F.count("*").alias("grants"))
