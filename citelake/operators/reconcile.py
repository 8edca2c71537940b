"""The numbered list that was read from a text, set against the list of entries that a source gives: which entries each number means.

Both lists keep their order but for gaps, doubles and small swaps. A label's papers are looked for among the entries that follow those of the labels before it
(AHEAD more than it has papers, WIDER more if none of them is found there), each paper taking the best entry that is left. Where the labels begin is a running
sum over a document's labels, so windows, pairs and choices are joins and aggregates over all documents at once; only the choices within
one label are made one after the other, in an expression over its few papers.

Defined results: labels that repeat in a document are an error of the caller; a null or missing number of papers is 1; a document without entries gives its
labels no places; documents that only one side has: labels without entries stay, entries without labels aren't returned; empty tables give none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from citelake.sources.shared import durable

from .matching import keys_similar, strong_match
from .records import match_score, normal_parts, scored_pairs

#: How many entries more than papers are looked through, and if none is found; the least score.
AHEAD, WIDER, ACCEPT = 3, 8, 3.0
#: From which difference or below which share two lists disagree; shares from which labels are well aligned; least coverage of a strict map.
APART, SHORT, ALIGNED, COVERED = 5, 0.85, 0.95, 0.5

#: From which excess of read papers on the sequence isn't trusted; what the best of all entries must earn with a fitting year, and without years; how far
#: years fit; how much better a best entry of another year must be; scores of high and medium confidence.
EXCESS, YEAR_ACCEPT, NO_YEAR_ACCEPT, YEARS_FIT, BETTER, HIGH, MEDIUM = 1.05, 4.0, 6.0, 3, 1.0, 6.0, 4.0

_PICK = "array<struct<part:int,entry:int,score:double>>"


def _choose(papers: Column, end: Column) -> Column:
    """(part, entry, score) of each paper, in order, that finds an entry before `end` which none before it has taken."""
    free = lambda taken, p: F.get(F.filter(p["near"], lambda x: (x["entry"] < end) & ~F.exists(taken, lambda t: t["entry"] == x["entry"])), F.lit(0))
    one = lambda p, x: F.array(F.struct(p["part"].alias("part"), x["entry"].alias("entry"), x["score"].alias("score")))
    step = lambda taken, p: F.when(free(taken, p).isNotNull(), F.concat(taken, one(p, free(taken, p)))).otherwise(taken)
    return F.aggregate(papers, F.array().cast(_PICK), step)


def reconcile(labels: DataFrame, papers: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc, label, n_papers, count, first, n_entries, picks, missing): for each label how many places it takes, the first of them, how many of these the list has,
    which entries its papers were found as (part, entry, score), and the parts (but errata) that weren't.

    labels: doc, label (int), n (papers under it); papers: doc, label, part (int), is_erratum and the columns of a parsed reference (see records.normal_parts), for any
    of the labels; entries: doc, entry (int, its place from 0) and the columns of an entry. Where a document has no papers at all, labels of
    several papers give up one each, in order, until the counts fit."""
    return _reconciled(labels, papers, entries).drop("real")


def _reconciled(labels: DataFrame, papers: DataFrame, entries: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """The columns of reconcile and real, the number of a label's papers that are no errata. scored (doc, label, part, is_erratum, entry, score): every pair of a
    document's papers and entries that scores ACCEPT or more, if the caller has them."""
    in_order = Window.partitionBy("doc").orderBy("label")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sizes = entries.groupBy("doc").agg(F.count("*").cast("int").alias("total"))
    known = papers.groupBy("doc", "label").agg(F.count("*").alias("infos"), F.count_if(~F.col("is_erratum")).cast("int").alias("real"))
    met = labels.select("doc", F.col("label").cast("int").alias("label"), F.coalesce("n", F.lit(1)).cast("int").alias("n")).join(known, ["doc", "label"], "left").join(sizes, "doc", "left")
    met = met.select("doc", "label", "n", (zero(F.col("infos")) > 0).alias("has"), zero(F.col("total")).alias("total"), F.when(F.col("real") > 0, F.col("real")).otherwise(F.col("n")).alias("n_papers"), zero(F.col("real")).alias("real"))
    placed = met.withColumn("at", zero(F.sum("n_papers").over(before)).cast("int")).withColumn("any", F.max("has").over(Window.partitionBy("doc")))
    # The first label that begins behind the last entry finds nothing, and those after it aren't looked for.
    over = F.min(F.when(F.col("has") & (F.col("at") >= F.col("total")), F.col("label"))).over(Window.partitionBy("doc"))
    placed = placed.withColumn("over", over).withColumn("looked", F.col("has") & (F.col("label") <= F.coalesce("over", "label")))
    # Papers beside the entries that they may be.
    windows = placed.filter(F.col("looked") & (F.col("at") < F.col("total"))).select("doc", "label", "at", (F.col("at") + F.col("n_papers")).alias("upto"), "total")
    if scored is not None:
        scored = scored.join(windows, ["doc", "label"]).filter((F.col("entry") >= F.col("at")) & (F.col("entry") < F.least(F.col("upto") + WIDER, F.col("total"))))
    else:
        a = papers.select("doc", F.col("label").cast("int").alias("label"), "part", "is_erratum", *normal_parts(papers, True))
        names = ["arxiv", "doi", "author", "year", "page", "journal", "volume", "text"]
        near = a.select("doc", "label", "part", "is_erratum", *(F.col(c).alias(f"a_{c}") for c in names)).join(windows, ["doc", "label"])
        near = near.withColumn("entry", F.explode(F.sequence(F.col("at"), F.least(F.col("upto") + WIDER, F.col("total")) - 1)))
        b = entries.select("doc", F.col("entry").cast("int").alias("entry"), *normal_parts(entries, False)).select("doc", "entry", *(F.col(c).alias(f"b_{c}") for c in names))
        scored = near.join(b, ["doc", "entry"]).select("doc", "label", "part", "is_erratum", "upto", "entry", match_score().alias("score")).filter(F.col("score") >= ACCEPT)
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "entry"))), lambda x: F.struct(x["entry"].alias("entry"), (-x["s"]).alias("score")))
    each = scored.groupBy("doc", "label", "upto", "part", "is_erratum").agg(listed.alias("near"))
    whole = each.groupBy("doc", "label", "upto").agg(F.sort_array(F.collect_list(F.struct("part", "is_erratum", "near"))).alias("papers"))
    first = _choose(F.filter("papers", lambda p: ~p["is_erratum"]), F.col("upto") + AHEAD)
    found = whole.withColumn("first", first).select("doc", "label", F.when(F.size("first") > 0, F.col("first")).otherwise(_choose(F.col("papers"), F.col("upto") + WIDER)).alias("picks"))
    own = papers.filter(~F.col("is_erratum")).groupBy("doc", F.col("label").cast("int").alias("label")).agg(F.sort_array(F.collect_list("part")).alias("parts"))
    out = placed.join(found, ["doc", "label"], "left").join(own, ["doc", "label"], "left")
    none = F.array().cast(_PICK)
    out = out.withColumn("picks", F.coalesce("picks", none))
    room = F.greatest(F.lit(1), F.col("total") - F.col("at"))
    several = F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    excess = F.sum("n").over(Window.partitionBy("doc")) - F.col("total")
    count = F.when(~F.col("any"), F.col("n") - F.when((F.col("n") > 1) & (several <= excess), 1).otherwise(0)).when(~F.col("looked"), F.col("n")).when(F.size("picks") > 0, F.col("n_papers")).otherwise(F.least(F.col("n_papers"), room))
    out = out.withColumn("count", count.cast("int")).withColumn("first", zero(F.sum("count").over(before)).cast("int"))
    missing = F.when(F.col("looked"), F.filter(F.coalesce("parts", F.array().cast("array<int>")), lambda p: ~F.exists("picks", lambda x: x["part"] == p))).otherwise(F.array().cast("array<int>"))
    return out.select("doc", "label", "n_papers", "count", "first", F.greatest(F.lit(0), F.least(F.col("count"), F.col("total") - F.col("first"))).alias("n_entries"), "picks", missing.alias("missing"), "real")


def list_agreement(labels: DataFrame, papers: DataFrame, entries: DataFrame, reconciled: DataFrame) -> DataFrame:
    """(doc, total, expected, counted, coverage, ratio, well_aligned, over_parsed, strict) for each document with labels: entries, papers that were read and that
    were counted in the end, the share of entries that the labels cover, counted papers per entry, whether the entries' own labels are their places, whether
    more was read than there is, and whether the map by sequence should be kept to. entries also need label. Without papers nothing is over-parsed or strict."""
    sizes = entries.groupBy("doc").agg(
        F.count("*").alias("total"), F.avg((F.coalesce(F.trim("label"), F.lit("")) != "").cast("int")).alias("_l"), F.count_if(F.trim("label").try_cast("int") == F.col("entry") + 1).alias("_n"),
    )
    counted = reconciled.groupBy("doc").agg(F.sum("count").alias("counted"), F.sum("n_entries").alias("_covered"))
    read = labels.groupBy("doc").agg(F.sum(F.coalesce("n", F.lit(1))).alias("expected"))
    judged = papers.select("doc").distinct().withColumn("_judged", F.lit(True))
    met = read.join(counted, "doc").join(sizes, "doc", "left").join(judged, "doc", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    full = F.col("total") > 0
    ratio = F.when(full, F.col("counted") / F.col("total")).otherwise(1.0)
    aligned = full & (F.col("_n") / F.col("total") >= ALIGNED) & (F.col("_l") >= ALIGNED)
    coverage = F.when(full, F.col("_covered") / F.col("total")).otherwise(0.0)
    known = F.coalesce("_judged", F.lit(False))
    out = met.select("doc", "total", "expected", "counted", coverage.alias("coverage"), ratio.alias("ratio"), F.coalesce(aligned, F.lit(False)).alias("well_aligned"), (known & (F.col("counted") > F.col("total"))).alias("over_parsed"), known.alias("_k"))
    apart = (F.abs(F.col("counted") - F.col("total")) >= APART) | (F.col("ratio") < SHORT)
    return out.withColumn("strict", F.col("_k") & apart & ~F.col("well_aligned") & (F.col("coverage") >= COVERED) & ~F.col("over_parsed")).drop("_k")


def settled_labels(labels: DataFrame, papers: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc, label, found, confidence, by): for each label the entries that it means and what settled it. Strategies are tried one after the other, each on the labels that
    those before it left; what a document is like may switch one off:

    label (entries with that label), strong (the best of its papers' strong matches, near its place in the sequence if it has one), id (papers' arXiv ids and DOIs anywhere; for
    labels beyond the greatest one of the entries), sequence (its places by reconcile; not in lists without labels or with EXCESS papers), best (the best entry for
    each paper in the whole list; where the sequence is strict or not trusted), near (in lists without labels the best entries around its number), place (its number; in lists
    without labels that aren't strict).

    Arguments as for reconcile, whose labels are numbers (of other labels see matching.label_matches); entries also have label. Labels that nothing settles
    aren't returned."""
    pairs = scored_pairs(papers.withColumn("ref", F.struct(F.col("label").cast("int").alias("label"), "part", "is_erratum")).drop("label", "part", "is_erratum"), entries.drop("label"), ACCEPT)
    x, y = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    part = F.contains(y("author"), x("author")) | F.contains(x("author"), y("author")) | F.contains(y("text"), x("author"))
    strong = strong_match(part, keys_similar(x("journal"), y("journal")) & x("journal").isNotNull(), F.when(x("journal").isNotNull(), x("volume") == y("volume")), x("page") == y("page"), F.abs(x("year") - y("year")), x("arxiv") == y("arxiv"), x("doi") == y("doi"))
    same_id = F.coalesce(x("arxiv") == y("arxiv"), F.lit(False)) | F.coalesce(x("doi") == y("doi"), F.lit(False))
    scored = durable(pairs.select("doc", "ref.label", "ref.part", "ref.is_erratum", "entry", "score", strong.alias("strong"), same_id.alias("same_id"), (F.abs(x("year") - y("year")) <= YEARS_FIT).alias("year_fits"), x("year").isNotNull().alias("dated")))
    sequence = durable(_reconciled(labels, papers, entries, scored.select("doc", "label", "part", "is_erratum", "entry", "score")))
    agreement = list_agreement(labels, papers, entries, sequence).select("doc", "ratio", "over_parsed", "strict")
    sizes = entries.groupBy("doc").agg(F.max(F.trim("label").try_cast("int")).alias("greatest"), F.count_if(F.coalesce(F.trim("label"), F.lit("")) != "").alias("labelled"), F.count("*").alias("total"))
    like = agreement.join(sizes, "doc", "left").select("doc", "strict", (F.col("over_parsed") & (F.col("ratio") > EXCESS)).alias("excess"), (F.coalesce("labelled", F.lit(0)) == 0).alias("unlabelled"), "greatest", F.coalesce("total", F.lit(0)).alias("total"))
    asked = durable(sequence.select("doc", "label", "first", "n_entries", "real").join(like, "doc"))
    own = entries.select("doc", F.trim("label").try_cast("int").alias("label"), F.trim("label").alias("_own"), F.col("entry").cast("int").alias("entry")).filter(F.col("_own") == F.col("label").cast("string"))
    labelled = own.groupBy("doc", "label").agg(F.array_sort(F.collect_set("entry")).alias("own"))
    # What each strategy that goes by scores would find; errata count only under labels that have nothing else.
    met = asked.join(scored.repartition("doc", "label"), ["doc", "label"]).filter(~F.col("is_erratum") | (F.col("real") == 0))
    placed = F.col("n_entries") > 0
    window = ~placed | F.col("entry").between(F.col("first") - 1, F.col("first") + F.col("n_entries"))
    rank = F.when(F.col("strong.kind") == "arxiv", 3).when(F.col("strong.kind") == "doi", 2).otherwise(1)
    least = lambda when, *c: F.min(F.when(F.coalesce(when, F.lit(False)), F.struct(*c)))
    worst = (-F.col("score")).alias("s")
    pick = lambda when: least(when, worst, "entry", "same_id", "year_fits", "dated")
    around = F.col("entry").between(F.col("label") - 2, 2 * F.col("label") + 8)
    each = met.groupBy("doc", "label", "part", "strict", "excess", "unlabelled", "greatest").agg(
        least(F.col("strong").isNotNull() & window, (-rank).alias("r"), (-F.col("strong.score")).alias("s"), "part", "entry").alias("strong"),
        pick(F.lit(True)).alias("any"), pick(F.col("year_fits")).alias("near"), pick(F.col("same_id")).alias("id"), least(around, worst, "entry").alias("b"), F.min(F.when(F.col("same_id"), F.col("entry"))).alias("met"),
    )
    fitting = F.when(F.col("near").isNotNull() & (-F.col("any.s") - -F.col("near.s") <= BETTER), F.col("near")).otherwise(F.col("any"))
    each = each.withColumn("c", F.coalesce("id", fitting))
    good = F.col("c.same_id") | (F.coalesce("c.year_fits", F.lit(False)) & (-F.col("c.s") >= YEAR_ACCEPT)) | (~F.col("c.dated") & (-F.col("c.s") >= NO_YEAR_ACCEPT))
    good &= F.col("strict") | F.col("excess")
    beyond = ~F.col("unlabelled") & (F.col("label") > F.col("greatest"))
    listed = lambda when, c: F.array_sort(F.collect_set(F.when(when, F.col(c).cast("int"))))
    level = F.when(-F.col("b.s") >= HIGH, 3).when(-F.col("b.s") >= MEDIUM, 2).otherwise(1)
    by_score = each.groupBy("doc", "label").agg(
        F.min("strong").alias("strong"), listed(beyond, "met").alias("ids"), listed(good, "c.entry").alias("best"), F.min(F.when(good, F.when(F.col("c.same_id"), 3).otherwise(2))).alias("best_level"),
        listed(F.col("unlabelled"), "b.entry").alias("near"), F.min(F.when(F.col("b").isNotNull(), level)).alias("near_level"),
    )
    out = asked.join(labelled, ["doc", "label"], "left").join(by_score, ["doc", "label"], "left")
    only = lambda when, c: F.when(when, c.cast("array<int>"))
    numbered = ~F.col("unlabelled") & ~F.col("excess") & placed
    place = F.col("unlabelled") & ~F.col("strict") & F.col("label").between(1, F.col("total"))
    high, medium = F.lit(3), F.lit(2)
    ways = [
        ("label", F.col("own"), high), ("strong", only(F.col("strong").isNotNull(), F.array("strong.entry")), high), ("id", F.col("ids"), high),
        ("sequence", only(numbered, F.sequence(F.col("first"), F.col("first") + F.greatest(F.col("n_entries") - 1, F.lit(0)))), medium),
        ("best", F.col("best"), F.col("best_level")), ("near", F.col("near"), F.col("near_level")), ("place", only(place, F.array(F.col("label") - 1)), medium),
    ]
    level = lambda n: F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), n)
    found = F.coalesce(*(F.when(F.size(c) > 0, F.struct(c.alias("found"), level(n).alias("confidence"), F.lit(by).alias("by"))) for by, c, n in ways))
    return out.select("doc", "label", found.alias("_f")).filter("_f IS NOT NULL").select("doc", "label", "_f.found", "_f.confidence", "_f.by")
