"""Personal data in texts: fixed forms, and identifiers that bootstrapped contexts give away.

One pass over the texts finds the fixed forms (e-mail and IP addresses, card and phone numbers), and mentions: the found spans and every other token
that looks like an identifier (LEAST_CHARS to MOST_CHARS characters, with a digit or an at sign), each with the lexical patterns around it: the two words before
it, or the word before and the word after, and its family (with an at sign, of digits, of digits and letters).

Then the graph of patterns and values is scored in rounds. The values of the fixed forms are the seeds. A pattern's confidence in a kind is the share of its distinct
values that are known to be of the kind, smoothed; one with enough known values is trusted. A value that isn't known becomes known if the trusted patterns
around it leave little doubt (noisy or); it counts with that confidence in the next round, which may trust further patterns. Mentions of known values that
no fixed form has found are the added spans: those in a trusted pattern of the kind, and those of long values everywhere.

Texts aren't shuffled, only mentions; patterns and values are aggregated before they meet, and each join has a side with one row for each key. Every search
takes time in proportion to the text: local parts of addresses are read backwards from the at sign, runs of digits only from their beginning.

Defined results: a null text is an empty one without spans; repeated rows and null ids keep their rows, each with its spans; columns other than doc_id
and text aren't read; an empty table stays empty. Spans count code points, the end is exclusive."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import durable, forget, pieces, row_ids

KINDS = ("email", "ip", "card", "phone")
#: Characters of an identifier; of a value that is marked wherever it stands, at least; characters of context that are read on each side.
LEAST_CHARS, MOST_CHARS, LONG_VALUE, WINDOW = 4, 64, 7, 64
#: Known values (in thousandths) and confidence of a trusted pattern; confidence of a found value; rounds.
SUPPORT, TRUST, KNOWN, ROUNDS = 3000, 0.5, 0.6, 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed forms, by kind, then start."""
    out = [(0, s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an at sign, without marks around them."""
    end = 0
    while m := _MARK.search(text, end):
        i = m.start()
        start = max(end, *(text.rfind(c, end, i) + 1 for c in " \n\t\r\x0b\x0c"))
        stop = _SPACE.search(text, i)
        end = stop.start() if stop else len(text)
        a, b = start, end
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b:
            yield a, b


def _word(token: str) -> str:
    return token.strip(".,;:!?\"'()[]{}<>").lower() or token


def _patterns(text: str, start: int, end: int) -> list[str]:
    """The patterns around a span, with the span's family in its place."""
    value = text[start:end]
    family = "@" if "@" in value else "9" if not any(c.isalpha() for c in value) else "a9"
    lead, tail = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    # A word that the window cuts is none.
    left = (lead if start <= WINDOW else lead.partition(" ")[2]).split()[-2:]
    right = (tail if end + WINDOW >= len(text) else tail.rpartition(" ")[0]).split()[:1]
    left, right = ["^", "^", *map(_word, left)][-2:], [*map(_word, right), "$"][0]
    return [f"{left[0]} {left[1]} <{family}>", f"{left[1]} <{family}> {right}"]


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int | None, str, list[str]]]:
    """(start, end, kind, value, patterns) of the found spans, and, without a kind, of other tokens that look like identifiers."""
    taken = sorted((s, e) for _, s, e in base)
    out, k = [(s, e, kind, text[s:e].lower(), _patterns(text, s, e)) for kind, s, e in base if e - s <= MOST_CHARS], 0
    reach = 0
    for s, e in _tokens(text):
        while k < len(taken) and taken[k][0] < e:
            reach, k = max(reach, taken[k][1]), k + 1
        if s >= reach and LEAST_CHARS <= e - s <= MOST_CHARS:
            out.append((s, e, None, text[s:e].lower(), _patterns(text, s, e)))
    return out


SPAN = "struct<kind:int,start:bigint,end:bigint>"
_MENTION = "struct<start:bigint,end:bigint,kind:int,value:string,patterns:array<string>>"


def read_texts(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, base, mentions), a written table with a row for each row of `docs`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    mention = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = row_ids()
        for batch in batches:
            for part in pieces(batch, "text"):
                base, found = [], []
                for text in part.column("text").to_pylist():
                    own = base_spans(text or "")
                    base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in own])
                    found.append([dict(zip(("start", "end", "kind", "value", "patterns"), x, strict=True)) for x in mentions(text or "", own)])
                rid = pa.array([next(ids) for _ in base], pa.int64())
                yield pa.RecordBatch.from_arrays([rid, part.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(mention))], names=["rid", "doc_id", "base", "mentions"])

    return durable(docs.select("doc_id", "text").mapInArrow(run, f"rid long, doc_id {kind}, base array<{SPAN}>, mentions array<{_MENTION}>"))


def pattern_scores(edges: DataFrame, known: DataFrame, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """(pattern, kind, confidence): the trusted patterns of the graph edges (pattern, value), by what is known (value, kind, milli: confidence in
    thousandths). A pattern's kind is that of most known values; of equals, the first."""
    met = edges.join(known.select(F.col("value").alias("_v"), "kind", "milli"), F.col("value") == F.col("_v"), "left")
    each = met.groupBy("pattern").agg(F.count("*").alias("n"), *(F.sum(F.when(F.col("kind") == k, F.col("milli")).otherwise(0)).alias(f"f{k}") for k in range(len(KINDS))))
    most = F.greatest(*(F.col(f"f{k}") for k in range(len(KINDS))))
    kind = F.coalesce(*(F.when(F.col(f"f{k}") == F.col("most"), F.lit(k)) for k in range(len(KINDS))))
    scored = each.withColumn("most", most).select("pattern", kind.alias("kind"), "most", ((F.col("most") + 1000) / (1000.0 * (F.col("n") + 2))).alias("confidence"))
    return scored.filter((F.col("most") >= support) & (F.col("confidence") >= trust)).select("pattern", "kind", "confidence")


def value_scores(edges: DataFrame, trusted: DataFrame, least: float = KNOWN) -> DataFrame:
    """(value, kind, milli): the values that trusted patterns leave little doubt about, with their confidence in thousandths."""
    doubt = edges.join(trusted, "pattern").groupBy("value", "kind").agg(F.sum(F.log(1 - F.col("confidence"))).alias("doubt"))
    sure = doubt.select("value", "kind", F.round(1000 * (1 - F.exp("doubt"))).cast("long").alias("milli")).filter(F.col("milli") >= 1000 * least)
    best = sure.groupBy("value").agg(F.min(F.struct(-F.col("milli"), "kind")).alias("b"))  # one kind: the surest, of equals the first
    return best.select("value", F.col("b.kind").alias("kind"), (-F.col("b.col1")).alias("milli"))


def bootstrap(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(trusted, known) after at most so many rounds, written tables: patterns (pattern, kind, confidence) and values (value, kind, milli), seeds included."""
    known, trusted = durable(seeds.select("value", "kind", F.lit(1000).cast("long").alias("milli"))), None
    for _ in range(rounds):
        now = durable(pattern_scores(edges, known))
        new = value_scores(edges, now).join(seeds.select("value"), "value", "left_anti")
        after = durable(seeds.select("value", "kind", F.lit(1000).cast("long").alias("milli")).union(new))
        grown = after.count() > known.count()
        forget(known)
        if trusted is not None:
            forget(trusted)
        known, trusted = after, now
        if not grown:
            break
    return trusted, known


def private_spans(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, added), a row for each row of `docs`: the spans (kind, a place in KINDS; start; end) of fixed forms and those found by contexts, each by
    kind, then start."""
    texts = read_texts(docs)
    each = texts.select("rid", F.explode("mentions").alias("m")).select("rid", "m.*")
    edges = durable(each.select("value", F.explode("patterns").alias("pattern")).distinct())
    seeds = durable(each.filter("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind")))
    trusted, known = bootstrap(edges, seeds, rounds)
    sure = known.select(F.col("value").alias("_v"), F.col("kind").alias("_kind"))
    unseen = each.filter("kind IS NULL").join(sure, F.col("value") == F.col("_v")).select("rid", "start", "end", "value", "_kind", F.explode("patterns").alias("pattern"))
    inside = trusted.select(F.col("pattern").alias("_p"), F.col("kind").alias("_pk"))
    marked = unseen.join(inside, (F.col("pattern") == F.col("_p")) & (F.col("_kind") == F.col("_pk")), "left").filter(F.col("_p").isNotNull() | (F.length("value") >= LONG_VALUE))
    added = marked.select("rid", F.struct(F.col("_kind").alias("kind"), "start", "end").alias("s")).groupBy("rid").agg(F.sort_array(F.collect_set("s")).alias("added"))
    none = F.array().cast(f"array<{SPAN}>")
    return texts.select("rid", "doc_id", "base").join(added, "rid", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span as its kind in square brackets; spans that overlap are one, named by the first."""
    at = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done"))
    name = lambda s: F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit("]"))
    gap = lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda a, s: F.when(s["start"] < a["done"], F.struct(a["out"].alias("out"), F.greatest(a["done"], s["end"]).alias("done"))).otherwise(F.struct(F.concat(a["out"], gap(a["done"], s["start"]), name(s)).alias("out"), s["end"].alias("done")))
    return F.aggregate(at, begin, step, lambda a: F.concat(a["out"], F.substr(text, (a["done"] + 1).cast("int"))))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    together = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(together).alias("spans"), F.size("added").cast("long").alias("n_added"))
