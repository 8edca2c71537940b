"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon gives each word of a clause one of nine symbols. Five small transducers read the symbols: insult (alone or one of a pile), threat (a
threatening word and a target within a few words, in either order), relation (an insult that is addressed: "you" right before it; or predicated: a target, a
copula within a few words, the insult within a few more), negation (a scope of a few words) and reported speech (to the clause's end, or between
quotation marks). compose() multiplies them once into one table of arcs, whose weights are the products of theirs; a clause is run over that table.

So it is matched clauses that score. An insult that is aimed in its clause, or piled on another, counts; a lone one ("the trash is out") counts only in a crowd:
different lone insults of one document count from the second on. Aimed insults and threats with a target decide by themselves, with the fixed odds
SURE: labels hardly ever show them, so they aren't learned. A document's score is 1 - (1 - p) (1 - SURE) ^ n: p a logistic function of the sums over its clauses, n
the weight of its threats and aimed insults that are neither denied nor, in full, reported.

Insult words of the lexicon: SEEDS, and words and beginnings of words that the training rows show to be toxic (learn_lexicon). The training
rows are a bounded sample, at most SAMPLE labelled rows of the training fold in the order of a hash of doc_id; the score reads the text alone. All
that the sample shows is learned, and so the lexicon is bounded by it and by nothing else.

Defined results: null and empty texts match nothing and get the score of a text without matches; labels that are null are ignored, a document
labelled more than once counts as toxic if any label says so; without training rows of both kinds PRIOR serves as the
model; rows that repeat are scored row by row; columns of `docs` are passed through, one named score is replaced."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import durable, fold, forget, pieces, plain_names

#: The lexicon's words. Weights of insults are 1 unless learned.
SEEDS = {
    "insult": "idiot idiots stupid moron morons loser losers clown clowns scum trash pathetic worthless disgusting imbecile cretin dumb dumbass fool dimwit vermin filth garbage jerk bastard bastards dickhead asshole bitch whore slut coward parasite parasites subhuman dumm dummkopf trottel arschloch abschaum idiota imbécil estúpido estúpida basura escoria stupide connard ordure crétin minable".split(),
    "threat": "kill murder hurt destroy strangle stab töten umbringen matar matarte asesinar tuer".split(),
    "address": "you du ihr tú usted ustedes vosotros tu vous".split(),
    "target": "they them he him she her yourself everyone dich euch sie er ihn ti él ella ellos ellas toi il elle ils elles lui".split(),
    "copula": "am are is was were be being bin bist ist seid sind war wart waren soy eres es somos son era eran suis est êtes sont étais était étaient".split(),
    "negation": "not no never neither nor isn't aren't wasn't don't doesn't didn't ain't can't nobody nicht kein keine nie nunca jamás ne pas jamais".split(),
    "report": "said says say told called calls claimed wrote quoted reported according alleged denied sagte schrieb laut dijo según dit écrit selon".split(),
}
#: Symbols; a word of two classes has the first of them in the order of PRECEDENCE.
OTHER, INSULT, THREAT, TARGET, ADDRESS, COPULA, NEGATION, REPORT, QUOTE = range(9)
SYMBOLS = 9
PRECEDENCE = [("negation", NEGATION), ("report", REPORT), ("address", ADDRESS), ("target", TARGET), ("copula", COPULA), ("threat", THREAT), ("insult", INSULT)]
#: Words that a negation reaches, between insults of a pile, and between a threat and its target, a target and its copula, a copula and what it predicates.
SCOPE, NEAR, REACH = 4, 3, 3
#: Weights of arcs: in a negation's scope, in reported speech, aimed, on another insult, and both.
NEGATED, REPORTED, AIMED, PILED, AIMED_PILED = 0.3, 0.5, 1.5, 0.8, 1.875
#: What events count as: asserted insults that are aimed, ones that are only piled, denied and reported ones, threats, lone insults.
AIMED_AT, ASSERTED, DENIED, QUOTED, THREATENED, LONE = range(6)
KINDS = 6
#: How surely a threat, or an aimed insult, makes a document toxic.
SURE = 0.75
#: Bounds of learning: labelled rows, the least lower bound (two standard errors) of an arc's log odds, and lengths of beginnings of words.
SAMPLE, LEAST_ODDS, BEGINNINGS = 20_000, 2.5, (4, 5, 6)
#: A learned arc weighs its sure log odds over SHARE, HEAVIEST at most; certain seeds weigh 1 at least.
SHARE, HEAVIEST = 3, 2.0
#: Logistic weights without training rows: constant, insults that are asserted, denied and reported, the worst clause, and the crowd of lone ones; and how strongly
#: fitted ones keep to them.
PRIOR, RIDGE = (-3.5, 1.5, 0.3, 0.5, 4.0, 6.5), 0.1
FEATURES = len(PRIOR)
#: Words whose symbols a task remembers.
MEMORY = 200_000
_LETTERS = r"[^\W\d_]+"
_TOKENS = re.compile(rf"{_LETTERS}(?:['’]{_LETTERS})?|[.!?;:\n]|[\"“”«»]")
_ENDS = frozenset(".!?;:\n")
_QUOTES = frozenset("\"“”«»")


@dataclass(frozen=True)
class Transducer:
    """States by name, where paths start and may end, and arcs: (state, symbol) to (state, output). A missing arc ends the path."""

    starts: tuple[str, ...]
    ends: frozenset[str]
    arcs: dict[tuple[str, int], tuple[str, str]]


def _fading(name: str, mark: int, reach: int, quiet: str = "", at: str = "") -> Transducer:
    """After `mark` the next `reach` symbols are read in the states of `name`; reading one there gives `at`, elsewhere `quiet`."""
    states = ["-", *(f"{name}{k}" for k in range(1, reach + 1))]
    arcs = {(x, s): (states[reach] if s == mark else states[max(0, k - 1)], at if k else quiet) for k, x in enumerate(states) for s in range(SYMBOLS)}
    return Transducer(("-",), frozenset(states), arcs)


def _report() -> Transducer:
    arcs = {}
    for reported in (False, True):
        for quoted in (False, True):
            state = f"{'said' if reported else ''}{'quoted' if quoted else ''}" or "-"
            for s in range(SYMBOLS):
                r, q = reported or s == REPORT, quoted ^ (s == QUOTE)
                arcs[state, s] = f"{'said' if r else ''}{'quoted' if q else ''}" or "-", "reported" if reported or quoted else ""
    return Transducer(("-",), frozenset(x for x, _ in arcs), arcs)


def _relation() -> Transducer:
    """What an insult is to a person. Waits for a copula for REACH symbols after a target, and for an insult for REACH symbols after that; one right after an
    address is aimed, too. An insult lets the wait for more of them begin anew."""
    arcs = {}
    for kind in ("person", "predicate"):
        for k in range(REACH + 1):
            state = f"{kind}{k}" if k else "-"
            for s in range(SYMBOLS):
                if s in (TARGET, ADDRESS):
                    to = "addressed" if s == ADDRESS else f"person{REACH}"
                elif s == COPULA:
                    to = f"predicate{REACH}" if k else "-"
                elif s == INSULT and kind == "predicate" and k:
                    to = f"predicate{REACH}"
                else:
                    to = f"{kind}{k - 1}" if k > 1 else "-"
                arcs[state, s] = to, "aimed" if s == INSULT and kind == "predicate" and k else ""
    for s in range(SYMBOLS):  # like person{REACH}, but for an insult that follows at once
        arcs["addressed", s] = (f"predicate{REACH}", "aimed") if s == INSULT else arcs[f"person{REACH}", s]
    return Transducer(("-",), frozenset(x for x, _ in arcs), arcs)


def _threat() -> Transducer:
    """A threat waits for a target, and a target for a threat, for REACH symbols."""
    arcs = {}
    for kind in ("threat", "target"):
        for k in range(REACH + 1):
            state = f"{kind}{k}" if k else "-"
            for s in range(SYMBOLS):
                if s == THREAT:
                    arcs[state, s] = (f"target{k}", "threat") if kind == "target" and k else (f"threat{REACH}", "")
                elif s in (TARGET, ADDRESS):
                    arcs[state, s] = f"target{REACH}", "threat" if kind == "threat" and k else ""
                else:
                    arcs[state, s] = f"{kind}{k - 1}" if k > 1 else "-", ""
    return Transducer(("-",), frozenset(x for x, _ in arcs), arcs)


#: The grammar: what each transducer says of the symbol that it reads.
GRAMMAR = {"insult": _fading("near", INSULT, NEAR, "single", "piled"), "threat": _threat(), "relation": _relation(), "negation": _fading("not", NEGATION, SCOPE, "", "negated"), "report": _report()}


def event(symbol: int, said: dict[str, str]) -> tuple[int, float] | None:
    """What an arc of the product emits: the kind of event and its weight; None if nothing."""
    negated, reported = said["negation"] == "negated", said["report"] == "reported"
    if symbol == INSULT:
        piled, aimed = said["insult"] == "piled", said["relation"] == "aimed"
        if not piled and not aimed:
            return None if negated else (LONE, REPORTED if reported else 1.0)
        weight = (AIMED_PILED if piled else AIMED) if aimed else PILED
        if negated:
            return DENIED, weight * NEGATED
        return (QUOTED, weight * REPORTED) if reported else (AIMED_AT if aimed else ASSERTED, weight)
    if said["threat"] == "threat" and not negated:
        return THREATENED, REPORTED if reported else 1.0
    return None


@dataclass(frozen=True)
class Composed:
    """The product of the grammar's transducers: for each state and symbol the next state (-1: none), and the event's kind (-1: none) and weight."""

    starts: list[int]
    ends: list[bool]
    next: list[list[int]]
    kind: list[list[int]]
    weight: list[list[float]]

    def clause(self, symbols: list[int], weights: list[float]) -> list[tuple[int, int, float]]:
        """A clause's events (place, kind, weight), on the one path that ends well. weights: the lexicon's, of each word."""
        for state in self.starts:
            out = []
            for i, (s, w) in enumerate(zip(symbols, weights, strict=True)):
                if (kind := self.kind[state][s]) >= 0:
                    out.append((i, kind, w * self.weight[state][s]))
                if (state := self.next[state][s]) < 0:
                    break
            if state >= 0 and self.ends[state]:
                return out
        return []


def compose(grammar: dict[str, Transducer] = GRAMMAR) -> Composed:
    """All states of the product that a clause can reach."""
    number = {x: i for i, x in enumerate(product(*(t.starts for t in grammar.values())))}
    out = Composed(list(range(len(number))), [], [], [], [])
    todo = list(number)
    for state in todo:  # grows on the way
        out.ends.append(all(x in t.ends for x, t in zip(state, grammar.values(), strict=True)))
        for row in (out.next, out.kind, out.weight):
            row.append([])
        for s in range(SYMBOLS):
            steps = [t.arcs.get((x, s)) for x, t in zip(state, grammar.values(), strict=True)]
            if None in steps:
                after, emitted = -1, None
            else:
                to = tuple(x for x, _ in steps)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                after, emitted = number[to], event(s, dict(zip(grammar, (x for _, x in steps), strict=True)))
            out.next[-1].append(after)
            out.kind[-1].append(emitted[0] if emitted else -1)
            out.weight[-1].append(emitted[1] if emitted else 0.0)
    return out


class Grammar:
    """A lexicon over the composed grammar. learned: weights of words, and of beginnings of words, which end in a star."""

    def __init__(self, learned: dict[str, float], table: Composed | None = None) -> None:
        import ahocorasick

        self.table = table or compose()
        self.words = {}
        self.beginnings = {w[:-1]: (INSULT, x) for w, x in learned.items() if w.endswith("*")}
        insults = {w: x for w, x in learned.items() if not w.endswith("*")}
        insults |= {w: max(1.0, insults.get(w, 0), *(x for k in BEGINNINGS if len(w) > k for _, x in [self.beginnings.get(w[:k], (INSULT, 0))]), 0) for w in SEEDS["insult"]}
        for name, symbol in reversed(PRECEDENCE):
            self.words |= {w: (symbol, x) for w, x in insults.items()} if symbol == INSULT else {w: (symbol, 1.0) for w in SEEDS[name]}
        self.words |= dict.fromkeys(_QUOTES, (QUOTE, 1.0))
        self.memory: dict[str, tuple[int, float]] = {}
        self.trigger = ahocorasick.Automaton()
        for w in {*insults, *self.beginnings, *SEEDS["threat"]}:
            self.trigger.add_word(w, w)
        self.trigger.make_automaton()

    def read(self, word: str) -> tuple[int, float]:
        """A word's symbol and weight; of beginnings the longest counts."""
        if (found := self.words.get(word)) is None:
            found = next((x for k in reversed(BEGINNINGS) if (x := self.beginnings.get(word[:k]))), (OTHER, 1.0))
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        self.memory[word] = found
        return found

    def measure(self, text: str | None) -> tuple[list[float], float]:
        """The features, constant and logs of sums (see PRIOR), and the weight of what decides by itself."""
        sums, worst, alone = [0.0] * KINDS, 0.0, {}
        lower = text.lower() if text else ""
        if next(iter(self.trigger.iter(lower)), None):
            clause: list[tuple[int, float]] = []
            words: list[str] = []
            known, stirs = self.memory.get, False
            for token in [*_TOKENS.findall(lower), "."]:
                if token in _ENDS:
                    if stirs:
                        own = [0.0] * KINDS
                        for i, kind, weight in self.table.clause(*map(list, zip(*clause, strict=True))):
                            own[kind] += weight
                            if kind == LONE:
                                alone[words[i]] = max(weight, alone.get(words[i], 0.0))
                        sums, worst = [a + b for a, b in zip(sums, own, strict=True)], max(worst, own[AIMED_AT] + own[ASSERTED])
                    clause, words, stirs = [], [], False
                else:
                    found = known(token) or self.read(token)
                    clause.append(found)
                    words.append(token)
                    stirs = stirs or found[0] == INSULT or found[0] == THREAT
        crowd = sum(alone.values())
        if not sums[AIMED_AT] + sums[ASSERTED]:  # else the first lone one is one of several
            crowd -= max(alone.values(), default=0.0)
        x = [1.0, *(math.log1p(v) for v in (sums[AIMED_AT] + sums[ASSERTED], sums[DENIED], sums[QUOTED], worst, crowd))]
        return x, sums[THREATENED] + sums[AIMED_AT] / AIMED

    def features(self, text: str | None) -> list[float]:
        return self.measure(text)[0]


def document_score(x: np.ndarray, decided: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The scores of rows of features, and of what decides by itself."""
    p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
    return 1 - (1 - p) * (1 - SURE) ** decided


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `sample` labelled rows outside the held-out fold. The sampled ids are broadcast."""
    chosen = labels.filter(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), 3) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _beginnings(words: Column, k: int) -> Column:
    """The first k letters, and a star, of each longer word."""
    return F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.left(w, F.lit(k)), F.lit("*")))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words, and beginnings of longer words (with a star), whose log odds of standing in a toxic text are surely high, with weights by those
    odds. One is left out if a beginning of it is as sure. The driver gets what is sure, which stands in several of the sample's texts each."""
    n = rows.groupBy("toxic").count().collect()
    toxic, clean = (sum(r["count"] for r in n if bool(r["toxic"]) == k) for k in (True, False))
    if not toxic or not clean:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    begun = [_beginnings(words, k) for k in BEGINNINGS]
    arcs = rows.select(F.explode(F.array_distinct(F.concat(words, *begun))).alias("arc"), "toxic")
    counted = arcs.groupBy("arc").agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    sure = {r["arc"]: r["sure"] for r in counted.select("arc", (odds - 2 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))).alias("sure")).filter(F.col("sure") >= LEAST_ODDS).collect()}
    shorter = lambda arc: [f"{arc[:k]}*" for k in BEGINNINGS if k < len(arc.rstrip("*"))]
    kept = [arc for arc, x in sure.items() if not any(sure.get(y, 0) >= x for y in shorter(arc))]
    return {arc: min(HEAVIEST, sure[arc] / SHARE) for arc in kept}


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards PRIOR: few rows change little. The constant is all but free."""
    prior = np.array(PRIOR)
    if not len(y) or y.min() == y.max():
        return prior
    w, shrink = prior.copy(), np.diag([1e-3] + [RIDGE] * (x.shape[1] - 1))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + shrink, x.T @ (y - p) - shrink @ (w - prior))
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    """The lexicon's learned arcs and the logistic weights."""

    insult: dict[str, float]
    weights: list[float]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the training fold; the driver receives at most `sample` rows of FEATURES numbers."""
    texts = training_rows(docs, labels, sample).filter("text IS NOT NULL").groupBy(F.md5("text").alias("_h"))
    rows = durable(texts.agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).drop("_h"))  # copies count once
    lexicon = learn_lexicon(rows)

    table = compose()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon, table)
        for batch in batches:
            for part in pieces(batch, "text"):
                x = [grammar.features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), part.column("toxic").cast(pa.float64())], names=["x", "y"])

    got = rows.mapInArrow(run, "x array<double>, y double").collect()
    forget(rows)
    x, y = np.array([r["x"] for r in got]).reshape(-1, FEATURES), np.array([float(r["y"] > 0) for r in got])
    return Model(lexicon, fit(x, y).tolist())


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` with the added column score, between 0 and 1."""
    source, keep, back = plain_names(docs, ["score"])
    table = compose()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, w = Grammar(model.insult, table), np.array(model.weights)
        for batch in batches:
            for part in pieces(batch, "text"):
                measured = [grammar.measure(t) for t in part.column("text").to_pylist()]
                x, decided = np.array([m[0] for m in measured]).reshape(-1, FEATURES), np.array([m[1] for m in measured])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(document_score(x, decided, w))], names=[*keep, "score"])

    return back(source.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in source.schema), "score double"])))


#: A document with at least this score is toxic.
TOXIC = 0.7


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
