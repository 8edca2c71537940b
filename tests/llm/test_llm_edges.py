"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from citelake.llm import bpe_chunks, decontamination, language_id, licenses, line_dedup, near_dedup, quality, simhash, token_counts, toxicity, url_filter

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 5000} of the long text" for i in range(30_000))
TEXTS = [None, "", " \n\t ", "The MIT License, you idiot.", "The MIT License, you idiot.", "Ünïcode ß 漢字 😀 <|endoftext|>", "!!! ??? ...", LONG]
#: Names that operators use for what they add or for what they need on the way.
CLASHING = ["score", "labels", "n_words", "items", "ids", "decoded", "kept", "host", "rule", "n_dropped", "row", "term", "n", "word", "page", "pair", "node", "_w", "_base", "_lines", "_own", "_host", "_id", "_text", "_from", "_rest", "_s", "_good", "rid", "first", "root", "a.b", "text_hash", "h", "c0"]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i if i != 3 else None, t, "en" if i % 2 else None, None if i == 2 else "s") for i, t in enumerate(TEXTS)]
    table = spark.createDataFrame(data + [data[4], data[4]], SCHEMA)
    return table.select("*", *(F.lit("x").alias(c) for c in CLASHING)).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 1), (4, 1, 0), (5, 1, 0), (6, None, None), (None, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "the mit license you"), (1, "the mit license you"), (2, None), (3, ""), (None, "UNICODE")], "item_id long, text string")


#: (operator, columns it adds); each takes the documents and the fixtures that it needs.
PASSING = {
    "licenses": (lambda d, **_: licenses.license_scan(d), licenses.ADDED),
    "lines": (lambda d, **_: line_dedup.dedup_lines(d, min_pages=1, ratio=0.9), ["n_dropped"]),
    "quality": (lambda d, labels, **_: quality.quality_rules(d, quality.log_ratios(d, labels)), quality.ADDED),
    "toxicity": (lambda d, labels, **_: toxicity.toxicity(d, toxicity.train(d, labels)), ["score"]),
    "chunks": (lambda d, **_: bpe_chunks.encode_documents(d, TOKENIZER), ["ids", "decoded"]),
    "contamination": (lambda d, items, **_: decontamination.contamination(d, items), decontamination.ADDED),
}
OWN = {
    "tokens": lambda d, **_: token_counts.token_counts(d, TOKENIZER),
    "simhash": lambda d, **_: simhash.near_duplicates(d),
    "languages": lambda d, **_: language_id.identify_languages(d),
}


@pytest.mark.parametrize("name", sorted(PASSING))
def test_rows_and_columns_pass(docs, labels, items, name):
    run, added = PASSING[name]
    got = run(docs, labels=labels, items=items)
    assert sorted(got.columns) == sorted([c for c in docs.columns if c not in added] + added)
    assert got.count() == docs.count()
    rest = [c for c in CLASHING if c not in added]
    assert got.select(*(F.col(f"`{c}`") for c in rest)).distinct().collect() == [tuple("x" for _ in rest)]


@pytest.mark.parametrize("name", sorted(OWN))
def test_rows_stay(docs, labels, items, name):
    assert OWN[name](docs, labels=labels, items=items).count() == docs.count()


@pytest.mark.parametrize("name", sorted({**PASSING, **OWN}))
def test_empty_tables(docs, labels, items, name):
    run = PASSING[name][0] if name in PASSING else OWN[name]
    assert run(docs.limit(0), labels=labels.limit(0), items=items.limit(0)).count() == 0
    assert run(docs, labels=labels.limit(0), items=items.limit(0)).count() == docs.count()


def by_text(frame, *columns):
    return {r["text"]: tuple(r[c] for c in columns) for r in frame.collect()}


def test_licenses(docs):
    got = by_text(licenses.license_scan(docs), "n_words", "n_base", "first_word", "last_word", "base_labels", "score")
    assert got[None] == got[""] == got[" \n\t "] == got["!!! ??? ..."] == (0, 0, None, None, "", 0.0)
    assert got[TEXTS[3]][:5] == (5, 1, 1, 1, "mit")
    assert got[LONG][0] == 150_000


def test_license_alignment(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    mixed = "files documentation associated permission is hereby granted free of charge and then associated documentation files nothing else charge free"
    texts = [notice, f"x y {notice}", "Apache License and General Public License and MIT license mit license", "Licensed under the Apache License, Version 2.0", mixed]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_scan(table).collect()}
    assert got[0]["labels"] == got[1]["labels"] == "mit-text" and got[0]["score"] == got[1]["score"] == 1.0
    assert (got[2]["base_labels"], got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == ("apache,gpl,mit", 4, 0, 9)
    assert got[3]["labels"] == "apache,apache-2.0"
    assert got[4]["score"] < 1


def test_a_file_of_many_notices(spark):
    """Each notice is found in whatever company, and words of one frequency don't depend on their order in the table."""
    every = " and ".join(text for _, text, _ in licenses.TEMPLATES)
    table = spark.createDataFrame([(1, every), (2, "filler " * 500 + every + " more filler" * 500), (3, every), (4, "the free software and the source code form of any person")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_scan(table.repartition(3)).collect()}
    for i in (1, 2, 3):
        assert set(got[i]["labels"].split(",")) == {label for label, _, _ in licenses.TEMPLATES} | {"apache", "gpl", "mit"}
        assert got[i]["score"] == 1.0
    assert (got[4]["labels"], got[4]["score"]) == ("", 0.0)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "https://WWW.Example.COM/en/71?q", "http://a.example.com/en/8", "http://example.net/de/8#x", "http://x.net/de/9", "http://notexample.net/dx", "http://x.org?es/", "http://x.org/es/", "ftp://u@h.org:1/es/://b", "http://example.com/en/7", "http://example.com/en/7"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").select("*", *(F.lit("x").alias(c) for c in ("host", "score", "_s", "_key", "row")))
    got = {r["page_id"]: r for r in url_filter.url_filter(pages).collect()}
    assert len(got) == len(urls) and got[0]["_s"] == "x"
    assert all((got[i]["host"], got[i]["path"], got[i]["rule"]) == ("", "", None) for i in range(4))
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("www.example.com", "/en/71", "example.com/en/7", "allow")
    assert [got[i]["rule"] for i in range(5, 14)] == ["com/en/", "example.net/de/8", "net/de/", None, None, "org/es/", None, "example.com/en/7", "example.com/en/7"]
    assert got[11]["path"] == "/es/://b"
    assert all(r["score"] is None for r in got.values() if r["rule"])
    assert url_filter.url_filter(pages.limit(0)).count() == 0
    one = url_filter.url_filter(pages.filter("page_id in (8, 12)")).collect()
    assert {r["verdict"] for r in one} == {"allow"} and {r["score"] for r in one} == {None, 0.0}  # nothing is blocked: nothing to learn


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(TOKENIZER)
    kept = {r["doc_id"]: r for r in token_counts.token_counts(docs, TOKENIZER).collect()}
    for i, t in enumerate(TEXTS):
        assert kept[None if i == 3 else i]["n_tokens"] == len(own.encode(t or "", add_special_tokens=False).ids)
    small = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, TOKENIZER, head=2).collect()}
    assert small == {k: r["n_tokens"] for k, r in kept.items()}  # whatever is broadcast


ODD = ["<|endoftext|>", "a<|ENDOFTEXT|>b", "A<|startoftext|><|endoftext|> x", "İstanbul ıı ǅ ﬁ ①", "é é", "it's we'LL 12345 3½", "a b c　d\x0b\x0ce\x85f", "x" * 5000, "漢字かな 한국어 ไทย हिन्दी", "​﻿\x00\x1f", "🙂👩‍👩‍👧 ok", "º ª ² ½ Ⅳ", "don’t — “quoted”…", "\r\n\r\n \t", "'s't're", "A" * 70 + " " + "b" * 70]


def test_encoding_is_exact(spark):
    """Odd texts, alone and within passages that documents share, where chunk joins need repair."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(TOKENIZER)
    shared = " ".join(f"the shared passage number {i} isn't short" for i in range(200))
    texts = [*ODD, *(f"{o}{shared[i * 7:]}{o}" for i, o in enumerate(ODD)), *(f"{shared}{o}{shared}" for o in ODD), *TEXTS, None]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for dictionary in (0, 3, bpe_chunks.DICTIONARY):
        for r in bpe_chunks.encode_documents(table, TOKENIZER, dictionary=dictionary).collect():
            ids = own.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["ids"] == ids, texts[r["doc_id"]]
            assert r["decoded"] == own.decode(ids, skip_special_tokens=False)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(table, TOKENIZER).collect()}
    assert counts == {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_every_code_point_is_cut_as_the_library_cuts_it():
    from citelake.llm.pretokens import Pretokenizer, read_spec

    own = Pretokenizer(read_spec(TOKENIZER))
    texts = [f"a{c}b1{c}{c}.{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)])]
    for start in range(0, len(texts), 20_000):
        part = texts[start : start + 20_000]
        for t, e in zip(part, own.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
            assert own.encode(t).tolist() == e.ids, hex(ord(t[1]))


def test_chunks_cover_the_text():
    for text in (*ODD, LONG[:50_000], "x" * 10_000):
        ends = bpe_chunks.cuts(text)
        assert "".join(text[a:b] for a, b in zip([0, *ends], ends)) == text
        assert all(b - a <= bpe_chunks.MOST for a, b in zip([0, *ends], ends))
    a, b = bpe_chunks.chunks("prefix one " + LONG[:20_000]), bpe_chunks.chunks("another, longer prefix " + LONG[:20_000])
    assert len({k for *_, k in a} & {k for *_, k in b}) > 0.8 * len(a)  # equal passages are cut equally


def test_lines(spark):
    head = "Subscribe now"
    data = [(i, "hot" if i < 30 else "cold", f"{head}\nown line {i}\n\nend {i % 3}") for i in range(40)] + [(99, "hot", None), (98, None, head), (97, "hot", "")]
    table = spark.createDataFrame(data, "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(table, min_pages=10, ratio=0.5).collect()}
    assert got[0]["text"] == "own line 0\n\nend 0" and got[0]["n_dropped"] == 1
    assert got[35]["n_dropped"] == 1 and got[98]["text"] == head and got[99]["text"] is None and got[97]["text"] == ""
    few = spark.createDataFrame([(i, "s", f"menu\nown {i}" + ("\ntwice" if i < 2 else "")) for i in range(4)], "doc_id long, source string, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(few).collect()} == {i: f"own {i}" + ("\ntwice" if i < 2 else "") for i in range(4)}  # a small host
    copies = table.filter("doc_id = 0").crossJoin(spark.range(50)).select("doc_id", "source", "text")
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(copies).collect()} == {0}  # copies of one page are one page


def test_quality_edges(docs, labels):
    got = by_text(quality.quality_rules(docs, quality.log_ratios(docs, labels)), "n_words", "word_chars", "n_symbols", "base_failed", "score", "kept")
    assert got[None] == got[""] == got[" \n\t "] == (0, 0, 0, True, 0.0, False)
    assert got["Ünïcode ß 漢字 😀 <|endoftext|>"][:3] == (5, 24, 4)


def plain_events(grammar, text):
    """By rules on lists of words: (clause, word, kind, weight) of each event."""
    T, out = toxicity, []
    clauses, own = [], []
    for token in [*T._TOKENS.findall((text or "").lower()), "."]:
        if token in T._ENDS:
            clauses.append(own)
            own = []
        else:
            own.append(token)
    for c, words in enumerate(clauses):
        read = [grammar.read(w) for w in words]
        symbols = [s for s, _ in read]
        before = lambda i, n, kinds: [j for j in range(max(0, i - n), i) if symbols[j] in kinds]  # noqa: E731, B023
        people, waiting = (T.TARGET, T.ADDRESS), None  # waiting: up to which place an insult is predicated
        named = None  # up to which place a copula belongs to a person
        quoted = said = False
        last_threat = last_target = None
        for i, (s, w) in enumerate(read):
            reported = said or quoted
            negated = bool(before(i, T.SCOPE, (T.NEGATION,)))
            aimed = s == T.INSULT and ((waiting is not None and i <= waiting) or (i > 0 and symbols[i - 1] == T.ADDRESS))
            if s == T.INSULT:
                piled = bool(before(i, T.NEAR, (T.INSULT,)))
                if not aimed and not piled:
                    if not negated:
                        out.append((c, words[i], T.LONE, w * (T.REPORTED if reported else 1)))
                else:
                    base = w * ((T.AIMED_PILED if piled else T.AIMED) if aimed else T.PILED)
                    kind = T.DENIED if negated else T.QUOTED if reported else T.AIMED_AT if aimed else T.ASSERTED
                    out.append((c, words[i], kind, base * (T.NEGATED if negated else T.REPORTED if reported else 1)))
            # A threat near a target: the nearer of the two kinds counts.
            near = (last_target is not None and i - last_target <= T.REACH) if s == T.THREAT else (last_threat is not None and i - last_threat <= T.REACH) if s in people else False
            if near and not negated:
                out.append((c, words[i], T.THREATENED, w * (T.REPORTED if reported else 1)))
            if s == T.THREAT:
                if near:
                    last_target += 1  # a threat uses up nothing of the reach
                else:
                    last_threat, last_target = i, None
            elif s in people:
                last_threat, last_target = None, i
            if aimed:
                waiting, named = i + T.REACH, None
            elif s in people:
                named, waiting = i + T.REACH, None
            elif s == T.COPULA:
                waiting, named = (i + T.REACH if (named is not None and i <= named) or (waiting is not None and i <= waiting) else None), None
            said |= s == T.REPORT
            quoted ^= s == T.QUOTE
    return out


def plain_score(grammar, text, weights):
    T, events = toxicity, plain_events(grammar, text)
    total = lambda *kinds: sum(w for _, _, k, w in events if k in kinds)
    worst = max((sum(w for c, _, k, w in events if c == x and k in (T.AIMED_AT, T.ASSERTED)) for x in {e[0] for e in events}), default=0)
    lone = {}
    for _, word, k, w in events:
        if k == T.LONE:
            lone[word] = max(w, lone.get(word, 0))
    said = total(T.AIMED_AT, T.ASSERTED)
    crowd = sum(lone.values()) - (0 if said else max(lone.values(), default=0))
    z = weights[0] + sum(w * np.log1p(v) for w, v in zip(weights[1:], (said, total(T.DENIED), total(T.QUOTED), worst, crowd)))
    return 1 - (1 - 1 / (1 + np.exp(-z))) * (1 - T.SURE) ** (total(T.THREATENED) + total(T.AIMED_AT) / T.AIMED)


def test_score_is_that_of_plain_rules(spark):
    """Random clauses of all classes of words, and the sentences of other tests."""
    import random

    rng, T = random.Random(4), toxicity
    learned = {"snurf*": 0.7, "blorx": 1.6}
    g = T.Grammar(learned)
    pool = [rng.choice(T.SEEDS[c]) for c in T.SEEDS for _ in range(4)] + ["snurfled", "blorx", "plain", "word", "of", '"', '"', ".", "!", "idiot", "you", "are", "they"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None, "", "Idiot"]
    weights = [-4.0, 1.1, 0.2, 0.4, 3.0, 6.0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["score"] for r in T.toxicity(docs, T.Model(learned, weights)).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain_score(g, text, weights)), text


def test_grammar():
    g = toxicity.Grammar({"snurf*": 0.7})
    at = lambda t: [round(x, 3) for x in g.features(t)[1:]]
    sure = lambda t: g.measure(t)[1]
    assert at("You idiot") > at("An idiot") and sure("You are not an idiot.") == 0 < at("You are not an idiot.")[1]
    assert at("She said you idiot")[0] == 0 < at("She said you idiot")[2] and at('He wrote "you idiot"')[0] == 0
    assert sure("I will kill you") == 1 and sure("I kill time") == 0 == sure("I will not kill you") and sure("Dich töten") == 1
    assert sure("You may, after a very long time, kill") == 0 and at(None) == at("") == at("plain words") == [0] * 5
    assert sure("Not now. You idiot.") == 1  # a negation ends with its clause
    assert at("idiotic") == at("Idiot") == at("Kill") == at("The idiot. An idiot!") == [0] * 5  # a lone word, however often it stands
    assert at("Idiot moron")[0] > 0 and at("An idiot. A moron.")[4] > 0 == at("An idiot. A moron.")[0]  # a pile, and a crowd
    assert sure("you snurfled") > 0 == sure("you snurs")


@pytest.mark.parametrize("learned", [False, True])
def test_benign_sentences_and_threats(spark, learned):
    """Nouns that nobody is called stay under the threshold, threats and called names are over it: with PRIOR, and with a model learned from a small table."""
    model = toxicity.Model({}, list(toxicity.PRIOR))
    if learned:
        read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
        model = toxicity.train(read("documents"), read("labels"))
    benign = ["trash can", "The trash is on the street", "clown fish live in the reef", "dumb terminal of the 1970s", "The bastard operator", "They put the trash out. The trash was gone.", "He is not an idiot", "garbage collection of the system", "take out your trash"]
    toxic = ["I will kill you", "I will kill you and murder them. We will hurt you.", "You are an idiot", "you stupid idiot", "they are all such vermin", "Du bist ein Idiot", "tú eres un idiota"]
    docs = spark.createDataFrame([(t,) for t in benign + toxic], "text string")
    got = {r["text"]: r["score"] for r in toxicity.toxicity(docs, model).collect()}
    assert {t for t, x in got.items() if x >= toxicity.TOXIC} == set(toxic)


def test_composed_grammar_is_the_product_of_its_paths():
    """Clauses of few symbols, against all combinations of paths through the five transducers."""
    import random
    from itertools import product

    def paths(t, symbols):
        """Outputs of every path of one transducer that ends well."""
        for state in t.starts:
            said = []
            for s in symbols:
                if (arc := t.arcs.get((state, s))) is None:
                    break
                state, output = arc
                said.append(output)
            else:
                if state in t.ends:
                    yield said

    table, rng = toxicity.compose(), random.Random(3)
    clauses = [list(x) for n in (0, 1, 2, 3) for x in product(range(9), repeat=n)] + [[rng.randrange(9) for _ in range(rng.randrange(4, 14))] for _ in range(2000)]
    for symbols in clauses:
        weights = [rng.choice((0.5, 1.0, 1.5)) for _ in symbols]
        combined = list(product(*(list(paths(t, symbols)) for t in toxicity.GRAMMAR.values())))
        assert len(combined) == 1  # the grammar is unambiguous
        want = []
        for i, (s, w) in enumerate(zip(symbols, weights)):
            if found := toxicity.event(s, {name: said[i] for name, said in zip(toxicity.GRAMMAR, combined[0])}):
                want.append((i, found[0], pytest.approx(found[1] * w)))
        assert table.clause(symbols, weights) == want


def test_toxicity_labels(docs, labels):
    """A document labelled more than once counts once, as toxic; null labels and ids teach nothing."""
    got = {(r["text"], r["toxic"]) for r in toxicity.training_rows(docs, labels).collect()}
    assert all(t is not None for _, t in got)
    assert toxicity.train(docs.limit(0), labels).weights == list(toxicity.PRIOR)


def test_contamination(spark):
    words = [f"w{i}" for i in range(20)]
    item = " ".join(words)
    table = spark.createDataFrame([(1, f"Start. {' '.join(words[3:16]).upper()}, end"), (2, " ".join(words[:12])), (3, f"{item} {item}"), (4, "short  ITEM"), (5, "short"), (6, None), (7, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (9, "Short item!"), (8, None), (7, "...")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.contamination(table, items).collect()}
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) for i in range(1, 8)] == [(15, 13, ["10"]), (12, 0, []), (40, 40, ["10"]), (2, 2, ["9"]), (1, 0, []), (0, 0, []), (1, 0, [])]
    (span,) = got[1]["spans"]
    assert table.filter("doc_id = 1").first()["text"][span["start"] : span["end"]] == " ".join(words[3:16]).upper()


def test_contamination_by_blocks(spark, monkeypatch):
    """A benchmark of many blocks gives what one block gives."""
    table = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(3 * i, 3 * i + 15))) for i in range(20)], "item_id long, text string")
    whole = sorted(decontamination.contamination(table, items).collect())
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 50)
    assert sorted(decontamination.contamination(table, items).collect()) == whole


def test_simhash_edges(docs):
    got = simhash.near_duplicates(docs).collect()
    zero = [r for r in got if r["fp"] == 0]
    assert len(zero) == 3 and {r["component_id"] for r in zero} == {0}
    same = [r for r in got if r["component_id"] == 4]
    assert sorted(str(r["doc_id"]) for r in same) == ["4", "4", "4", "None"]  # the null id's text is a copy of 4's


def test_tiles_miss_no_link(spark):
    """Random and chained fingerprints, in blocks so small that tiles are cut, against all pairs."""
    import numpy as np

    from citelake.llm.components import components

    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(-(2**63), 2**63, 150)]
    for v in list(values):
        for _ in range(3):
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                v ^= -(2**63) if b == 63 else 1 << int(b)
            values.append(v)
    values = sorted(set(values) | {0, -1, 1, 3, -2, -(2**63)})
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    u = [v & (1 << 64) - 1 for v in values]
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for j in range(i):
            if (a ^ u[j]).bit_count() <= 2:
                x, y = sorted((find(values[i]), find(values[j])))
                root[y] = x
    expected = {v: find(v) for v in values if find(v) != v}
    for block in (5, simhash.BLOCK):
        assert dict(map(tuple, components(simhash.links(distinct, 2, block)).collect())) == expected
    assert len(expected) > 200


def test_components_of_chains(spark):
    from citelake.llm.components import components

    chain = [(i, i + 1) for i in range(60)] + [(200 + i, 200) for i in range(1, 40)] + [(5, 5), (9, 8)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 61)} | {200 + i: 200 for i in range(1, 40)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_drop_near_duplicates(spark, docs):
    words = [f"word{i}" for i in range(100)]
    near = [*words[:50], "changed", *words[51:]]
    other = [*words[:50], *(f"other{i}" for i in range(50))]
    data = [(5, " ".join(words)), (2, " ".join(near)), (9, " ".join(words)), (7, " ".join(other)), (8, None), (1, ""), (3, "lone text"), (3, "lone text")]
    table = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(table).collect()) == [1, 2, 3, 7]
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 5  # no words (three rows), the notice (four), and three single ones
    assert near_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_are_exact(spark, monkeypatch):
    """Pairs a little under and over the least similarity, short and long, and groups that share shingles, against all pairs."""
    import random

    rng, texts = random.Random(5), []
    word = lambda: f"w{rng.randrange(10**9)}"

    def pair(shared, own, other):
        """Two texts that share that many shingles, and have that many alone."""
        head = [word() for _ in range(shared + 4)]
        return " ".join([*head, *(word() for _ in range(own))]), " ".join([*head, *(word() for _ in range(other))])

    kinds = [(4, 0, 1), (12, 0, 3), (20, 0, 5), (300, 37, 38), (3, 1, 1), (300, 50, 50), (300, 60, 60), (7, 1, 1), (79, 10, 10), (80, 10, 10), (81, 10, 10)]
    for _ in range(20):
        for kind in kinds:
            texts += pair(*kind)
    base = [word() for _ in range(120)]
    for _ in range(60):  # near copies in a chain, and of one text: many share a shingle, not all are similar
        base[rng.randrange(120)] = word()
        texts.append(" ".join(base))
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(120)] = word()
        texts.append(" ".join(own))
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    expected = {i for i in range(len(texts)) if find(i) == i}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in near_dedup.drop_near_duplicates(table).collect()} == expected
    monkeypatch.setattr(near_dedup, "BLOCK", 2_000)  # open clusters in many blocks
    monkeypatch.setattr(near_dedup, "PART", 5)
    monkeypatch.setattr(near_dedup, "LIST", 8)  # and long lists in many parts
    _, nodes, links = near_dedup.similar_links(table.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), 0.8)
    assert simhash.components_of(nodes.select("node", "first"), links).select("first.doc_id").distinct().count() == len(expected)


def test_languages(spark):
    data = [(i, "der hund und die katze", "de") for i in range(20)] + [(100 + i, "the dog and the cat", "en") for i in range(20)] + [(200, None, "en"), (201, "123 !", "de"), (202, "und der hunde", None), (None, "the cats", "en"), (203, "", None)]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify_languages(table).collect()}
    assert [got[i]["lang_pred"] for i in (0, 100, 200, 201, 202, None, 203)] == ["de", "en", "und", "und", "de", "en", "und"]
    assert got[200]["score"] == 0 and got[None]["held_out"] is None
    assert {r["lang_pred"] for r in language_id.identify_languages(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_languages(rows):
    """Predictions and scores worked out with dictionaries: (lang, score) of each row of (doc_id, text, lang)."""
    import math
    from collections import Counter
    from zlib import crc32

    import regex

    words = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    train = [(t, lang) for i, t, lang in rows if i is not None and lang is not None and crc32(str(i).encode()) % 5]
    langs = sorted({lang for _, lang in train})
    counts = [Counter(w for t, x in train if x == lang for w in words(t)) for lang in langs]
    known = set().union(*counts)
    held = [Counter(w[i : i + k] for w in (f"^{w}$" for w in c) for k in range(1, 5) for i in range(len(w) - k + 1)) for c in counts]
    sizes = Counter(len(g) for g in set().union(*held))
    totals = [Counter() for _ in langs]
    for t, h in zip(totals, held):
        for g, n in h.items():
            t[len(g)] += n

    def one(w):
        if w in known:
            logs = [math.log((c[w] + 0.5) / (sum(c.values()) + 0.5 * (len(known) + 1))) for c in counts]
        else:
            w, found = f"^{w}$", []
            for i in range(len(w)):
                g = next((w[i : i + k] for k in range(4, 0, -1) if i + k <= len(w) and any(h[w[i : i + k]] for h in held)), None)
                if g:
                    found.append([round(1000 * math.log((h[g] + 0.5) / (t[len(g)] + 0.5 * (sizes[len(g)] + 1)))) for h, t in zip(held, totals)])
            logs = [sum(f[i] for f in found) / max(1, len(found)) / 1000 for i in range(len(langs))]
        return [round(1000 * (max(logs) - x)) for x in logs]

    out = []
    for _, t, _ in rows:
        own = words(t)
        if not own or not langs:
            out.append(("und", 0.0))
            continue
        losses = [sum(x) for x in zip(*map(one, own))]
        out.append((langs[losses.index(min(losses))], 1 / sum(math.exp((min(losses) - x) / (1000 * len(own))) for x in losses)))
    return out


@pytest.mark.parametrize("head", [0, 5, 65_536])
def test_languages_are_what_plain_counts_give(spark, head):
    """Known, unseen and odd words, and ties, whatever is broadcast. N-grams held by equally many words of two languages, which no training row tells apart, count alike."""
    import random

    rng = random.Random(2)
    alphabets = {"de": "abcdeß", "en": "abcdefg", "fr": "aceghé"}
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randrange(1, 9)))
    rows = [(i, " ".join(word(alphabets[x]) for _ in range(rng.randrange(1, 30))), x) for i, x in enumerate(rng.choices([*alphabets], k=120))]
    rows += [(500, "same", "de"), (501, "same", "en"), (502, "same", None), (503, "zzz 漢字 " + "x" * 300, None), (504, None, "fr"), (505, "12 !", "fr"), (None, "abc abd", "fr"), (506, "same ample", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("term", F.lit("x")).repartition(3)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_languages(table, head=head).collect()}
    for (i, *_), (lang, score) in zip(rows, plain_languages(rows)):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=2e-3), i
