"""The pipeline's stages, and the whole of it, on small tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage takes and gives, written and read as the run does."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (name, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, DATA).write.parquet(path)
        got = spark.read.parquet(path)
        out.append((name, docs, got))
        docs = got
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_columns(spark, stages):
    whole = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert all(got.columns == whole for _, _, got in stages[:-1])
    assert P.ORACLE_SQL is None and [n for n, *_ in stages] == [n for n, _ in P.STAGES]


def test_toxicity_stage(spark, stages):
    _, before, after = stages[0]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    gone = set(texts(before)) - set(texts(after))
    known = [d for d in gone if d in labels]
    assert gone and sum(labels[d] for d in known) >= 0.9 * len(known)
    assert sum(t for d, t in labels.items() if d in gone) >= 0.5 * sum(labels.values())


def test_line_stage(stages):
    """Against a count of lines without Spark."""
    from citelake.llm.line_dedup import MIN_PAGES, RATIO

    _, before, after = stages[1]
    rows = before.collect()
    pages, on = {}, {}
    for r in rows:
        if r["text"] is not None:
            pages.setdefault(r["source"], set()).add(r["text"])
    for source, own in pages.items():
        for t in own:
            for line in {x.strip(" ") for x in t.split("\n")} - {""}:
                on[source, line] = on.get((source, line), 0) + 1
    bad = {k for k, n in on.items() if n >= MIN_PAGES and n >= RATIO * len(pages[k[0]])}
    want = {r["doc_id"]: r["text"] and "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(" ")) not in bad) for r in rows}
    assert texts(after) == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in after.collect())


def test_copies_stage(stages):
    _, before, after = stages[2]
    rows, kept = texts(before), texts(after)
    sets = {d: _shingles(t) for d, t in rows.items()}
    alike = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    order = sorted(kept)
    assert not [(a, b) for i, a in enumerate(order) for b in order[:i] if alike(a, b)]
    gone = set(rows) - set(kept)
    assert gone and all(any(len(sets[d] & sets[k]) >= 0.5 * len(sets[d] | sets[k]) or sets[d] == sets[k] for k in rows if k != d) for d in gone)


def _shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_contamination_stage(spark, stages):
    from citelake.llm.decontamination import words

    _, before, after = stages[3]
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        own = words(r["text"])
        windows |= {tuple(own[i : i + 13]) for i in range(max(1, len(own) - 12))} if own else set()
    lengths = {len(w) for w in windows}

    def bad(text):
        own, hit = words(text), set()
        for n in lengths:
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        return hit and 20 * len(hit) >= len(own)

    assert set(texts(after)) == {d for d, t in texts(before).items() if not bad(t)}


def test_encoding_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    _, before, after = stages[4]
    want = {d: own.encode(t or "", add_special_tokens=False).ids for d, t in texts(before).items()}
    assert {r["doc_id"]: r["ids"] for r in after.collect()} == want


def test_run(spark, stages):
    got = P.run(spark, DATA)
    assert got.count() == stages[-1][2].count()


def test_awkward_documents(spark):
    """Nulls everywhere, repeated rows, a further column, and no rows at all."""
    data = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "you idiot " * 5, None, None, 50), (3, None, "de", "s", None), (4, "x\n" * 3000, "fr", "s", 6000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1))
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns
        got.collect()
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert P.STAGES[-1][1](spark, docs, DATA).count() == len(data)


def test_copies_stage_goes_by_fingerprints(spark):
    """Two texts of one fingerprint whose sets of shingles are no more than two thirds alike: one stays, and their copies and a third text's are settled with them."""
    from citelake.llm.simhash import RADIUS, fingerprint

    shared = "alpha beta gamma " * 200 + " ".join(f"word{i}" for i in range(40))
    a, b = (f"{shared} {' '.join(f'{x}{i}' for i in range(8))}" for x in "pq")
    c = " ".join(f"other{i}" for i in range(200))
    assert (fingerprint(a) ^ fingerprint(b)).bit_count() <= RADIUS < (fingerprint(a) ^ fingerprint(c)).bit_count()
    sets = [_shingles(x) for x in (a, b)]
    assert len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    docs = spark.createDataFrame([(5, a), (4, b), (7, b), (9, c), (8, c), (3, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in P.drop_copies(spark, docs, DATA).collect()) == [3, 4, 8]
