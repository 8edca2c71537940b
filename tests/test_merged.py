"""Metadata written to items, and tables that updates are merged into bucket by bucket."""

import random
import re

from pyspark.sql import functions as F

from citelake.operators import metadata as M
from citelake.sources import merged

ITEM = "item_id int, " + ", ".join(f"{c} string" for c in M.ITEM_FIELDS)
META = "item_id int, " + ", ".join(f"{c} string" for c in M.META_FIELDS)


def plain(item, meta):
    """Field after field, by the rules; both dicts."""
    out = {k: v or None for k, v in item.items()}
    m, kind, book = {k: v or None for k, v in meta.items()}, item["item_type"], meta["document_type"] == "book"
    arxiv_shown = "arxiv" in (item["journal"] or "").lower()
    if m["journal_abbreviation"]:
        if kind == "journalArticle":
            out["journal_abbreviation"] = m["journal_abbreviation"]
            if not item["journal"] or arxiv_shown:
                out["journal"] = m["journal_abbreviation"]
        elif book and kind == "book":
            out["series"] = m["journal_abbreviation"]
        else:
            out["journal"] = m["journal_abbreviation"]
    elif m["arxiv"] and arxiv_shown:
        out["journal"] = None
    if m["volume"]:
        out["series_number" if book else "volume"] = m["volume"]
    if m["pages"] and not book:
        out["pages"] = m["pages"]
    for c in ("title", "abstract", "date", "issue"):
        out[c] = m[c] or out[c]
    if m["doi"]:
        if kind in ("journalArticle", "preprint"):
            out["doi"] = m["doi"]
        else:
            out["url"] = M.DOI_ADDRESS + m["doi"]
    out["isbn"] = out["isbn"] or m["isbn"]
    if kind in ("book", "bookSection"):
        out["publisher"] = out["publisher"] or m["publisher"]
    if m["arxiv"]:
        line = f"arXiv:{m['arxiv']}" + (f" [{m['category']}]" if re.match(r"\d", m["arxiv"]) and m["category"] else "")
        kept = [x for x in (item["extra"] or "").split("\n") if not re.search("arXiv:|_eprint:", x, re.I) and "type: article" not in x]
        body = re.sub("\n$", "", "\n".join(kept))
        out["extra"] = f"{body}\n{line}" if "\n".join(kept) else line
        out["url"] = out["url"] or m["arxiv_url"]
    elif m["arxiv_url"]:
        out["url"] = out["url"] or m["arxiv_url"]
    return out


def test_metadata_by_the_rules(spark):
    rng = random.Random(9)
    pick = lambda *x: rng.choice([None, "", *x])
    items, metas = [], []
    for i in range(400):
        items.append([i, rng.choice(["journalArticle", "preprint", "book", "bookSection"]), pick("T"), pick("A"), pick("arXiv:2301.1 [x]", "Phys. Rev.", "ArXiv e-prints"), pick("J"), pick("S"), pick("3"), pick("7"), pick("1"), pick("1-2"), pick("2001"), pick("10.1/x"), pick("978"), pick("P"), pick("http://u"), pick("note", "note\narXiv:1\nmore", "a\n_eprint: x\n", "type: article\nz")])
        metas.append([i, rng.choice(["article", "book"]), pick("T2"), pick("A2"), pick("J2"), pick("8"), pick("2"), pick("3-4"), pick("2002"), pick("10.1/y"), pick("979"), pick("P2"), pick("2301.12345", "hep-th/1"), pick("hep-ph"), pick("http://arxiv")])
    a, b = spark.createDataFrame(items, ITEM), spark.createDataFrame(metas[:350], META)
    got = {r["item_id"]: r.asDict() for r in M.with_metadata(a, b).collect()}
    names, meta_names = ["item_id", *M.ITEM_FIELDS], ["item_id", *M.META_FIELDS]
    for i in range(350):
        want = plain(dict(zip(names, items[i])), dict(zip(meta_names, metas[i])))
        assert {k: v or None for k, v in got[i].items()} == want, (items[i], metas[i])
    assert all(tuple(got[i][c] for c in names) == tuple(items[i]) for i in range(350, 400))
    some = {r["item_id"]: r.asDict() for r in M.with_metadata(a, b, ["title"]).collect()}
    assert all(some[i]["doi"] == items[i][12] and some[i]["title"] == (metas[i][2] or items[i][2] or None) for i in range(350))


def folders(spark, path):
    return merged.manifest(spark, path)["folders"]


def test_merge_writes_only_what_changes(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"), F.lit(0).cast("long").alias("n"))
    merged.create(rows, path, "k", buckets=16)
    before = folders(spark, path)
    updates = spark.createDataFrame([(5, "new"), (6, "v6"), (1000, "added"), (None, "x")], "k long, v string")
    assert merged.merge(updates, path) in (1, 2)
    after = folders(spark, path)
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and all(after[b] == before[b] for b in before if b not in changed)
    assert merged.merge(updates, path) == 0 and folders(spark, path) == after  # a second run changes no file
    got = {r["k"]: (r["v"], r["n"]) for r in merged.read(spark, path).collect()}
    assert len(got) == 201 and got[5] == ("new", 0) and got[6] == ("v6", 0) and got[1000] == ("added", None)
    assert merged.merge(spark.createDataFrame([(2000, "no")], "k long, v string"), path, insert=False) == 0
    counted = {"n": F.coalesce(F.col("old.n"), F.lit(0)) + F.lit(1)}
    assert merged.merge(updates.filter("k = 5"), path, counted) == 1
    assert merged.read(spark, path).filter("k = 5").first()["n"] == 1
    kept = merged.read(spark, path).count()
    assert merged.vacuum(spark, path) >= 2 and merged.read(spark, path).count() == kept
    assert merged.merge(updates.filter("false"), path) == 0


def test_metadata_merged_into_a_table(spark, tmp_path):
    path = f"{tmp_path}/items"
    item = (1, "journalArticle", "T", *[None] * (len(M.ITEM_FIELDS) - 2))
    merged.create(spark.createDataFrame([item, (2, *item[1:])], ITEM), path, "item_id", buckets=4)
    meta = spark.createDataFrame([(1, "article", "New", None, "J", "5", None, "7", "2002", "10.1/x", None, None, "2301.12345", "hep-ph", None)], META)
    assert merged.merge(meta, path, M.metadata_columns(), insert=False) == 1
    assert merged.merge(meta, path, M.metadata_columns(), insert=False) == 0
    got = {r["item_id"]: r for r in merged.read(spark, path).collect()}
    assert got[1]["title"] == "New" and got[1]["extra"] == "arXiv:2301.12345 [hep-ph]" and got[2]["title"] == "T"
