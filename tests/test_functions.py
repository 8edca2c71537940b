"""Column functions on literal values."""

import pytest
from pyspark.sql import functions as F

from citelake.functions import identifiers as I
from citelake.functions import markers as M
from citelake.functions import papers as P
from citelake.functions import text as T


def one(spark, column, **values):
    types = {"cites": "long", "a": "long", "b": "long", "c": "long"}
    schema = ", ".join(f"{k} {types.get(k, 'string')}" for k in values) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("text, folded, wide", [("Müller", "muller", "mueller"), ("Grüß Gott", "gruss gott", "gruess gott"), ("Æther", "aether", "aether"), (None, "", ""), ("Ł, Ő and É", "l, o and e", "l, o and e")])
def test_fold(spark, text, folded, wide):
    assert one(spark, T.fold(F.col("t")), t=text) == folded
    assert one(spark, T.expand_umlauts(F.col("t")), t=text) == wide
    assert T.fold_text(text or "") == folded


def test_query_tokens():
    assert T.query_tokens('author "Phys. Rev." 2024') == [("author", False), ("Phys. Rev.", True), ("2024", False)]
    assert T.query_tokens('a "b c') == [("a", False), ("b c", True)]
    assert T.query_tokens("") == [] == T.query_tokens('""  \t')
    assert "physrevd" in T.query_variants("Phys. Rev. D", True)
    assert T.query_variants("prl", False, {"prl": ["Physical Review Letters"]})[-1] == "physical review letters"


@pytest.mark.parametrize("raw, clean", [("<p>A&amp;B</p> –  <br/>&foo; c ", "a&b - c"), ("&amp;lt;", "&lt;"), (None, "")])
def test_note(spark, raw, clean):
    assert one(spark, T.note_text(F.col("t")), t=raw) == clean


@pytest.mark.parametrize("co, a, b, out", [(10, 100, 25, 0.2), (1000, 10, 10, 1.0), (0, 5, 5, 0.0), (1, 0, 5, 0.0), (None, 5, 5, 0.0)])
def test_cosine(spark, co, a, b, out):
    assert one(spark, P.cocitation_cosine(F.col("a"), F.col("b"), F.col("c")), a=co, b=a, c=b) == pytest.approx(out)


def test_blend_and_weight(spark):
    assert one(spark, P.blend_weight(F.col("cites")), cites=4) == 0
    assert one(spark, P.blend_weight(F.col("cites")), cites=30) == pytest.approx(0.25)
    assert 0.45 < one(spark, P.blend_weight(F.col("cites")), cites=50) <= 0.5
    assert one(spark, P.anchor_weight(F.col("cites")), cites=None) == 0.25
    assert one(spark, P.anchor_weight(F.col("cites")), cites=0) == 1.0


def test_anchor_buckets(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([0, 4, 5, 50, 300, 301, 1500, 1501, None])], "i int, c long")
    assert [r["b"] for r in rows.select("i", P.anchor_bucket(F.col("c")).alias("b")).orderBy("i").collect()] == [3, 3, 0, 0, 0, 1, 1, 4, 2]


@pytest.mark.parametrize("date, out", [("2020", 2020.5), ("2020-01", 2020 + 15 / 365), ("2020-03-10", 2020 + (2 * 30.44 + 10) / 365), ("", None), (None, None)])
def test_fractional_year(spark, date, out):
    got = one(spark, P.fractional_year(F.col("t")), t=date)
    assert got is None if out is None else got == pytest.approx(out)


def test_years(spark):
    assert one(spark, P.leading_int(F.col("t")), t="2011a") == 2011
    assert one(spark, P.year_number(F.col("t")), t="2011a") is None
    assert one(spark, P.base_year(F.col("t")), t="2011a") == "2011"


@pytest.mark.parametrize("title, yes", [("Review of Particle Physics", True), ("The REVIEW OF PARTICLE PHYSICS, 2020", True), ("Preview of particle physics", False), (None, False)])
def test_general_review(spark, title, yes):
    assert one(spark, P.is_general_review_title(F.col("t")), t=title) is yes


@pytest.mark.parametrize("journal, yes", [("Rev. Mod. Phys.", True), ("Annu. Rev. Nucl.", True), ("Phys.Rept.", True), ("Phys. Rev. D", False), (None, False)])
def test_review_journal(spark, journal, yes):
    assert one(spark, P.is_review_journal(F.col("t")), t=journal) is yes


@pytest.mark.parametrize("raw, out", [("arXiv:2301.12345", "2301.12345"), ("https://arxiv.org/abs/2301.12345v3", "2301.12345"), ("hep-ph/0001234", "hep-ph/0001234"), ("nothing", None), (None, None)])
def test_arxiv_id(spark, raw, out):
    assert one(spark, I.arxiv_id(F.col("t")), t=raw) == out


@pytest.mark.parametrize("raw, out", [("2301.12345v2", "202301012345"), ("hep-th/9802109", "199802000109"), ("hep-ph/0610008", "200610000008"), ("x12", "00000000012"), ("", ""), (None, "")])
def test_arxiv_sort_key(spark, raw, out):
    assert one(spark, I.arxiv_sort_key(F.col("t")), t=raw) == out


def test_doi(spark):
    assert one(spark, I.doi(F.col("t")), t="10.1/ABC.);") == "10.1/abc"
    assert one(spark, I.doi(F.col("t")), t="") is None


@pytest.mark.parametrize("text, labels", [("see [1,2,5-8]", ["1", "2", "5", "6", "7", "8"]), ("[9-3]", ["9", "3"]), ("[1-200]", ["1", "200"]), ("[4] and [4]", ["4"]), ("none", []), ("[ , ]", [])])
def test_bracket_labels(spark, text, labels):
    assert one(spark, M.bracket_labels(F.col("t")), t=text) == labels


@pytest.mark.parametrize("label, known, out", [("6264", None, ["62", "63", "64"]), ("1968", None, None), ("15", None, None), ("6264", 79, ["62", "63", "64"]), ("123", 50, ["1", *map(str, range(2, 24))]), ("123", None, None), ("9912", None, None)])
def test_lost_range(spark, label, known, out):
    got = one(spark, M.lost_range(F.col("t"), F.col("a")), t=label, a=known)
    assert got == out


def test_markers(spark):
    assert one(spark, M.superscripts(F.col("t")), t="x¹²³ y¹,²") == ["123", "1", "2"]
    assert one(spark, M.repair_brackets(F.col("t")), t="as f26,30g says") == "as [26,30] says"
    assert one(spark, M.has_markers(F.col("t")), t="Smith et al. (2008)") is True
    assert one(spark, M.has_markers(F.col("t")), t=None) is False
