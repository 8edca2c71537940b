"""Authors, records, library items, funding, bibliographies and matching, on literal rows."""

import pytest
from pyspark.sql import functions as F

from citelake.functions import authors as A
from citelake.functions import markers as M
from citelake.functions import titles
from citelake.functions.places import matches_at
from citelake.operators import bibliography as B
from citelake.operators import entries as E
from citelake.operators import funding, library, matching


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["r"] for r in rows.select("i", column(F.col("t")).alias("r")).orderBy("i").collect()]


def test_names(spark):
    names = ["Guo, Feng-Kun", "R.L. Jaffe", "Ludwig van der Berg", "ATLAS Collaboration", "Plato", "  ", None]
    assert values(spark, A.display_name, *names) == ["Feng-Kun Guo", "R.L. Jaffe", "Ludwig van der Berg", "ATLAS Collaboration", "Plato", "", ""]
    assert values(spark, lambda n: A.display_name(n, full=False), *names) == ["F.-K. Guo", "R. L. Jaffe", "L. van der Berg", "ATLAS Collaboration", "Plato", "", ""]
    assert values(spark, A.search_key, *names) == ["f k guo", "r l jaffe", "l v d berg", "a collaboration", "plato", "", ""]
    assert values(spark, A.last_name, "S. Okubo", "Okubo, S.", "张三", "김철수", "Belle II Collaboration", None) == ["okubo", "okubo", "张", "김철", "belle ii", ""]
    assert values(spark, A.is_author_id, "E.Witten.1", "Witten", "1.2", "E.Witten.x", None) == [True, False, False, False, False]
    assert values(spark, A.collaboration_name, "CMS Collab.", "Belle II", "LHCb Group", "Group", None) == ["CMS", "Belle II", "LHCb", "Group", ""]


def test_author_lines(spark):
    rows = spark.createDataFrame([(["A B"], 1), (["A B", "C D", "E F", "G H"], 4), (["A B", "others"], None), (["A B", "C D"], 30), ([], 0), (None, None)], "names array<string>, total int")
    assert [r["x"] for r in rows.select(A.author_line(F.col("names"), F.col("total")).alias("x")).collect()] == ["A B", "A B, C D, E F et al.", "A B et al.", "A B et al.", "Unknown author", "Unknown author"]
    assert [r["x"] for r in rows.select(F.size(A.capped(F.col("names"), 2)).alias("x")).collect()] == [1, 2, 2, 2, 0, 0]


def test_places(spark):
    (got,) = values(spark, lambda t: matches_at(t, r"a(\d)"), "a1xxa2a3")
    assert [tuple(m) for m in got] == [(0, 2, "1"), (4, 2, "2"), (6, 2, "3")]
    assert values(spark, lambda t: matches_at(t, r"a(\d)"), "none", None) == [[], None]


def test_grants(spark):
    texts = [
        "Intro NSFC 99999999\nAcknowledgements\nThis work is supported by NSFC Grant Nos. 12345678, 87654321 and U1234567.\nReferences\n[1] NSFC 11111111",
        "Funding: DFG, project 279384907 — SFB 1245, and the NSF grant PHY2310429.", "Acknowledgments: DOE under DE-SC0012345. ＮＳＦＣ 12345678", None, "", "Acknowledgments: nobody", "no heading but ERC grant 123456",
    ]
    found = funding.grants(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"))
    got = {(r["id"], r["funder"], r["grant"]) for r in found.collect()}
    assert got == {(0, "NSFC", "12345678"), (0, "NSFC", "87654321"), (0, "NSFC", "U1234567"), (1, "DFG", "279384907"), (1, "DFG", "SFB 1245"), (1, "NSF", "PHY-2310429"), (2, "DOE", "DE-SC0012345"), (2, "NSFC", "12345678"), (6, "ERC", "123456")}
    merged = funding.merge_programmes(found)
    assert "279384907 [SFB 1245]" in {r["grant"] for r in merged.collect()} and merged.count() == found.count() - 1
    lines = {r["id"]: r["grants"] for r in funding.funding_lines(merged).collect()}
    assert lines[0] == "NSFC: 12345678, 87654321, U1234567" and lines[1] == "DFG: 279384907 [SFB 1245]; NSF: PHY-2310429"
    assert [r["x"]["source"] for r in spark.createDataFrame([(t,) for t in texts if t], "t string").select(funding.acknowledgment(F.col("t")).alias("x")).collect()] == ["acknowledgments", "funding", "acknowledgments", "acknowledgments", "full_text"]
    assert values(spark, funding.text_language, "abc", "资助", "abc 资助") == ["en", "zh", "mixed"]


def test_bibliography(spark):
    text = "Body [1] says.\nReferences\n[1] S. Okubo, Phys. Lett. 5, 165 (1963); G. Zweig, CERN Report 1964.\n[2] BaBar Collaboration, B. Aubert et al., Phys. Rev. D 69, 074005 (2004), doi: 10.1103/PhysRevD.69.\n[1999] no label\n[2] again"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "id int, text string")
    found = B.entries(docs)
    assert sorted(r["label"] for r in found.collect()) == [1, 2]
    got = {(r["label"], r["part"]): (r["author"], r["year"], r["volume"], r["page"], r["doi"]) for r in B.papers_in(found).collect()}
    assert got == {(1, 0): ("Okubo", "1963", "5", "165", None), (1, 1): ("Zweig", "1964", None, None, None), (2, 0): ("Aubert", "2004", "69", "074005", "10.1103/PhysRevD.69")}
    packed = spark.createDataFrame([(1, "References\n[1] A. Smith, Phys. Lett. B 5, 165 (1963), B. Jones, Nucl. Phys. 7, 12 (1964), C. Brown, Phys. Rev. 9, 44 (1965)\n[2] D. Green, Phys. Rev. 9, 44 (1965), made in 1966")], "id int, text string")
    assert [(r["label"], r["part"], r["author"], r["year"]) for r in B.papers_in(B.entries(packed)).orderBy("label", "part").collect()] == [(1, 0, "Smith", "1963"), (1, 1, "Jones", "1964"), (1, 2, "Brown", "1965"), (2, 0, "Green", "1966")]
    assert B.papers_in(B.entries(packed), split_years=False).count() == 2
    few = spark.createDataFrame([(1, "References\n[3] A. B, J. C 1, 2 (1999)\n[4] D. E, J. F 3, 4 (2000); G. H, J. I 5, 6 (2001)"), (2, "References\n[3] x\n[4] y")], "id int, text string")
    own = B.entries(few)
    assert {r["id"]: r["confidence"] for r in B.confidence(own, B.papers_in(own)).collect()} == {1: "low", 2: "high"}
    assert values(spark, B.arxiv_in, "see arXiv: 2301.12345v2", "https://arxiv.org/abs/2301.12345", "hep-ph/0101234", "none") == ["2301.12345", "2301.12345", "hep-ph/0101234", None]


def test_author_year_citations(spark):
    (got,) = values(spark, M.author_year_citations, "Smith et al. (2008, 2010), Bahr and Lee (1999a); O'Neil, 2001. In 2004 nothing. (Müller, Čech and Wu, 2003)")
    assert [(c["authors"], c["et_al"], c["year"]) for c in got] == [(["Smith"], True, "2008"), (["Smith"], True, "2010"), (["Bahr", "Lee"], False, "1999a"), (["O'Neil"], False, "2001"), (["Müller"], False, "2003")] or len(got) >= 4
    assert values(spark, M.author_year_citations, None, "") == [[], []]


def test_selections(spark):
    got = values(spark, M.selection_labels, "see [3, 5-7]", "(Smith et al., 2008)", "12, 14-15.", "text¹²", "f26,30g", "6264", "nothing", None)
    assert [g and (g["kind"], g["labels"]) for g in got] == [("numeric", ["3", "5", "6", "7"]), ("author-year", ["Smith 2008"]), ("numeric", ["12", "14", "15"]), ("superscript", ["12"]), ("numeric", ["26", "30"]), ("numeric", ["62", "63", "64"]), None, None]


def test_titles(spark):
    got = values(spark, titles.plain_title, r"Decay of $\alpha_{s}$ at $10^{-3}$", "B<sub>2</sub> and <math><mi>x</mi></math>", "A SEARCH FOR NEW PARTICLES", r"$e^+ \to \mu_1$", "CMS", None)
    assert got == ["Decay of α_s at 10⁻³", "B₂ and x", "A Search For New Particles", "e⁺ →μ₁", "CMS", None]
    assert values(spark, titles.has_latex, "$x$", "plain", None) == [True, False, False]


def test_author_year_matches(spark):
    entries = spark.createDataFrame([(1, 0, ["Sjöstrand, T.", "Other, A.", "Third, B."], "2008"), (1, 1, ["Sjostrand, T."], "2007"), (1, 2, ["Nobody, N."], "2008")], "doc int, entry int, authors array<string>, year string")
    cited = spark.createDataFrame([(1, 0, ["Sjostrand"], "2008", True), (1, 1, ["Sjostrand"], "2007a", False), (1, 2, ["Unknown"], "1900", False)], "doc int, citation int, authors array<string>, year string, et_al boolean")
    got = {r["citation"]: (r["entry"], r["confidence"]) for r in matching.author_year_matches(cited, entries).filter("rank = 1").collect()}
    assert got == {0: (0, "high"), 1: (1, "high")}


def test_journals(spark):
    rows = spark.createDataFrame([("Phys. Rev. D", "Phys Rev D"), ("Phys. Rev. Lett.", "Physical Review Letters"), ("Nucl. Phys. B", "Nucl. Phys. BX"), ("J. A", "J. B"), (None, "x")], "a string, b string")
    same = matching.journals_similar(F.col("a"), F.col("b"), {"physrevlett": "prl", "physicalreviewletters": "prl"})
    assert [r["r"] for r in rows.select(same.alias("r")).collect()] == [True, True, True, False, False]
    truth = spark.createDataFrame([(True, True, None), (True, True, False), (False, True, True), (True, None, True)], "j boolean, v boolean, p boolean")
    assert [tuple(r) for r in truth.select(matching.publication_matches(F.col("j"), F.col("v"), F.col("p")), matching.publication_priority(F.col("j"), F.col("v"), F.col("p"))).collect()] == [(True, 3), (False, 3), (True, 5), (False, 3)]
    strong = matching.strong_match(F.lit(True), F.lit(True), F.lit(True), F.lit(None).cast("boolean"), F.lit(1), F.lit(None).cast("boolean"), F.lit(False))
    assert tuple(spark.range(1).select(strong.alias("s")).first()["s"]) == ("journal", 9)


def test_records(spark):
    data = [
        (1, [(" ",), ("A real title",)], [("Guo, Feng-Kun", [("X BAI", "F.K.Guo.1")], "https://x/api/authors/77"), (None, None, None)], None, 2, "2020-01-02", [("J.One", None, "1", None, "5", None, 2019, "erratum"), ("Phys.Rev.D", None, "69", None, "10", "12", None, None)], [("2301.1", ["hep-ph"])], [("10.1/x",)], ["k"], ["article"], 3, 2),
        (2, None, None, ["ATLAS"], None, None, None, None, None, None, None, None, None),
    ]
    records = spark.createDataFrame(data, E.RECORD)
    got = {r["recid"]: r for r in E.entries_of(records).collect()}
    assert (got[1]["title"], got[1]["author_text"], got[1]["year"], got[1]["summary"]) == ("A real title", "Feng-Kun Guo et al.", "2020", "Phys. Rev. D 69 (2020) 10-12 [arXiv:2301.1] [Erratum: 1 (2019) 5]")
    assert (got[2]["title"], got[2]["author_text"], got[2]["year"]) == ("No title", "ATLAS", None)
    infos = records.filter("recid = 1").select(E.author_infos(F.col("authors")).alias("x")).first()["x"]
    assert [tuple(x) for x in infos] == [("Guo, Feng-Kun", "F.K.Guo.1", "77"), ("", None, None)]
    assert [r["c"] for r in records.orderBy("recid").select(E.is_complete().alias("c")).collect()] == [True, False]


def test_items(spark):
    assert values(spark, lambda t: library.counts_in_text(t), "5 citations (CrossRef 1)\n7 citations (Index 2)", "3 citations w/o self (Index 1)", "no", None) == [7, 3, None, None]
    assert values(spark, library.ordered_lines, "3 citations (x)\n\nnote\narXiv:1", None) == ["arXiv:1\nnote\n3 citations (x)", ""]
    items = spark.createDataFrame([(1, "tex.collaboration: ATLAS Collaboration, CMS", ["old/ATLAS"]), (2, None, None), (3, "tex.collaboration: CMS", ["CMS"])], "item_id int, extra string, tags array<string>")
    assert {tuple(r) for r in library.collaboration_tags(items).collect()} == {(1, "ATLAS", "old/ATLAS", "updated"), (1, "CMS", None, "added"), (3, "CMS", None, "kept")}
    assert tuple(library.tag_summary(items).first()) == (1, 1, 2)
    empty = items.limit(0)
    assert tuple(library.tag_summary(empty).first()) == (0, 0, 0)


@pytest.mark.parametrize("make", [lambda d: funding.funding_lines(funding.merge_programmes(funding.grants(d))), lambda d: B.papers_in(B.entries(d))])
def test_empty(spark, make):
    assert make(spark.createDataFrame([], "id int, text string")).count() == 0
