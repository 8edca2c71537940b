"""What texts cite: the grammar of author-year citations, markers of all forms, loose labels."""

import random

import pytest

from citelake.functions import citing as G
from citelake.operators import citing as C

CASES = [
    ("(Sjostrand, 2008)", ["Sjostrand 2008"]), ("(Sjostrand, Mrenna, and Skands, 2008)", ["Sjostrand et al. 2008"]), ("(Bahr et al., 2008)", ["Bahr et al. 2008"]), ("(Weinstein and Isgur, 1982)", ["Weinstein and Isgur 1982"]),
    ("Albaladejo, Guo et al. (2017)", ["Albaladejo et al. 2017"]), ("Artoisenet and Braaten (2010)", ["Artoisenet and Braaten 2010"]), ("Zweig (1964) and then Okubo (1963)", ["Zweig 1964", "Okubo 1963"]), ("2008", []), ("Section (2017)", []), ("Figure (2), Equation (35)", []),
    ("HERWIG (Bahr et al., 2008)", ["Bahr et al. 2008"]), ("symmetry Adler and Dashen, 1968 .", ["Adler and Dashen 1968"]), ("Abarbanel and Goldberger 1968 and Heimann 1973 .", ["Abarbanel and Goldberger 1968", "Heimann 1973"]),
    ("Bjorken 1966, 1970; Ellis-Jaffe 1974", ["Bjorken 1966", "Bjorken 1970", "Ellis-Jaffe 1974"]), ("García-Márquez (2020)", ["García-Márquez 2020"]), ("O'Brien (2015)", ["O'Brien 2015"]), ("Guo and Meißner (2011)", ["Guo and Meißner 2011"]),
    ("(Cho et al., 2011a, 2011b; Cho, Song, and Lee, 2015)", ["Cho et al. 2011a", "Cho et al. 2011b", "Cho et al. 2015"]), ("Bignamini et al. (2009, 2010)", ["Bignamini et al. 2009", "Bignamini et al. 2010"]),
    ("(Smith et al. (2001); Jones, 2002)", ["Smith et al. 2001", "Jones 2002"]), ("((Smith, 2001))", ["Smith 2001"]), ("As shown by (Cho et al., 2011a", ["Cho et al. 2011a"]), ("Cho et al., 2011a, says (nothing)", ["Cho et al. 2011a"]), ("Hiller Blin et al. 2016", ["Hiller Blin et al. 2016"]),
    ("(van der Berg and de la Cruz, 1999)", ["van der Berg and de la Cruz 1999"]), ("(N = 2000; Wu, 1999)", []), ("M.-T. Li et al., 2013 and G. Li, 2013", ["Li et al. 2013", "Li 2013"]), ("(see Smith, 2001)", []), ("", []), (None, []), (")(", []), ("(((", []),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_grammar(text, expected):
    assert [c.label() for c in G.citations(text)] == expected


def test_labels_hold_names_initials_and_years():
    found = G.citations("(M.-T. Li, G. Wu, and Guo, 2013a)")
    assert G.labels(found) == ["Li et al. 2013a", "Li", "Wu", "Guo", "M.-T. Li", "G. Wu", "2013a", "Li, Wu, Guo"]


def test_sentences_put_together():
    """Citations of random forms between words: all come back, in order, however they are nested."""
    rng = random.Random(2)
    name = lambda: rng.choice("ABCDEFG") + "".join(rng.choice("aeioulnr") for _ in range(5))
    for _ in range(400):
        parts, expected = [], []
        for _ in range(rng.randint(1, 5)):
            a, b, y, z = name(), name(), str(rng.randint(1950, 1999)), str(rng.randint(2000, 2020))
            form, labels = rng.choice([
                (f"{a} et al. ({y}, {z})", [f"{a} et al. {y}", f"{a} et al. {z}"]), (f"{a} and {b} ({y})", [f"{a} and {b} {y}"]), (f"({a}, {y}; {b} et al., {z})", [f"{a} {y}", f"{b} et al. {z}"]),
                (f"{a} ({y})", [f"{a} {y}"]), (f"({a} ({y}); {b} and {a}, {z}c)", [f"{a} {y}", f"{b} and {a} {z}c"]), (f"(no {z} by name; {a}, {y})", [f"{a} {y}"]),
            ])
            parts.append(form)
            expected += labels
        text = " ".join(f"{rng.choice(['as', 'in 1999 by', 'we follow', 'x,'])} {p}." for p in parts)
        assert [c.label() for c in G.citations(text)] == expected, text


def test_rows(spark):
    docs = spark.createDataFrame([(1, "(Wu, 1999) [3] a¹·² [1,4-6] [3]"), (1, None), (None, "x (Li et al., 2001)"), (2, "")], "id int, text string")
    assert sorted((str(r["id"]), r["place"], r["label"]) for r in C.citations_in(docs).collect()) == [("1", 0, "Wu 1999"), ("None", 0, "Li et al. 2001")]
    assert [(r["id"], r["place"], r["raw"], r["labels"]) for r in C.markers_in(docs).orderBy("place").collect()] == [(1, 0, "[3]", ["3"]), (1, 1, "[1,4-6]", ["1", "4", "5", "6"]), (1, 2, "¹·²", ["1", "2"])]
    assert C.citations_in(docs.filter("false")).collect() == [] and C.markers_in(docs.filter("false")).collect() == []


def test_selections(spark):
    cases = {
        "f26,30g": ["26", "30"], "as [7] and [9]": ["7", "9"], "(Smith et al., 2008)": ["Smith 2008"], "12-14.": ["12", "13", "14"], "factors72 of terms84,86": ["72", "84", "86"], "Ref. 15 and suppressed 20 in Fig. 3": ["15", "20"], "Table 4": None,
        "Eq. (35)": None, "x = 5": None, "t. Bali 19 rep": ["19"], "1267 53 candidates": None, "In Section 2 Godfrey 17": ["17"], "": None,
    }
    docs = spark.createDataFrame(list(enumerate([*cases, None])), "id int, text string")
    got = {r["id"]: r["labels"] for r in C.selections(docs, lenient=True).collect()}
    assert got == {i: x for i, x in enumerate(cases.values()) if x}
    assert len(C.selections(docs).collect()) == 5
