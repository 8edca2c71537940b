"""Citations by author and year in a text, read by a small grammar over its tokens.

    list      author ("," | "and" | "&" | ", and" author)*
    author    initials? particle* name+            (one name outside parentheses)
    cited     list "et al."? ","? "(" years ")"    outside parentheses; a list without et al. has an "and" before its last author, else only that one counts
              list "et al." ","? year              parenthesis lost
              author "and" author "," year         parenthesis lost, before ; , ) or the end
    group     anything (authors) anything years    between semicolons within parentheses, where each part of the list that isn't an author is passed over
    bare      list "et al."? ","? years            in texts that have no year in parentheses

Groups may hold further parentheses; ones that aren't closed close at the end. This is a helper for one text; operators.citing runs it over tables."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

#: Letters of names, and words before or in the place of an author that make it none.
UPPER, LOWER = "A-ZÀ-ÖØ-ÞĐŁŐŰİĞŞ", "a-zà-öø-ÿßđłőűığş"
PARTICLES = ("van", "von", "de", "der", "del", "la", "le")
NO_AUTHORS = frozenset("Section Figure Table Equation Chapter Appendix Part Volume Issue".split())
BEFORE = frozenset("section figure table equation ref ref.".split())
_TOKEN = re.compile(
    rf"(?P<etal>et\s+al\b\.?)|(?P<year>(?<![0-9])(?:1[5-9]|20)[0-9]{{2}}[a-z]?(?![0-9A-Za-z]))|(?P<initials>(?:[{UPPER}]\.(?:\s*-?)?)+(?=\s*[-{UPPER}{LOWER}(]))"
    rf"|(?P<name>[{UPPER}][{UPPER}{LOWER}'’-]+)|(?P<and>(?:and|And|&)(?![{UPPER}{LOWER}]))|(?P<mark>[(),;])|(?P<other>[^\s(),;]+)",
)


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Citation:
    authors: list[str]
    year: str
    et_al: bool
    initials: list[str | None] = field(default_factory=list)
    start: int = 0

    def key(self) -> tuple:
        return self.authors[0], self.year

    def label(self) -> str:
        if self.et_al or len(self.authors) > 2:
            return f"{self.authors[0]} et al. {self.year}"
        return f"{' and '.join(self.authors)} {self.year}"


def tidy(text: str) -> str:
    """Accents that stand apart from their letter are put on it."""
    text = re.sub("([A-Za-z])\\s+([̀-ͯ])\\s*([A-Za-z])", r"\1\3\2", text)
    return unicodedata.normalize("NFC", re.sub("([A-Za-z])\\s+([̀-ͯ])", r"\1\2", text))


def tokens(text: str) -> list[Token]:
    return [Token(m.lastgroup if m.lastgroup != "mark" else m[0], m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.toks = text, tokens(text)
        self.closing, open_ = {}, []
        for i, t in enumerate(self.toks):
            if t.kind == "(":
                open_.append(i)
            elif t.kind == ")" and open_:
                self.closing[open_.pop()] = i
        self.closing |= dict.fromkeys(open_, len(self.toks))  # closed at the end
        self.bare = not any(t.kind == "year" for i, j in self.closing.items() for t in self.toks[i:j])
        self.found: dict[tuple, Citation] = {}

    def kind(self, i: int, k: int = 0) -> str:
        return self.toks[i + k].kind if 0 <= i + k < len(self.toks) else ""

    def add(self, authors: list[tuple[str, str | None]], years: list[str], et_al: bool, start: int) -> None:
        for year in years:
            new = Citation([a for a, _ in authors], year, et_al, [x for _, x in authors], start)
            # Without parentheses, namesakes with other initials are others.
            self.found.setdefault((*new.key(), new.initials[0], et_al) if self.bare else new.key(), new)

    def author(self, i: int, hi: int, compound: bool) -> tuple[tuple[str, str | None] | None, int]:
        """((last name, initials), behind) of an author at i; (None, i) if there is none."""
        j, initials, words = i, None, []
        if j < hi and self.kind(j) == "initials":
            initials, j = re.sub(r"\s+", "", self.toks[j].text), j + 1
        while compound and j < hi and self.toks[j].text in PARTICLES:
            words.append(self.toks[j].text)
            j += 1
        first = j
        while j < hi and self.kind(j) == "name" and (compound or j == first):
            words.append(self.toks[j].text)
            j += 1
        return ((" ".join(words), initials), j) if j > first else (None, i)

    def people(self, i: int, hi: int, compound: bool) -> tuple[list[tuple[str, str | None]], int, bool]:
        """(authors, behind, whether an "and" stands before the last) of a list at i."""
        one, j = self.author(i, hi, compound)
        if one is None:
            return [], i, False
        out, joined = [one], False
        while True:
            k, last = j, False
            if self.kind(k) == ",":
                k += 1
            if self.kind(k) == "and":
                k, last = k + 1, True
            if k == j or k >= hi:
                return out, j, joined
            one, behind = self.author(k, hi, compound)
            if one is None:
                return out, j, joined
            out.append(one)
            j, joined = behind, last

    def years(self, i: int, hi: int) -> tuple[list[str], int]:
        out = []
        while i < hi and self.kind(i) == "year":
            out.append(self.toks[i].text)
            i += 1
            if self.kind(i) == "," and self.kind(i, 1) == "year":
                i += 1
        return out, i

    def cited(self, i: int, hi: int) -> int:
        """What stands behind a citation that begins at i; i if none does."""
        start = self.toks[i].start
        people, j, joined = self.people(i, hi, self.bare)
        if not people:
            return i
        k = j + 1 if self.kind(j) == "," and self.kind(j, 1) == "etal" else j
        et_al = self.kind(k) == "etal"
        k = k + 1 if et_al else j
        if self.kind(k) == "(" and k < hi:
            end = self.closing[k]
            years, behind = self.years(k + 1, end)
            if not years or behind != end:
                return i
            if not et_al and not joined:  # what stands before a comma is no part of the list
                last, before = people[-1:], self.toks[i - 1].text.lower() if i and len(people) == 1 else ""
                if len(last[0][0]) < 3 or last[0][0] in NO_AUTHORS or before in BEFORE:
                    return i
                people = last
            self.add(people, years, et_al, start)
            return end + 1
        comma = self.kind(k) == ","
        years, behind = self.years(k + 1 if comma else k, hi)
        if not years:
            return i
        closed = self.kind(behind) in ("", ";", ",", ")") or behind >= hi
        if self.bare or (et_al and years) or (joined and len(people) == 2 and comma and closed):
            if people[0][0] in NO_AUTHORS:
                return i
            self.add(people, years if self.bare or et_al else years[:1], et_al, start)
            return behind
        return i

    def group(self, lo: int, hi: int) -> None:
        """A group between semicolons within parentheses."""
        depth, year, years = 0, None, []
        for i in range(lo, hi):
            depth += (self.kind(i) == "(") - (self.kind(i) == ")")
            if self.kind(i) == "year" and depth == 0:
                year = i if year is None else year
                years.append(self.toks[i].text)
        if year is None:
            return
        et_al = any(t.kind == "etal" for t in self.toks[lo:hi])
        authors, i = [], lo
        while i < year:
            j = i
            while j < year and self.kind(j) not in (",", "and", "etal"):
                j += 1
            one, behind = self.author(i, j, True)
            if one and behind == j:
                authors.append(one)
            i = j + 1
        if authors:
            self.add(authors, years, et_al, self.toks[lo].start)

    def read(self, lo: int, hi: int) -> None:
        i = lo
        while i < hi:
            if self.kind(i) == "(" and (end := self.closing[i]) <= hi:
                inside = self.text[self.toks[i].end : self.toks[end].start if end < len(self.toks) else len(self.text)]
                if not re.search(r"[=+*/^]", inside):
                    begin = i + 1
                    depth = 0
                    for j in range(i + 1, end + 1):
                        if j == end or (self.kind(j) == ";" and depth == 0):
                            self.read(begin, j) if any(self.kind(x) == "(" for x in range(begin, j)) else None
                            self.group(begin, j)
                            begin = j + 1
                        elif self.kind(j) in "()" and self.kind(j):
                            depth += 1 if self.kind(j) == "(" else -1
                i = end + 1
                continue
            behind = self.cited(i, hi)
            # Within a name that isn't cited no citation begins but at its next word.
            i = behind if behind > i else i + 1


def citations(text: str | None) -> list[Citation]:
    """The citations of a text, in its order, each first author and year once; one whose author ends another's compound name in the same year is left out."""
    if not text:
        return []
    reader = _Reader(tidy(text))
    reader.read(0, len(reader.toks))
    out = sorted(reader.found.values(), key=lambda c: c.start)
    longer = [(c.authors[0].lower(), c.year) for c in out]
    return [c for c in out if not any(y == c.year and a.endswith(" " + c.authors[0].lower()) for a, y in longer)]


def labels(found: list[Citation]) -> list[str]:
    """What a matcher is given for citations: for each the short form, its authors, these with initials, the year and, of several, the list; each once."""
    out: dict[str, None] = {}
    for c in found:
        with_initials = [f"{x} {a}" for a, x in zip(c.authors, c.initials, strict=True) if x]
        out |= dict.fromkeys([c.label(), *c.authors, *with_initials, c.year, *([", ".join(c.authors)] if len(c.authors) > 1 else [])])
    return list(out)
