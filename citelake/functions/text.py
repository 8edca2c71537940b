"""Column functions on text: folding of accents, variants for search, comparison forms; and the tokenizer of query strings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from .places import bound

#: Letters that don't decompose, and German umlauts written out.
LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l"}
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue"}
#: HTML entities in notes.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def _table() -> tuple[str, str]:
    """Lower-case letters of the Latin, Greek and Cyrillic blocks that decompose, and their base letters."""
    out = {}
    for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F)
        if bare != c and len(bare) == 1:
            out[c] = bare
    return "".join(out), "".join(out.values())


_FROM, _TO = _table()
_MARKS = r"[̀-ͯ]"


def fold(text: Column) -> Column:
    """Lower case without accents; null gives an empty text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return bound(low, lambda x: F.when(F.rlike(x, F.lit(r"[^\x00-\x7F]")), _bare(x)).otherwise(x))


def _bare(out: Column) -> Column:
    for a, b in LETTERS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(out, _FROM, _TO), _MARKS, "")


def expand_umlauts(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for a, b in UMLAUTS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return fold(out)


def variants(text: Column) -> Column:
    """The distinct non-empty forms that a search may meet."""
    return F.filter(F.array_distinct(F.array(fold(text), expand_umlauts(text))), lambda x: x != "")


def search_text(text: Column) -> Column:
    return F.array_join(variants(text), " ")


def fold_text(text: str) -> str:
    """fold() for a query string on the driver."""
    out = text.lower()
    for a, b in LETTERS.items():
        out = out.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFD", out) if not 0x300 <= ord(c) <= 0x36F)


def query_tokens(query: str) -> list[tuple[str, bool]]:
    """(token, quoted) of a query string: words, and phrases in double quotes; a quote that isn't closed reaches to the end."""
    out: list[tuple[str, bool]] = []
    for i, part in enumerate(query.split('"')):
        if i % 2:
            out += [(part.strip(), True)] if part.strip() else []
        else:
            out += [(w, False) for w in part.replace("\f", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return out


def query_variants(token: str, quoted: bool, journals: dict[str, list[str]] | None = None) -> list[str]:
    """The folded forms of a token, of the journals that it abbreviates, and, if quoted, these without points and blanks."""
    forms = []
    for x in [token, *(journals or {}).get(fold_text(token).replace(".", "").replace(" ", ""), [])]:
        wide = x.lower()
        for a, b in UMLAUTS.items():
            wide = wide.replace(a, b)
        forms += [fold_text(x), fold_text(wide)]
    if quoted:
        forms += ["".join(f.replace(".", "").split()) for f in forms]
    return [f for f in dict.fromkeys(forms) if f]


def part_keys(name: Column, left: bool) -> Column:
    """Keys of which a left and a right name share one if either holds the other: beginnings of the one among the pieces of the other.

    Names of one or two characters have no such piece; they meet all names of the other side."""
    name = F.coalesce(name, F.lit(""))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 2, F.lit(1))), lambda i: F.substr(name, i, F.lit(3)))
    begin, short = F.left(name, F.lit(3)), F.length(name) < 3
    mark = lambda m, x: F.concat(F.lit(m), x)
    inner, outer = ("in ", "of ") if left else ("of ", "in ")
    keys = F.concat(F.array(mark(inner, begin)), F.transform(pieces, lambda p: mark(outer, p)), F.array(F.lit("any right" if left else "any left"), F.when(short, F.lit("any left" if left else "any right"))))
    return F.when(name != "", F.array_distinct(F.array_compact(keys))).otherwise(F.array().cast("array<string>"))


def comparable(value: Column) -> Column:
    """The form in which two field values are compared: trimmed, lower case, white space collapsed; null is empty."""
    spaces = r"[\s  -​  　]+"
    return F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), spaces, " ")))


def note_text(note: Column) -> Column:
    """An HTML note as plain, comparable text: tags and unknown entities are blanks, long dashes hyphens."""
    out = F.regexp_replace(F.coalesce(note, F.lit("")), r"<[^>]+>", " ")
    for name, value in list(ENTITIES.items())[1:]:
        out = F.regexp_replace(out, f"(?i)&{name};", value)
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)&amp;", "\u0001"), r"(?i)&[a-z]+;", " ")
    out = F.regexp_replace(F.replace(out, F.lit("\u0001"), F.lit("&")), "[–—]", "-")
    return F.lower(F.trim(F.regexp_replace(out, r"[\s ]+", " ")))
