"""Column functions on authors: display forms, initials, search keys, last names, collaborations, author ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .places import bound
from .text import fold

#: Words that belong to a family name, endings of names that are no person's, and the bounds of author lists.
PARTICLES = "de du da di del della van von le la ter ten ibn bin al el den der dos das mac mc".split()
GROUP_WORDS = "collaboration group team consortium project experiment".split()
LARGE, SHOWN, ID_LIMIT = 20, 3, 10
_FAMILY = rf"(?i)^(?:(.*?)\s+)?((?:(?:{'|'.join(PARTICLES)})\s+)*\S+)$"
_COLLABORATION = r"(?i)(?<![A-Za-z0-9_])(?:collaboration|collab\.?|group|team|consortium|experiment)(?![A-Za-z0-9_])"
_SUFFIX = r"(?i)\s+(?:Collaboration|Collab\.?|Group|Team|Consortium|Experiment)$"


def _clean(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))


def is_group(name: Column) -> Column:
    """Whether a name ends like a collaboration's and not a person's."""
    return F.rlike(_clean(name), F.lit(rf"(?i)^.*\s+(?:{'|'.join(GROUP_WORDS)})$"))


def family_name(name: Column) -> Column:
    """What stands before a comma; without one the last word, with particles before it."""
    t = _clean(name)
    return F.when(F.contains(t, F.lit(",")), F.trim(F.split_part(t, F.lit(","), F.lit(1)))).otherwise(F.regexp_extract(t, _FAMILY, 2))


def given_name(name: Column) -> Column:
    t = _clean(name)
    return F.when(F.contains(t, F.lit(",")), F.trim(F.split_part(t, F.lit(","), F.lit(2)))).otherwise(F.regexp_extract(t, _FAMILY, 1))


def spaced_initials(given: Column) -> Column:
    """R.L. as R. L."""
    return F.regexp_replace(given, r"([A-Z])\.(?=[A-Z])", "$1. ")


def initials(given: Column) -> Column:
    """Feng-Kun as F.-K., R.L. as R. L."""
    words = F.filter(F.split(spaced_initials(given), r"\s+"), lambda w: w != "")
    one = lambda w: F.array_join(F.transform(F.filter(F.split(w, "-"), lambda s: s != ""), lambda s: F.concat(F.upper(F.left(s, F.lit(1))), F.lit("."))), "-")
    return F.array_join(F.filter(F.transform(words, one), lambda x: x != ""), " ")


def display_name(name: Column, full: bool = True) -> Column:
    """Guo, Feng-Kun as Feng-Kun Guo, or as F.-K. Guo; groups as they are; null gives an empty text."""
    given = given_name(name) if full else initials(given_name(name))
    return F.when(is_group(name), _clean(name)).otherwise(F.trim(F.concat_ws(" ", F.nullif(given, F.lit("")), family_name(name))))


def search_key(name: Column) -> Column:
    """First letters of the given names and the last name, in lower case: f k guo."""
    t = _clean(name)
    comma = F.contains(t, F.lit(","))
    last = F.when(comma, F.trim(F.split_part(t, F.lit(","), F.lit(1)))).otherwise(F.regexp_extract(t, r"(\S*)$", 1))
    first = F.when(comma, F.trim(F.split_part(t, F.lit(","), F.lit(2)))).otherwise(F.regexp_extract(t, r"^(.*)\s\S+$", 1))
    letters = F.transform(F.filter(F.split(spaced_initials(first), r"[\s\-.]+"), lambda w: w != ""), lambda w: F.lower(F.left(w, F.lit(1))))
    return F.when(last == "", F.lit("")).otherwise(F.concat_ws(" ", F.nullif(F.array_join(letters, " "), F.lit("")), F.lower(last)))


def capped(names: Column, limit: int = SHOWN, large: int | None = LARGE) -> Column:
    """The first `limit` names; of more than `large` (None: of no list) only the first; null gives none."""
    names = F.coalesce(names, F.array().cast("array<string>"))
    return F.slice(names, F.lit(1), F.when(F.size(names) > F.lit(large), 1).otherwise(limit))


def author_line(names: Column, total: Column, most: int = SHOWN, unknown: str = "Unknown author", large: int | None = LARGE) -> Column:
    """The names as one line, with et al. if there are more than are shown or `others` is among them."""
    names = F.coalesce(names, F.array().cast("array<string>"))
    people = F.filter(F.transform(F.filter(names, lambda n: F.lower(n) != "others"), lambda n: display_name(n)), lambda n: n != "")
    others = F.exists(names, lambda n: F.lower(n) == "others")
    n = F.coalesce(total, F.size(names))
    many = F.coalesce(n > F.lit(large), F.lit(False))
    shown = F.when(many, 1).otherwise(most)
    more = many | (F.size(people) > most) | (n > F.size(people)) | others
    line = F.concat(F.array_join(F.slice(people, F.lit(1), shown), ", "), F.when(more, " et al.").otherwise(""))
    return F.when(F.size(people) == 0, unknown).otherwise(line)


def is_author_id(value: Column) -> Column:
    """Name parts with a letter among them, and a number, between points: E.Witten.1."""
    return F.coalesce(F.rlike(value, F.lit(r"^[^\n]*[A-Za-z][^\n]*\.\d+$")), F.lit(False))


def is_collaboration(name: Column) -> Column:
    return F.coalesce(F.rlike(name, F.lit(_COLLABORATION)), F.lit(False))


def collaboration_name(name: Column) -> Column:
    """ATLAS Collaboration as ATLAS; a name without such an ending as it is."""
    bare = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), _SUFFIX, ""))
    return F.when(bare != "", bare).otherwise(F.coalesce(name, F.lit("")))


def last_name(name: Column) -> Column:
    """The last name in lower case: of collaborations their name, of names in Han, Kana or Hangul the characters of the surname, else
    what stands before a comma, else the last word that is no initial."""
    return bound(_clean(name), _last_name)


def _last_name(t: Column) -> Column:
    han, kana, hangul = (F.regexp_extract(t, p, 1) for p in (r"^([一-鿿㐀-䶿])[一-鿿㐀-䶿]{1,3}$", r"^([一-鿿]{1,3})[぀-ヿ一-鿿]+$", r"^([가-힯]{1,2})[가-힯]{1,3}$"))
    words = F.transform(F.split(t, " "), lambda w: F.regexp_replace(F.replace(w, F.lit("."), F.lit("")), "[,;]$", ""))
    long = F.filter(words, lambda w: F.length(w) > 1)
    western = F.when(F.contains(t, F.lit(",")), F.replace(F.trim(F.split_part(t, F.lit(","), F.lit(1))), F.lit("."), F.lit(""))).otherwise(F.coalesce(F.try_element_at(long, F.lit(-1)), F.replace(t, F.lit("."), F.lit(""))))
    return F.lower(F.when(is_collaboration(t), collaboration_name(t)).otherwise(F.coalesce(F.nullif(han, F.lit("")), F.nullif(kana, F.lit("")), F.nullif(hangul, F.lit("")), western)))


def compact(name: Column) -> Column:
    """For loose comparison: lower case without points, blanks and hyphens; null for an empty name."""
    return F.nullif(F.regexp_replace(F.lower(name), r"[.\s-]", ""), F.lit(""))


def same_author(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) | (fold(a) == fold(b)), F.lit(False))


def initials_agree(line: Column, author: Column, initials: Column) -> Column:
    """Whether a line of authors gives an author (in lower case) these initials: true, false for others, null if it names no initials or not the author."""
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    written = lambda x: F.concat(F.lit("(?iu)(?:"), x, F.lit(r"\s*"), quoted(author), F.lit("|"), quoted(author), F.lit(r",\s*"), x, F.lit(")"))
    known = F.contains(F.lower(line), author)
    return F.when(F.rlike(line, written(quoted(initials))), True).when(known & F.rlike(line, written(F.lit(r"[A-Z]\.(?:\s*-?[A-Z]\.)*"))), False)


def initials_score(line: Column, initials: Column, same: float, other: float) -> Column:
    """The sum of `same` for each author of the map whose initials a line gives, and of `other` for each to whom it gives others."""
    one = lambda e: bound(initials_agree(line, e["key"], e["value"]), lambda x: F.when(x, same).when(~x, other).otherwise(0.0))
    return F.aggregate(F.coalesce(F.map_entries(initials), F.array().cast("array<struct<key:string,value:string>>")), F.lit(0.0), lambda s, e: s + F.coalesce(one(e), F.lit(0.0)))
