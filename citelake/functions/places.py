"""Where patterns stand in a text, as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: A noncharacter, which Unicode keeps for programs' own use and no text holds: it marks what a pattern has found.
MARK = "\ufdd0"


def matches_at(text: Column, pattern: str, group: int = 1) -> Column:
    """Array of (at, length, value) of all matches of a pattern: place from 0, length of the match, and the group's text.

    One pass marks the matches; a text is these and what lies between them in turn, so places are sums of lengths."""
    each = "array<struct<at:int,length:int,value:string>>"

    def step(s: Column, cut: Column, i: Column) -> Column:
        at, length = s["at"] + F.length(F.get(cut, i)), F.length(F.get(cut, i + 1))
        return F.struct((at + length).alias("at"), F.concat(s["all"], F.array(F.struct(at.alias("at"), length.alias("length"), F.get(cut, i + 2).alias("value")))).alias("all"))

    def found(cut: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(each).alias("all"))
        return F.when(F.size(cut) < 3, F.array().cast(each)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(cut) - 2, F.lit(3)), start, lambda s, i: step(s, cut, i), lambda s: s["all"]))

    return bound(F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}${group}{MARK}"), MARK, -1), found)
