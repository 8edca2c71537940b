"""Search conditions as a tree, turned into one predicate; its simple parts reach the readers of files.

A condition is (field, operator, value); a tree is ("all", ...), ("any", ...) or ("not", tree) of conditions and trees. Tests of whole values and of their beginnings
compare as they are, so that a reader of Parquet can skip what they rule out; "contains" ignores case and accents unless it is exact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from citelake.functions import text as T

#: What a condition may ask of a field.
OPERATORS = {
    "is": lambda c, v: c == F.lit(v), "isNot": lambda c, v: ~c.eqNullSafe(F.lit(v)), "in": lambda c, v: c.isin(list(v)), "beginsWith": lambda c, v: F.startswith(c, F.lit(v)),
    "containsExactly": lambda c, v: F.contains(c, F.lit(v)), "contains": lambda c, v: F.contains(T.fold(c.cast("string")), F.lit(T.fold_text(v))), "doesNotContain": lambda c, v: ~F.coalesce(F.contains(T.fold(c.cast("string")), F.lit(T.fold_text(v))), F.lit(False)),
    "isLessThan": lambda c, v: c < F.lit(v), "isGreaterThan": lambda c, v: c > F.lit(v), "isEmpty": lambda c, v: c.isNull(), "isNotEmpty": lambda c, v: c.isNotNull(),
}


def predicate(tree: tuple) -> Column:
    """A tree of conditions as one column, never null: a condition on a null field doesn't hold, but for isNot, doesNotContain and isEmpty."""
    head, *rest = tree
    if head in ("all", "any"):
        parts = [predicate(t) for t in rest]
        return reduce((lambda a, b: a & b) if head == "all" else (lambda a, b: a | b), parts, F.lit(True) if head == "all" else F.lit(False)) if len(parts) != 1 else parts[0]
    if head == "not":
        return ~F.coalesce(predicate(rest[0]), F.lit(False))
    operator, value = rest if len(rest) == 2 else (rest[0], None)
    if operator not in OPERATORS:
        raise ValueError(f"no such operator: {operator}")
    return OPERATORS[operator](F.col(head), value)


def search(items: DataFrame, tree: tuple, limit: int | None = None, order: str = "item_id") -> DataFrame:
    """The items that a tree of conditions holds for; with a limit, the first so many by `order`."""
    found = items.filter(predicate(tree))
    return found if limit is None else found.orderBy(order).limit(limit)
