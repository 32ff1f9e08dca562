"""Typed predicates with two-valued logic, and the filters built on them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERED = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def _number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _is_pattern(value) -> bool:
    """Whether Python's engine takes a pattern, as a stand-in for Java's, which agrees on what both know."""
    try:
        re.compile(value)
    except (TypeError, re.error):
        return False
    return True


def condition(column: Column, operator: str, value, negate: bool = False) -> Column:
    """A predicate that is never null: a failed cast or a null is false before negation, and true after it.

    Ordered operators compare as numbers, the textual ones as strings. A value that can't be compared so, a pattern
    that isn't one, and a single value instead of a list (taken as a list of one) are no errors.
    """
    text = column.cast("string")
    if operator in ORDERED:
        out = ORDERED[operator](text.try_cast("double"), F.lit(_number(value)))
    elif operator == "eq":
        out = column == F.lit(value)
    elif operator == "ne":
        out = ~F.coalesce(column == F.lit(value), F.lit(False))
    elif operator == "contains":
        out = text.contains(str(value))
    elif operator == "starts_with":
        out = text.startswith(str(value))
    elif operator == "ends_with":
        out = text.endswith(str(value))
    elif operator == "in":
        out = column.isin(list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value])
    elif operator == "regex":
        out = text.rlike(value) if _is_pattern(value) else F.lit(False)
    else:
        raise ValueError(f"no operator {operator}")
    out = F.coalesce(out, F.lit(False))
    return ~out if negate else out


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def query(df: DataFrame, conditions: list[tuple], order_by: str | None = None, descending: bool = False, offset: int = 0, limit: int | None = None, tiebreak: str | None = None) -> DataFrame:
    """Rows that meet all conditions (name, operator, value[, negate]); an unknown sort field is skipped."""
    out = df.where(all_of([condition(F.col(c[0]), *c[1:]) for c in conditions]))
    keys = [F.col(order_by).desc() if descending else F.col(order_by).asc()] if order_by in df.columns else []
    if tiebreak:
        keys.append(F.col(tiebreak).asc())
    if keys:
        out = out.orderBy(*keys)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def valid_at(day, start: str = "valid_from", end: str = "valid_until") -> Column:
    """Half-open [from, until); 0 is unbounded."""
    at = F.lit(day)
    return ((F.col(start) == 0) | (at >= F.col(start))) & ((F.col(end) == 0) | (at < F.col(end)))


def filter_triples(df: DataFrame, min_confidence: float = 0.0, only_preferred: bool = False, exclude_deprecated: bool = True, day=None) -> DataFrame:
    keep = [F.col("confidence") >= min_confidence]
    if only_preferred:
        keep.append(F.col("rank") == "preferred")
    if exclude_deprecated:
        keep.append(F.col("rank") != "deprecated")
    if day is not None:
        keep.append(valid_at(day))
    return df.where(all_of(keep))


def topic_pattern(pattern: str) -> str:
    """A regular expression of a topic pattern: * is one segment, ** any rest."""
    out = []
    for part in pattern.split("."):
        out.append(".*" if part == "**" else "[^.]+" if part == "*" else "".join(c if c.isalnum() or c == "_" else "\\" + c for c in part))
    return "^" + "\\.".join(out) + "$"


def mask(column: Column) -> Column:
    """First and last two characters around *** of longer strings, else ***."""
    return F.when(F.length(column) > 4, F.concat(F.substring(column, 1, 2), F.lit("***"), F.substring(column, -2, 2))).otherwise("***")


def snippet(content: Column, words: list[str], size: int) -> Column:
    """A window of size characters around the first of the words that occurs, from a third of it before; with ellipses."""
    low = F.lower(content)
    found = [F.when(F.instr(low, w.lower()) > 0, F.instr(low, w.lower()) - 1) for w in words]
    at = F.coalesce(*found, F.lit(0)) if found else F.lit(0)
    start = F.greatest(F.lit(0), at - size // 3)
    end = F.least(F.length(content), start + size)
    cut = F.substring(content, start + 1, end - start)
    out = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(end < F.length(content), "...").otherwise(""))
    return F.when(F.length(content) <= size, content).otherwise(out)
