"""Nested metadata filters compiled to Columns.

A filter is a dict: ``{key: value}`` or ``{key: {operator: value}}`` with ``$eq $ne $in``, and ``{"$and": [...]}``,
``{"$or": [...]}``. Several keys must all hold; an empty filter holds always. ``$ne`` holds on a missing key; an unknown
operator never holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = frozenset({"$eq", "$ne", "$in", "$and", "$or"})


def columns(key: str) -> Column:
    return F.col(key)


def in_map(name: str) -> Callable[[str], Column]:
    """Look keys up in a map column."""
    return lambda key: F.try_element_at(name, F.lit(key))


def _test(value: Column, op: str, given: object) -> Column:
    if op == "$eq":
        return value.eqNullSafe(F.lit(given))
    if op == "$ne":
        return ~value.eqNullSafe(F.lit(given))
    if op == "$in":
        return F.coalesce(value.isin(list(given)), F.lit(False)) if given else F.lit(False)
    return F.lit(False)


def compile_where(where: dict | None, lookup: Callable[[str], Column] = columns) -> Column:
    out = F.lit(True)
    for key, given in (where or {}).items():
        if key in ("$and", "$or"):
            parts = [compile_where(w, lookup) for w in given]
            joined = F.lit(key == "$and")
            for p in parts:
                joined = (joined & p) if key == "$and" else (joined | p)
            out = out & joined
        elif isinstance(given, dict):
            for op, value in given.items():
                out = out & _test(lookup(key), op, value)
        else:
            out = out & _test(lookup(key), "$eq", given)
    return out


def operators_of(where: dict | None) -> set[str]:
    """The operators that a filter uses."""
    found: set[str] = set()
    for key, given in (where or {}).items():
        if key.startswith("$"):
            found.add(key)
            for w in given:
                found |= operators_of(w)
        elif isinstance(given, dict):
            found |= set(given)
    return found
