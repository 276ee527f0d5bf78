"""Metadata filters: a filter mapping compiled to one predicate, so Catalyst can push it down."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(metadata: Column, path: str, kind: str = "string") -> Column:
    """A dotted path of a VARIANT column; null where it is missing."""
    return F.try_variant_get(metadata, "$." + path, kind)


def _values(v: Any) -> list:
    return list(v) if isinstance(v, (list, tuple, set, frozenset)) else [v]


def rule(actual: Column, expected: Any, is_array: bool = False) -> Column:
    """any, all, contains, then min and max, in that order of precedence; a plain collection is membership, anything else equality."""
    if isinstance(expected, Mapping):
        if "any" in expected:
            return actual.isin(_values(expected["any"]))
        have = actual if is_array else F.array(actual)
        if "all" in expected:
            return F.size(F.array_except(F.array(*[F.lit(x) for x in _values(expected["all"])]), have)) == 0
        if "contains" in expected:
            return F.array_contains(have, expected["contains"])
        ok = F.lit(True)
        if "min" in expected:
            ok = ok & (actual >= expected["min"])
        if "max" in expected:
            ok = ok & (actual <= expected["max"])
        return ok
    if isinstance(expected, (list, tuple, set, frozenset)):
        return actual.isin(list(expected))
    return actual == expected


def matches(filters: Mapping[str, Any] | None, column: Callable[[str], Column], arrays: frozenset[str] = frozenset()) -> Column:
    """All rules hold; a null value fails its rule; no filter passes. column: gives a path's Column."""
    tests = [F.coalesce(rule(column(k), v, k in arrays) & column(k).isNotNull(), F.lit(False)) for k, v in (filters or {}).items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))
