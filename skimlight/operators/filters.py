"""Predicates of a search: facets, variable ranges and formula ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """Inclusive bounds of a variable or function; None leaves a side open."""

    key: int
    low: float | None = None
    high: float | None = None


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def facet_filter(wanted: Mapping[str, Iterable[str]], category: Callable[[str], Column]) -> Column:
    """One of the values in each of the categories. A document without a category fails it."""
    return _all(F.coalesce(category(c).isin(list(values)), F.lit(False)) for c, values in wanted.items())


def range_filter(ranges: Iterable[Range], value: Callable[[int], Column], kind: str = "float") -> Column:
    """Any of a key's ranges, for every key. Bounds are compared as float32, as variables are stored."""
    by_key: dict[int, list[Range]] = {}
    for r in ranges:
        by_key.setdefault(r.key, []).append(r)

    def one(r: Range) -> Column:
        v = value(r.key).cast(kind)
        low = F.lit(True) if r.low is None else v >= F.lit(float(r.low)).cast("float").cast(kind)
        high = F.lit(True) if r.high is None else v <= F.lit(float(r.high)).cast("float").cast(kind)
        return low & high

    return _all(reduce(lambda a, b: a | b, map(one, own)) for own in by_key.values())


def function_range_filter(ranges: Iterable[Range], function: Callable[[int], Column]) -> Column:
    """The same over the values of scoring functions, which are doubles."""
    return range_filter(ranges, function, "double")
