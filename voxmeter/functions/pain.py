"""Pain points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmeter.constants import PAIN_CATEGORIES
from voxmeter.functions.text import contains_any, strip


def clean(points: Column, dedupe: bool = False) -> Column:
    """Non-blank strings, trimmed and lower-cased; null gives an empty array."""
    out = F.filter(F.transform(F.coalesce(points, F.array().cast("array<string>")), lambda x: F.lower(strip(x))), lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(out) if dedupe else out


def category(point: Column) -> Column:
    """The first category with a keyword in the pain point, else otros."""
    first, *rest = PAIN_CATEGORIES.items()
    start = F.when(contains_any(point, first[1]), first[0])
    return reduce(lambda c, kv: c.when(contains_any(point, kv[1]), kv[0]), rest, start).otherwise("otros")


def categorized(points: Column) -> Column:
    """Map of category to its pain points, without empty categories."""
    names = [*PAIN_CATEGORIES, "otros"]
    of = lambda name: F.filter(points, lambda x: category(x) == name)
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(of, names))), lambda _, v: F.size(v) > 0)


def severity(n: Column, churn: Column) -> Column:
    return F.when(n == 0, "none").when((churn > 0.7) | (n >= 3), "high").when((churn > 0.4) | (n >= 2), "medium").otherwise("low")
