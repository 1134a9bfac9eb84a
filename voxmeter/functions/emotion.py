"""Functions over the sixteen emotion scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmeter.constants import CATEGORIES, EMOTIONS


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def mean_of(names: list[str]) -> Column:
    return total([F.col(n) for n in names]) / len(names)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def score_of(m: Column, emotion: str) -> Column:
    """One emotion of a map of strings: a number from 0 to 1, 0 if bad or missing."""
    return clamp(F.coalesce(F.try_element_at(m, F.lit(emotion)).try_cast("double"), F.lit(0.0)))


def extract(df: DataFrame, emotions: str) -> DataFrame:
    """Spreads a map column to one column per emotion."""
    return df.withColumns({e: score_of(F.col(emotions), e) for e in EMOTIONS})


def with_categories(df: DataFrame) -> DataFrame:
    return df.withColumns({f"emo_category_{k}": mean_of(v) for k, v in CATEGORIES.items()})


def dominant_n(n: int = 3) -> Column:
    """The n highest emotions as an array of (name, score), ties in the list's order."""
    ranked = F.array_sort(F.array(*[F.struct((-F.col(e)).alias("v"), F.lit(i).alias("i"), F.lit(e).alias("name")) for i, e in enumerate(EMOTIONS)]))
    return F.transform(F.slice(ranked, 1, n), lambda s: F.struct(s["name"].alias("emotion"), (-s["v"]).alias("score")))


def valid_scores(m: Column) -> Column:
    return F.forall(F.array(*map(F.lit, EMOTIONS)), lambda e: F.coalesce(F.try_element_at(m, e).try_cast("double").between(0, 1), F.lit(False)))


def values() -> Column:
    return F.array(*map(F.col, EMOTIONS))


def dominant() -> Column:
    """The first highest emotion."""
    best = F.greatest(*map(F.col, EMOTIONS))
    return F.coalesce(*[F.when(F.col(e) == best, e) for e in EMOTIONS], F.lit("indiferencia"))


def spread() -> Column:
    """Population standard deviation of the sixteen scores."""
    mean = mean_of(EMOTIONS)
    return F.sqrt(total([F.pow(F.col(e) - mean, 2) for e in EMOTIONS]) / len(EMOTIONS))


def sentiment_confidence(sentiment: Column) -> Column:
    p, n = mean_of(CATEGORIES["positivas"]), mean_of(CATEGORIES["negativas"])
    zero = F.lit(0.0)
    raw = F.when(sentiment == "positive", p + F.greatest(zero, p - n) * 0.5).when(sentiment == "negative", n + F.greatest(zero, n - p) * 0.5).otherwise((1 - F.abs(p - n)) * 0.8)
    return clamp(raw, 0.05, 0.95)


def long_form(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.unpivot(ids, EMOTIONS, "emotion", "score")


def label(c: Column) -> Column:
    return F.initcap(c)
