"""NPS categories, alignment with sentiment, and inference from emotions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmeter.constants import DETRACTOR_EMOTIONS, EMOTIONS, NPS_WEIGHTS, PROMOTER_EMOTIONS
from voxmeter.functions.emotion import clamp, mean_of, spread, total


def category(nps: Column) -> Column:
    """By the truncated score: up to 6 detractor, 7 and 8 passive, 9 and 10 promoter; else unknown."""
    n = nps.cast("int")
    return F.when(n.between(0, 6), "detractor").when(n.between(7, 8), "passive").when(n.between(9, 10), "promoter").otherwise("unknown")


def expected_sentiment(cat: Column) -> Column:
    return F.when(cat == "detractor", "negative").when(cat == "promoter", "positive").otherwise("neutral")


def alignment(cat: Column, sentiment: Column) -> Column:
    return F.when(cat == "unknown", "unknown").when(sentiment == expected_sentiment(cat), "aligned").otherwise("misaligned")


def alignment_score(cat: Column) -> Column:
    one = F.lit(1.0)
    return F.when(cat == "promoter", F.least(one, mean_of(PROMOTER_EMOTIONS) + 0.3)).when(cat == "detractor", F.least(one, mean_of(DETRACTOR_EMOTIONS) + 0.2)).when(cat == "passive", 1 - F.greatest(F.lit(0.0), F.greatest(*map(F.col, EMOTIONS)) - 0.6)).otherwise(0.0)


def insights(cat: Column, sentiment: Column, n_pains: Column, churn: Column) -> Column:
    """Texts on a response; their wording is fixed."""
    aligned = sentiment == expected_sentiment(cat)
    either = lambda a, b: F.when(aligned, a).otherwise(b)
    first = F.when(cat == "detractor", "Customer is a detractor - high churn risk").when(cat == "promoter", "Customer is a promoter - potential advocate").when(cat == "passive", "Customer is passive - opportunity for improvement")
    second = (
        F.when(cat == "detractor", either("Sentiment aligns with NPS - genuine dissatisfaction", "Sentiment misalignment - investigate comment context"))
        .when(cat == "promoter", either("Strong positive sentiment supports promoter status", "Unexpected negative sentiment despite high NPS - investigate"))
        .when(cat == "passive", either("Neutral sentiment consistent with passive status", "Mixed sentiment signals - may indicate specific issues"))
    )
    pains = F.when((cat == "detractor") & (n_pains > 0), F.concat(F.lit("Identified "), n_pains.cast("string"), F.lit(" pain points requiring attention")))
    risk = F.when((churn > 0.7) & (cat != "detractor"), "High churn risk despite NPS category - prioritize retention").when((churn < 0.3) & (cat == "detractor"), "Low churn risk despite detractor status - may be recoverable")
    return F.when(cat == "unknown", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(first, second, pains, risk)))


def infer(sentiment: Column, churn: Column) -> Column:
    """NPS from weighted emotions, sentiment and churn risk, 0 to 10 with one decimal."""
    emotion = total([F.col(e) * w for e, w in NPS_WEIGHTS.items()]) / sum(abs(w) for w in NPS_WEIGHTS.values())
    mood = F.when(sentiment == "positive", 0.4).when(sentiment == "negative", -0.4).otherwise(0.0)
    return F.bround(clamp(5 + (emotion + mood - (F.coalesce(churn, F.lit(0.5)) - 0.5) * 0.6) * 3.33, 0.0, 10.0), 1)


def inference_confidence(sentiment: Column, churn: Column) -> Column:
    clear = F.greatest(*map(F.col, EMOTIONS)) - spread()
    return clamp(clear * 0.6 + F.when(sentiment != "neutral", 0.2).otherwise(0.0) + F.abs(F.coalesce(churn, F.lit(0.5)) - 0.5) * 0.4, 0.1, 0.95)


def filled(nps: Column, sentiment: Column, churn: Column) -> Column:
    """The own NPS where it is valid, else the inferred one."""
    return F.coalesce(F.when(nps.between(0, 10), nps), infer(sentiment, churn))


def interpretation(score: Column) -> Column:
    return F.when(score >= 50, "Excellent").when(score >= 0, "Good").when(score >= -50, "Needs Improvement").otherwise("Critical")


def chart_interpretation(score: Column) -> Column:
    return F.when(score > 50, "Excelente").when(score > 0, "Bueno").otherwise("Crítico")
