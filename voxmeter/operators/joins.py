"""Joining results with comments by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmeter.constants import EMOTIONS, PAIN_CATEGORIES


def join_one_to_one(comments: DataFrame, analysis: DataFrame, key: str = "comment_id") -> DataFrame:
    """Every comment with its one analysis; raises if the tables do not match row for row. One job over the keys alone tells."""
    side = lambda df, ours, theirs: df.select(key, F.lit(ours).alias("c"), F.lit(theirs).alias("r"))
    keys = side(comments, 1, 0).unionByName(side(analysis, 0, 1)).groupBy(key).agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    odd = F.col(key).isNull() | (F.col("c") != 1) | (F.col("r") != 1)
    n, m, bad = keys.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0)), F.count_if(odd)).first()
    if bad:
        raise ValueError(f"{n} comments, {m} results, {bad} keys that are not one to one")
    return comments.join(analysis, key)


def merge_results(comments: DataFrame, results: DataFrame, key: str = "comment_id") -> DataFrame:
    """Comments with their results; without one 0.0, an empty text or list; results without a comment are ignored."""
    defaults = {**dict.fromkeys(EMOTIONS, F.lit(0.0)), "churn_risk": F.lit(0.0), "sentiment": F.lit(""), "pain_points": F.array().cast("array<string>")}
    joined = comments.join(results, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items() if c in results.columns})


def align_batches(batches: DataFrame, responses: DataFrame) -> DataFrame:
    """Comments in batches with their responses by batch and place; is_fallback where there is none."""
    joined = batches.join(responses.withColumn("__hit", F.lit(True)), ["batch_id", "pos"], "left")
    return joined.withColumn("is_fallback", F.col("__hit").isNull()).drop("__hit")


def keyword_table(spark) -> DataFrame:
    rows = [(i, c, k) for i, (c, ks) in enumerate(PAIN_CATEGORIES.items()) for k in ks]
    return spark.createDataFrame(rows, "ord int, category string, keyword string")


#: Letters of the grams by which keywords are filed.
GRAM = 3


def grams(text: Column, n: int) -> Column:
    """All stretches of n characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def keyword_lookup(points: DataFrame, keywords: DataFrame, point: str = "pain_point") -> DataFrame:
    """Distinct pain points with the first category one of whose keywords they contain, else otros.

    A keyword is filed under its first letters and met by the points that have them somewhere,
    so the tables are joined by equality, whatever their sizes; then the whole keyword is
    looked for. An empty keyword is in every point, null ones are in none.
    """
    filed = keywords.where("keyword IS NOT NULL").withColumn("gram", F.substring("keyword", 1, GRAM))
    # At most GRAM + 1 rows.
    sizes = sorted(r[0] for r in filed.select(F.length("gram")).distinct().collect())
    own = points.select(point).distinct()
    of = F.array_distinct(F.concat(F.array(F.lit("")), *[grams(F.col(point), n) for n in sizes if n]))
    met = own.withColumn("gram", F.explode_outer(of)).join(filed, "gram", "left").withColumn("hit", F.contains(F.col(point), F.col("keyword")))
    return met.groupBy(point).agg(F.coalesce(F.min_by("category", F.when(F.col("hit"), F.col("ord"))), F.lit("otros")).alias("category"))
