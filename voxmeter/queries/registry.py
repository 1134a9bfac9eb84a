from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmeter.queries.fixtures import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HELPERS: dict[str, str] = {}


class Tables:
    """The views over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    @property
    def analysed(self) -> DataFrame:
        """analysis with pain points as an array."""
        a = view(self.spark, self.sf_dir, "analysis")
        return a.withColumn("pain_points", F.when(F.col("pain_points_csv") == "", F.array().cast("array<string>")).otherwise(F.split("pain_points_csv", "[|]"))).drop("pain_points_csv")


def query(sql: str | None = None):
    """Registers f(tables) under its name."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql, HELPERS)
        return f

    return register


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Double columns rounded, so that the order in which a sum was taken does not show."""
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double" and (not columns or c in columns)})
