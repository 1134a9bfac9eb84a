"""Distinct stand-ins for many given names and for a format with few values."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmeter.llm import surrogates as S

KEY = b"a key for tests"


def test_given_names_and_small_formats(spark):
    names = [a + b for a in ("an", "be", "ci", "do") for b in ("la", "mo", "ni", "ro", "su", "ta", "vi", "wen")]
    found = [(kind, n) for kind in ("given-m", "given-f") for n in [*names, "adrian", "alba"]] + [("phone", f"+1{i:03d}") for i in range(900)]
    rows = S.assigned(spark.createDataFrame(found, "kind string, entity string"), KEY).cache()
    assert rows.count() == len(found)
    assert rows.select("kind", "stand_in").distinct().count() == len(found)
    assert rows.join(rows.select("kind", F.col("entity").alias("stand_in")), ["kind", "stand_in"]).count() == 0
    assert S.spelled("phone", "+1 500", "+12345") == "+1 2345"
