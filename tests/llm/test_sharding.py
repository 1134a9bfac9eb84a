"""Stratified shards: equal to SQL, even, in the mixture's shares, and stable."""

from __future__ import annotations

import zlib
from collections import Counter

from comparing import connect, rows_of
from pyspark.sql import functions as F

from voxmeter.llm import queries, sharding


def test_query_equals_sql(spark, sf_dir):
    got = queries.op13_stratified_shards(spark, sf_dir)
    cur = connect(sf_dir).execute(queries.ORACLES["op13_stratified_shards"])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, cur.fetchall())


def sources(spark, sizes: dict, n_parts: int = 5):
    rows = [(i, f"text {i}", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n_parts)


def test_every_shard_has_the_mixture(spark):
    """A hot source, a rare one, one that is null, and hundreds of a single row."""
    sizes = {"hot": 4000, "some": 900, "few": 30, None: 240}
    rows = sharding.assign_shards(sources(spark, sizes), 10).collect()
    for s, n in sizes.items():
        of = Counter(r.shard for r in rows if r.source == s)
        assert all(abs(of[k] - n / 10) <= 2 for k in range(10)), (s, of)
    sizes |= {f"one {i}": 1 for i in range(500)}
    rows = sharding.assign_shards(sources(spark, sizes), 10).collect()
    shards = Counter(r.shard for r in rows)
    assert len(rows) == sum(sizes.values()) and sorted(shards) == list(range(10)) and max(shards.values()) - min(shards.values()) <= 1
    for s, n in sizes.items():
        if n > 1:
            of = Counter(r.shard for r in rows if r.source == s)
            assert all(abs(of[k] - n / 10) <= max(2, n / 200) for k in range(10)), (s, of)
    singles = Counter(r.shard for r in rows if (r.source or "").startswith("one"))
    assert max(singles.values()) < 90
    for k in range(10):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(shards[k]))


def test_partitions_do_not_matter_and_seeds_do(spark):
    docs = {n: sources(spark, {"a": 300, "b": 40}, n) for n in (1, 7)}
    once, again, other = (sorted(map(tuple, sharding.assign_shards(d, 6, seed).collect())) for d, seed in ((docs[1], "s"), (docs[7], "s"), (docs[7], "t")))
    assert once == again != other
    order = [r[0] for r in sorted(once, key=lambda r: (r[5], r[6]))]
    assert order != sorted(order)


def test_odd_rows(spark, docs_of):
    texts = [None, "", "é", "x" * 3_000_000, "same", "same"]
    docs = docs_of(texts).withColumns({"source": F.lit("s"), "shard": F.lit("x"), "n": F.lit(1), "h": F.lit(1), "place": F.lit(1), "bucket": F.lit(1), "copy": F.lit(1), "id": F.lit(3)})
    docs = docs.union(docs.where("doc_id = 4")).union(docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    rows = sharding.assign_shards(docs, 3).collect()
    assert Counter(r.shard for r in rows) == {0: 3, 1: 3, 2: 2}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} >= {(0, 8, 0), (1, 8, 0), (2, 10, zlib.crc32("é".encode())), (3, 3_000_008, rows[[r.doc_id for r in rows].index(3)].text_crc32)}
    assert sorted(r.copy for r in rows if r.doc_id == 4) == [0, 1]
    assert sharding.assign_shards(docs.limit(0), 3).count() == 0
    assert Counter(r.shard for r in sharding.assign_shards(docs.limit(2), 24).collect()).most_common(1)[0][1] == 1


def test_repeated_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    docs = spark.range(100).select(F.lit(5).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    rows = sharding.assign_shards(docs, 4).collect()
    assert Counter(r.shard for r in rows) == {k: 25 for k in range(4)} and sorted(r.copy for r in rows) == list(range(100))


def test_files(spark, tmp_path):
    docs = sources(spark, {"a": 200, "b": 30}).withColumns({"shard": F.lit("old"), "extra": F.col("doc_id") * 2})
    docs = docs.union(docs.where("doc_id < 3"))
    sharding.write_shards(docs, f"{tmp_path}/out", 5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(back.columns) == sorted(["doc_id", "text", "source", "extra", "shard", "slot"])
    assert sorted(tuple(r) for r in back.select("doc_id", "text", "source", "extra").collect()) == sorted(tuple(r) for r in docs.drop("shard").select("doc_id", "text", "source", "extra").collect())
    expected = sorted((r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(docs, 5).collect())
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.collect()) == expected
    for k in range(5):
        slots = [r.slot for r in spark.read.parquet(f"{tmp_path}/out/shard={k}").coalesce(1).select("slot").collect()]
        assert sorted(slots) == list(range(-(-(k + 1) * 233 // 5) - -(-k * 233 // 5))), slots
