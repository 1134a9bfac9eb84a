"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmeter.llm.common import cut


def other_key(c: str) -> Column:
    """The same key under other values: a join on it deals both sides out anew, so that Spark can split a hot key's rows."""
    return F.col(c).bitwiseXOR(F.lit(1).cast("long"))


def with_least(rows: DataFrame) -> DataFrame:
    """(a, b, m): each row with the least b of its a. A hot a is reduced before the shuffle, and its rows in the join can be split."""
    least = rows.groupBy("a").agg(F.min("b").alias("m")).select(other_key("a").alias("k"), "m")
    return rows.withColumn("k", other_key("a")).join(least, "k").drop("k")


#: Links that a task connects among themselves at once.
LOCAL = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to (node, least node it is connected with by them), nodes that are their own least left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    of = np.arange(len(nodes))
    while True:
        low = np.minimum(of[x], of[y])
        new = of.copy()
        np.minimum.at(new, of[x], low)
        np.minimum.at(new, of[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, of):
            break
        of = new
    moved = of != np.arange(len(nodes))
    return nodes[moved], nodes[of[moved]]


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a task's links, ``LOCAL`` at a time, by fewer that connect the same."""
    a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > LOCAL:
            x, y = stars(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
            a, b = a[:0], b[:0]
    if len(a):
        x, y = stars(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids to (node, component): the least id reachable from each node that has a link.

    Large-star and small-star turns: each links nodes straight to the least node they know,
    until nothing changes; tasks connect what they hold by themselves before each turn. Links to itself, repeated and null ones are dropped; no links give
    no rows.
    """
    a, b = (F.col(c).cast("long") for c in edges.columns[:2])
    e = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct().mapInArrow(local_stars, "a long, b long").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = with_least(large)
        e = cut(small.select("a", F.col("m").alias("b")).unionByName(small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct().mapInArrow(local_stars, "a long, b long").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Labels:
    """Least label of each of n things as links between them come in; for one bounded group in one task."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, things: np.ndarray) -> None:
        own = self.of[things]
        least = own.min()
        for x in np.unique(own[own != least]).tolist():
            self.of[self.of == x] = least
