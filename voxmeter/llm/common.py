"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmeter.sources.scratch import cut, scratch_dir

__all__ = ["checkpoint_dir", "code_points", "cut", "held_out", "least_hashed", "runs", "table", "text_runs", "xxh64_longs"]
MASK64 = (1 << 64) - 1
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


checkpoint_dir = scratch_dir


def held_out(doc_id: Column) -> Column:
    """Fold rule of the contracts: crc32(doc_id as text) mod 3 is 1 (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def least_hashed(rows: DataFrame, column: str, n: int, total: int) -> DataFrame:
    """The ``n`` rows, of ``total``, with the least hashes of a column. A bound on the hash leaves little more than n rows to sort, so that no task sends n of its own."""
    share = 1.5 * n / max(1, total)
    near = rows if share >= 1 else rows.where(F.xxhash64(column) < F.lit(int(share * 2.0**64) - (1 << 63)))
    return near.orderBy(F.xxhash64(column), column).limit(n)


def rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_longs(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each 64-bit integer, equal to Spark's xxhash64(bigint) at the default seed."""
    x = x.astype(np.uint64, copy=False)
    with np.errstate(over="ignore"):
        h = np.uint64(seed) + P5 + np.uint64(8)
        h = h ^ (rotl(x * P2, 31) * P1)
        h = rotl(h, 27) * P1 + P4
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h


def runs(n_chars: list[int], limit: int):
    """Index ranges of consecutive texts of about ``limit`` characters in all (one longer text stays whole)."""
    start = total = 0
    for i, n in enumerate(n_chars):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(n_chars):
        yield start, len(n_chars)


def text_runs(column: pa.Array, limit: int) -> Iterator[tuple[int, int, list[str]]]:
    """Index ranges of consecutive texts of about ``limit`` characters in all, and the texts (null ones empty); a batch's strings are never held all at once."""
    for a, b in runs(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), limit):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, a newline after each text, and the offsets at which the texts start (one more at the end)."""
    joined = "\n".join(texts) + "\n"
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts
