"""Near copies by the exact Jaccard similarity of word shingles.

Texts with equal sets of shingles are one class. MinHash bands of the sets deal the classes
into buckets; the classes of a bucket are compared by their whole sets, and only links that
connect the similar ones are sent on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmeter.llm.common import cut, runs
from voxmeter.llm.lines import LIMIT, ROWS, SEED, STEP, band_keys, bucket_links, least, maybe_in, membership

BANDS = 20
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**4)**20 = 0.99997.
CHUNK = 1 << 18
CACHE = 1 << 17
_rng = np.random.default_rng(20240601)
FACTORS = _rng.integers(1 << 31, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
FLIPS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


class Words(dict):
    """Word -> its XXH64; emptied at ``CACHE`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= 64:
            self[word] = h
        return h


def word_shingles(text: str | None, n_words: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n_words`` words (of all words, if there are fewer); none without a word. Words are those of the SimHash."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(0, dtype=np.int64)
    w = np.fromiter(map(words.__getitem__, own), dtype=np.uint64, count=len(own))
    n = max(1, len(w) - n_words + 1)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(n_words, len(w))):
            h = h * STEP + w[k : n + k]
        h ^= h >> np.uint64(29)
        h *= STEP
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def name(own: np.ndarray) -> int:
    """A set's 64-bit hash, signed."""
    return int(np.frombuffer(xxhash.xxh64(own.tobytes(), SEED).digest(), dtype=">i8")[0])


def classes_task(n_words: int):
    """(id, text) to (id, h, keys): the hash of each text's set and its band keys; texts without a word are left out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b in runs([len(t.as_py() or "") for t in batch.column(1)], CHUNK):
                sets = [word_shingles(t.as_py(), n_words, words) for t in batch.column(1).slice(a, b - a)]
                at = [i for i, x in enumerate(sets) if len(x)]
                if not at:
                    continue
                own = [sets[i] for i in at]
                short = (np.concatenate(own).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
                keys = band_keys(least(short, np.array([len(x) for x in own]), FLIPS, FACTORS)).view(np.int64)
                columns = [pa.array(ids[a:b][at]), pa.array([name(x) for x in own], pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(keys.T.ravel()), BANDS).cast(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "keys"])

    return task


def sets_of(docs: DataFrame, reps: DataFrame, n_words: int) -> DataFrame:
    """(h, own) of the wanted (h, rep): each class's set once, read from the text of its representative."""
    shared = docs.sparkSession.sparkContext.broadcast(membership(reps, "rep"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            hit = np.flatnonzero(maybe_in(shared.value, batch.column(0).to_numpy())).tolist()
            for a, b in runs([len(batch.column(1)[i].as_py() or "") for i in hit], CHUNK):
                own = [x for i in hit[a:b] if len(x := word_shingles(batch.column(1)[i].as_py(), n_words, words))]
                yield pa.RecordBatch.from_arrays([pa.array([name(x) for x in own], pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["h", "own"])

    return docs.mapInArrow(task, "h long, own array<long>").join(reps, "h", "left_semi").groupBy("h").agg(F.first("own").alias("own"))


def arrays(values: list) -> list[np.ndarray]:
    return [np.asarray(x, dtype=np.int64) for x in values]


def similar_texts(docs: DataFrame, n_words: int = 5, threshold: float = 0.8, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) of ids that connect all texts whose sets of word shingles have a Jaccard similarity of at least ``threshold``.

    Texts without a word and rows without an id link with nothing; other columns are ignored;
    an empty table gives no rows.
    """
    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).where(F.col("id").isNotNull())
    rows = cut(own.mapInArrow(classes_task(n_words), "id long, h long, keys array<long>"))
    # Equal texts are one class before any bucket is made.
    classes = cut(rows.groupBy("h").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")))
    reps = classes.select("h", "rep")
    wanted_sets = lambda wanted: sets_of(own, cut(wanted.join(reps, "h")), n_words)
    near = bucket_links(classes.select(F.explode("keys").alias("key"), "h"), wanted_sets, threshold, arrays, limit)
    first, second = reps.toDF("a", "x"), reps.toDF("b", "y")
    between = near.distinct().join(first, "a").join(second, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # A repeated text's copies stand by their representative; the join's key is one of a class, the many rows are split by Spark.
    equal = rows.select("id", "h").join(reps, "h").where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    return between.unionByName(equal)
