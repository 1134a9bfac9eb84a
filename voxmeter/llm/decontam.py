"""Benchmark decontamination by greedy string tiling.

Documents stay where they are: a task gets the benchmark (in shards of a proven size) and
looks for seeds, runs of ``min_match`` words that a document shares with an item. Where the
seeds could cover enough of an item, tiles are laid: the longest common runs of words not
yet marked, found by rolling Karp-Rabin hashes and checked word by word, are marked again
and again, so reordered passages are covered too. A document is contaminated if its tiles
cover the threshold of an item's words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmeter.llm.common import cut

WORD = re.compile(r"\w+")
#: Characters of benchmark text broadcast at once; a larger benchmark is taken in several such shards.
SHARD_CHARS = 20_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, mod 2**64."""
    if len(_powers[0]) < n:
        for k, x in enumerate((BASE, INVERSE)):
            own = np.full(2 * n, x, dtype=np.uint64)
            own[0] = 1
            _powers[k] = np.multiply.accumulate(own)
    return _powers[0], _powers[1]


def rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2**64) of all windows of n, each from the sums up to its ends: no window is hashed anew, whatever its length."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        power, inverse = powers(len(ids))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * inverse[: len(ids)], dtype=np.uint64)])
        return (sums[n:] - sums[: len(sums) - n]) * power[n - 1 : len(ids)]


class Benchmark:
    """Items of one shard as word numbers, and their seeds in a sorted array."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        self.words: dict[str, int] = {}
        self.min_match = min_match
        kept = [(i, w) for i, t in items if (w := WORD.findall((t or "").lower()))]
        self.item_ids = [i for i, _ in kept]
        self.items = [np.array([self.words.setdefault(w, len(self.words)) for w in ws], dtype=np.int64) for _, ws in kept]
        self.sizes = np.array([len(x) for x in self.items], dtype=np.int64)
        seeds = [rolled(x, min(min_match, len(x))) for x in self.items]
        key, item, place = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (seeds, [np.full(len(s), i) for i, s in enumerate(seeds)], [np.arange(len(s)) for s in seeds]))
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order].astype(np.uint64), item[order], place[order]
        self.distinct, self.first, self.count = np.unique(self.key, return_index=True, return_counts=True) if len(self.key) else (self.key, self.place, self.place)
        # Items shorter than a seed are seeds of their own lengths.
        self.lengths = sorted({min(min_match, len(x)) for x in self.items})

    def likely(self, ids: np.ndarray, threshold: float) -> list[int]:
        """Items whose seeds in this document cover at least the threshold: no tiling covers more than its seeds do."""
        seeds = []
        for n in self.lengths:
            known = ids >= 0
            if n > len(ids) or not len(self.distinct):
                continue
            whole = np.convolve(known, np.ones(n, dtype=np.int64), "valid") == n
            keys = np.unique(rolled(ids, n)[whole])
            at = np.searchsorted(self.distinct, keys)
            at[at == len(self.distinct)] = 0
            seeds.append(at[self.distinct[at] == keys])
        seeds = np.unique(np.concatenate(seeds)) if seeds else np.zeros(0, dtype=np.int64)
        if not len(seeds):
            return []
        count = self.count[seeds]
        # The places of all seeds: runs of count from first on.
        at = np.repeat(self.first[seeds] - np.cumsum(count) + count, count) + np.arange(count.sum())
        spots = np.unique(np.concatenate([(self.item[at] << 32) + self.place[at] + k for k in range(self.min_match)]))
        items, n = np.unique(spots >> 32, return_counts=True)
        size = self.sizes[items]
        return items[np.minimum(n, size) >= threshold * size].tolist()


#: Pairs of equal seeds, per word of both texts, up to which they are listed one by one.
LISTED = 16
#: Runs without free words that are met before all such runs are left out at once.
FRUITLESS = 4096


def runs_of_seeds(doc: np.ndarray, item: np.ndarray, least: int) -> tuple[np.ndarray, ...] | None:
    """(length, place in doc, place in item) of the longest common runs of at least ``least`` words, from the seeds on each diagonal; None if seeds have too many pairs."""
    order = np.argsort(own := rolled(item, least), kind="stable")
    keys, first, count = np.unique(own[order], return_index=True, return_counts=True)
    seeds = rolled(doc, least)
    at = np.searchsorted(keys, seeds)
    at[at == len(keys)] = 0
    i = np.flatnonzero(keys[at] == seeds)
    n = count[at[i]]
    if n.sum() > LISTED * (len(doc) + len(item)):
        return None
    j = order[np.repeat(first[at[i]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    i = np.repeat(i, n)
    same = np.ones(len(i), dtype=bool)
    for k in range(least):  # the words themselves
        same &= doc[i + k] == item[j + k]
    i, j = i[same], j[same]
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    heads = np.flatnonzero(new)
    return np.diff(np.append(heads, len(i))) + least - 1, i[heads], j[heads]


def runs_of_diagonals(doc: np.ndarray, item: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """The same by comparing each diagonal as an array, for texts that repeat few words again and again."""
    doc, item, found = doc.astype(np.int32), item.astype(np.int32), []
    for d in range(least - len(item), len(doc) - least + 1):
        i, j = max(d, 0), max(-d, 0)
        n = min(len(doc) - i, len(item) - j)
        edges = np.concatenate([[-1], np.flatnonzero(doc[i : i + n] != item[j : j + n]), [n]])
        size = np.diff(edges) - 1
        if (long := np.flatnonzero(size >= least)).size:
            found.append((size[long], edges[long] + 1 + i, edges[long] + 1 + j))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, dtype=np.int64),) * 3


def tile(doc: np.ndarray, item: np.ndarray, min_match: int) -> int:
    """Words of the item that greedy string tiling covers by runs of at least ``min_match`` words (a shorter item by itself).

    All longest common runs are found first; they are tiles in the order of their lengths,
    and what longer tiles leave of a run waits its turn.
    """
    least = min(min_match, len(item))
    if not least or len(doc) < least:
        return 0
    runs = runs_of_seeds(doc, item, least) or runs_of_diagonals(doc, item, least)
    order = np.lexsort((runs[2], runs[1], -runs[0]))
    size, start, place = (x[order] for x in runs)
    free_doc, free_item = np.ones(len(doc), dtype=bool), np.ones(len(item), dtype=bool)
    covered = at = fruitless = 0
    pieces: list[tuple[int, int, int]] = []
    while covered < len(item) and (at < len(size) or pieces):
        if at < len(size) and (not pieces or (-size[at], start[at], place[at]) <= pieces[0]):
            n, i, j = int(size[at]), int(start[at]), int(place[at])
            at += 1
        else:
            n, i, j = heappop(pieces)
            n = -n
        free = free_doc[i : i + n] & free_item[j : j + n]
        if free.all():
            free_doc[i : i + n] = free_item[j : j + n] = False
            covered += n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
        left = [(a - b, i + a, j + a) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least]
        for x in left:
            heappush(pieces, x)
        fruitless += not left
        if fruitless > FRUITLESS:
            # Runs with too few free words on either side.
            words = [np.concatenate([[0], np.cumsum(x)]) for x in (free_doc, free_item)]
            size, start, place = size[at:], start[at:], place[at:]
            open_ = (words[0][start + size] - words[0][start] >= least) & (words[1][place + size] - words[1][place] >= least)
            size, start, place, at, fruitless = size[open_], start[open_], place[open_], 0, 0
    return covered


def coverages(bench: Benchmark, text: str | None, min_match: int, threshold: float) -> list[tuple[float, int]]:
    """(share of the item's words that tiles cover, item id) of the items that a text comes near to."""
    known = bench.words.get
    ids = np.fromiter((known(w, -1) for w in WORD.findall((text or "").lower())), dtype=np.int64)
    return [(tile(ids, bench.items[i], min_match) / len(bench.items[i]), bench.item_ids[i]) for i in bench.likely(ids, threshold)]


def shards(benchmark: DataFrame, id_col: str, text_col: str, chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in lists of about ``chars`` characters, each collected by itself."""
    rows = benchmark.select(benchmark[id_col].cast("long").alias("id"), benchmark[text_col].cast("string").alias("text")).dropna()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // chars))
    for k in range(parts):
        own = rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k) if parts > 1 else rows
        yield [(r["id"], r["text"]) for r in own.orderBy("id", "text").toLocalIterator()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = 3, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending) and coverage (of the item covered most, 0 if none comes near) of every row.

    Words are runs of letters, digits and underscores, lower-cased. Null and empty texts are
    clean; items without a word or id are skipped; an item shorter than ``min_match`` words
    must occur as a whole; repeated rows are judged alike, an item that occurs twice in the
    benchmark counts once; of tiles of one length the first in the document, then in the item,
    is laid first; texts of any length are read whole; other columns are ignored; an empty
    benchmark leaves all clean; an empty table gives no rows. A benchmark of several shards is
    taken shard by shard, and what was found goes along with the rows.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("coverage"), docs[text_col].alias("text"))

    def task(shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for batch in batches:
                found, share = [], []
                for known, most, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                    own = coverages(bench, text.as_py(), min_match, threshold)
                    found.append(sorted({*known, *(i for c, i in own if c >= threshold)}))
                    share.append(max([most, *(c for c, _ in own)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(share, pa.float64()), batch.column(3)], names=batch.schema.names)

        return run

    out = by_shard(rows, benchmark, min_match, shard_chars, task)
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "coverage")


def by_shard(rows: DataFrame, benchmark: DataFrame, min_match: int, chars: int, task: Callable) -> DataFrame:
    """Rows after the task of every shard; no more than one shard is broadcast at a time."""
    before = None
    for items in shards(benchmark, "item_id", "text", chars):
        if before is not None:
            rows = cut(rows)
            before.unpersist()
        before = rows.sparkSession.sparkContext.broadcast(Benchmark(items, min_match))
        rows = rows.mapInArrow(task(before), rows.schema)
    return rows


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = 3, threshold: float = 0.6, text_col: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; the same rules as ``decontaminate``. Nothing is shuffled."""
    at = docs.columns.index(text_col)

    def task(shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for batch in batches:
                keep = [not any(c >= threshold for c, _ in coverages(bench, t.as_py(), min_match, threshold)) for t in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    return by_shard(docs, benchmark, min_match, shard_chars, task)
