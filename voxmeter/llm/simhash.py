"""SimHash near-duplicates through BK-trees.

Equal fingerprints become one class first. Of ``radius`` + 1 blocks of bits, two classes
within ``radius`` bits agree in at least one, so classes are dealt into shards by each block:
every link lies within a shard. A shard of over ``LIMIT`` classes is dealt again by blocks
of its other bits, so none stays large. In its shard each class goes down a BK-tree, kept
as arrays of edges, children keyed by integer Hamming distance to their parent, along the
edges within the radius. A shard sends on only the links that connect it; components are
found over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmeter.llm.common import cut
from voxmeter.llm.components import connected_components, stars

BITS = 64
SEED = 42
PART = 1 << 16
#: Classes of a shard; larger ones are dealt again.
LIMIT = 4096
#: Places of queries in trees at once.
FRONT = 1 << 21


def fingerprint(text: str | None, n_words: int) -> int:
    """Unsigned 64-bit fingerprint: each bit set in over half the XXH64 of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space \x20 and \x09-\x0D
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n_words:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - n_words + 1].tolist(), ends[n_words - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(words) - n_words + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), PART):
        ones += np.unpackbits(h[k : k + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), n_words) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col]).mapInArrow(task, "doc_id long, fp long")


def split(free: int, n: int) -> list[int]:
    """Masks of n blocks of as many bits each, up to one, of the free bits."""
    bits = [1 << k for k in range(BITS) if free >> k & 1]
    return [sum(bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


class Trees:
    """BK-trees of all shards of ``fp``, rows of a shard in a row; ``root`` is each row's shard's first one."""

    def __init__(self, fp: np.ndarray, root: np.ndarray):
        self.fp, self.root = fp, root
        at, rest = root.copy(), np.flatnonzero(root != np.arange(len(fp)))
        edges, children = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        while len(rest):
            # All rows go down a step together; the first one at a new edge becomes the node there.
            edge = at[rest] * (BITS + 1) + np.bitwise_count(fp[rest] ^ fp[at[rest]])
            edge, new, of = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(edge)
            children.append(rest[new])
            at[rest] = rest[new][of]
            rest = np.delete(rest, new)
        edge, child = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], child[order]

    def links(self, radius: int, widest: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows that connect all rows of a shard within the radius of each other."""
        a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        step = max(16, FRONT // max(1, widest))
        for k in range(0, len(self.fp), step):
            row = np.arange(k, min(k + step, len(self.fp)))
            node = self.root[row]
            while len(row):
                far = np.bitwise_count(self.fp[row] ^ self.fp[node]).astype(np.int64)
                near = (far <= radius) & (row != node)
                if near.any():
                    a, b = stars(np.concatenate([a, row[near]]), np.concatenate([b, node[near]]))
                below = []
                for e in range(-radius, radius + 1):
                    key = node * (BITS + 1) + far + e
                    at = np.searchsorted(self.edge, key)
                    at[at == len(self.edge)] = 0
                    hit = (far + e > 0) & (far + e <= BITS) & (self.edge[at] == key) if len(self.edge) else np.zeros(len(key), dtype=bool)
                    below.append((row[hit], self.child[at[hit]]))
                row, node = (np.concatenate(x) for x in zip(*below, strict=True))
        return a, b


def shard_task(radius: int):
    """Rows (mask, key, fp, rep), sorted by mask and key, to links (a, b) of reps."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def links(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            mask, key, fp, rep = rows
            new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(fp)))
            # A class alone in its shard has no one to meet.
            some = np.repeat(sizes > 1, sizes)
            fp, rep, sizes = fp[some], rep[some], sizes[sizes > 1]
            a, b = Trees(fp, np.repeat(np.cumsum(sizes) - sizes, sizes)).links(radius, int(sizes.max(initial=0)))
            return pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            size += batch.num_rows
            if size >= PART:
                rows = tuple(map(np.concatenate, zip(*held, strict=True)))
                # The last shard may go on.
                last = int(np.flatnonzero(np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])))[-1])
                if last:
                    yield links(tuple(c[:last] for c in rows))
                held, size = [tuple(c[last:] for c in rows)], len(rows[0]) - last
        if size:
            yield links(tuple(map(np.concatenate, zip(*held, strict=True))))

    return task


def deal_task(n: int):
    """(mask, fp, rep) to a row for each of n blocks of the bits outside the mask: the mask with the block, the fingerprint's bits in it, fp and rep."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, fp, rep = (c.to_numpy() for c in batch.columns)
            for m in np.unique(mask).tolist():
                own = mask == m
                for block in split(~m & ((1 << BITS) - 1), n):
                    more = np.array(signed((m & ((1 << BITS) - 1)) | block))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(own.sum(), more), fp[own] & more, fp[own], rep[own])], names=["mask", "key", "fp", "rep"])

    return task


def tree_links(classes: DataFrame, radius: int, limit: int = LIMIT) -> DataFrame:
    """(a, b): links that connect the reps of all classes (fp, rep) within ``radius`` bits."""
    rows, out, fixed = classes.select(F.lit(0).cast("long").alias("mask"), "fp", "rep"), [], 0
    while True:
        shards = rows.mapInArrow(deal_task(radius + 1), "mask long, key long, fp long, rep long")
        fixed += (BITS - fixed) // (radius + 1)
        hot = cut(shards.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("mask", "key"))
        # Shards of a few free bits are small.
        last = BITS - fixed < 8 or hot.isEmpty()
        small = shards if last else shards.join(hot, ["mask", "key"], "left_anti").select("mask", "key", "fp", "rep")
        out.append(small.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(shard_task(radius), "a long, b long"))
        if last:
            return reduce(DataFrame.unionByName, out)
        rows = cut(shards.join(hot, ["mask", "key"], "left_semi").select("mask", "fp", "rep"))


def components_of(fps: DataFrame, radius: int) -> DataFrame:
    """(doc_id, fp) rows to those columns and component_id."""
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(tree_links(classes.dropna(), radius))
    component = classes.join(found, classes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(component, "fp")


def near_duplicates(docs: DataFrame, n_words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Texts are read whole; null texts, like texts without a word, have the fingerprint zero and
    are linked like any other; texts with fewer than ``n_words`` words have one shingle;
    repeated rows are all kept and share a component; a null id is linked to by no one and
    its component is that of its fingerprint (null if no other row has it); other columns are
    ignored; an empty table gives no rows.
    """
    fps = cut(fingerprints(docs, n_words, id_col, text_col))
    return components_of(fps, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
