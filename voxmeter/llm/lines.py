"""Fuzzy line deduplication by MinHash.

Equal lines are one line from the start. Distinct lines get MinHash signatures of their
character shingles; bands of a signature deal them into buckets, and buckets of several
bands with the same lines are one group. A task compares the whole lines of a group by
exact Jaccard similarity and sends on only the links that connect the similar ones;
links become components. Of each component the first line is kept.

A bucket of over ``LIMIT`` lines goes another way: its lines are dealt out and each is
compared with one of them, the pivot. Lines linked to it are connected; only those that are
not are compared with the whole bucket, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmeter.functions.text import BLANKS
from voxmeter.llm.common import code_points, cut, runs, text_runs
from voxmeter.llm.components import Labels, connected_components, other_key

SHINGLE = 7
BANDS, ROWS = 12, 4
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**4)**12 = 0.998.
SEED = 42
CHUNK = 1_000_000
CACHED = 1 << 16
#: Numbers in a tile of a group's matrix, and lines in it at most.
TILE = 1 << 22
HEIGHT = 512
FILTER_BITS = 25
#: Lines of a group that one task compares.
LIMIT = 2048
#: Hashes of lines that a task remembers to have sent on.
SEEN = 1 << 20
_rng = np.random.default_rng(20240501)
FACTORS = _rng.integers(1 << 31, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
FLIPS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
STEP = np.uint64(0x9E3779B97F4A7C15)


def line_hash(line: str) -> int:
    """Equal to Spark's xxhash64(line)."""
    h = xxhash.xxh64_intdigest(line.encode(), SEED)
    return h - (1 << 64) if h >> 63 else h


def windows(cp: np.ndarray, size: int) -> np.ndarray:
    """The polynomial of each ``size`` code points, mod 2**64, from those of halves as long as there are such; in parts that stay in the processor's cache."""
    out = np.empty(max(0, len(cp) - size + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(out), CACHED):
            n = min(CACHED, len(out) - a)
            own, length = cp[a : a + n + size - 1].astype(np.uint64), 1
            h, done = np.zeros(n, dtype=np.uint64), 0
            # The binary digits of the size: ``own`` has windows of 1, 2, 4, ... code points.
            for bit in range(size.bit_length()):
                if size >> bit & 1:
                    # This window comes before what is done.
                    rest = size - done - length
                    part = own[rest : rest + n] if not done else own[rest : rest + n] * np.uint64(pow(int(STEP), done, 1 << 64))
                    h += part
                    done += length
                if done < size:
                    own = own[:-length] * np.uint64(pow(int(STEP), length, 1 << 64)) + own[length:]
                    length *= 2
            out[a : a + n] = h
    return out


def signatures(lines: list[str]) -> np.ndarray:
    """BANDS * ROWS least shingle hashes of each line; every line has at least SHINGLE characters."""
    cp, starts = code_points(lines)
    h = windows(cp, SHINGLE)
    n = len(h)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(29)
        h *= STEP
        h >>= np.uint64(32)
    inside = np.ones(len(cp), dtype=bool)
    for k in range(SHINGLE):
        inside[starts[1:] - 1 - k] = False
    shingles = h.astype(np.uint32)[inside[:n]]
    return least(shingles, np.diff(starts) - SHINGLE, FLIPS, FACTORS)


def least(shingles: np.ndarray, counts: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each permutation and each run of ``counts`` shingles the least permuted one; no run is empty."""
    out = np.empty((len(flips), len(counts)), dtype=np.uint32)
    for a, b in runs(counts.tolist(), CACHED):  # a part stays in the processor's cache for all permutations
        at = np.cumsum(counts[a:b]) - counts[a:b]
        first = int(counts[:a].sum())
        part = shingles[first : first + int(counts[a:b].sum())]
        room = np.empty_like(part)
        for j in range(len(flips)):
            np.bitwise_xor(part, flips[j], out=room)
            np.multiply(room, factors[j], out=room)
            out[j, a:b] = np.minimum.reduceat(room, at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and line, bands having keys of their own."""
    with np.errstate(over="ignore"):
        key = np.arange(len(sig) // ROWS, dtype=np.uint64)[:, None] * np.ones(sig.shape[1], dtype=np.uint64)
        for r in range(ROWS):
            key = (key * STEP) ^ sig[r::ROWS]
            key ^= key >> np.uint64(31)
        return key * STEP


def bands_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (key, h): the band keys of every line that is long enough to be similar but not equal to another, repeated ones mostly once a task."""
    seen: set[int] = set()
    for _, _, texts in (part for batch in batches for part in text_runs(batch.column(0), CHUNK)):
        distinct: dict[int, str] = {}
        for text in texts:
            for line in text.split("\n"):
                if len(line) >= SHINGLE and not line.isspace() and (k := line_hash(line)) not in seen:
                    distinct.setdefault(k, line)
        if len(seen) > SEEN:
            seen.clear()
        seen.update(distinct)
        h, lines = list(distinct), [x.lower() for x in distinct.values()]
        for a, b in runs([len(x) for x in lines], CHUNK):
            keys = band_keys(signatures(lines[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.array(h[a:b], dtype=np.int64), BANDS))], names=["key", "h"])


def bucket_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows sorted by their first column, as (bounds, *columns) of whole runs of it."""
    held = None
    for batch in batches:
        own = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        rows = own if held is None else tuple(map(np.concatenate, zip(held, own, strict=True)))
        if not len(rows[0]):
            continue
        starts = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1])
        held = tuple(c[starts[-1] :] for c in rows)
        if len(starts) > 1:
            yield starts, *(c[: starts[-1]] for c in rows)
    if held is not None:
        yield np.array([0, len(held[0])]), *held


def groups_task(limit: int):
    """Sorted (key, h) to (group, h, pivot) for the buckets of two and more lines.

    A group is named after its members, so that equal buckets of several bands are one
    group. The lines of a bucket of over ``limit`` are sent on as they come, with one of them
    as their pivot and the key as their group; no more than that many are held.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last run of a batch may go on: its key, its lines, and its pivot once it is large.
        held_key, held, pivot = 0, np.zeros(0, dtype=np.int64), None
        out: list[tuple] = []

        def bucket(key: int, own: np.ndarray) -> None:
            if len(own) > limit:
                out.append((key, own, own[0]))
            elif len(own) > 1:
                name = np.frombuffer(xxhash.xxh64(own.tobytes(), SEED).digest(), dtype=">i8")[0]
                out.append((name, own, None))

        for batch in batches:
            key, h = (c.to_numpy() for c in batch.columns)
            if pivot is not None:
                n = int(np.argmax(key != held_key)) if len(key) and key[-1] != held_key else len(key)
                more = np.unique(h[:n])
                out.append((held_key, more, pivot))
                key, h = key[n:], h[n:]
                if len(key):
                    pivot = None
            if len(key):
                if len(held):
                    key, h = np.concatenate([np.full(len(held), held_key, dtype=np.int64), key]), np.concatenate([held, h])
                starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
                size = np.diff(starts)
                for k in np.flatnonzero(size > 1).tolist():
                    bucket(key[starts[k]], np.unique(h[starts[k] : starts[k + 1]]))
                held_key, held = key[-1], np.unique(h[starts[-1] :])
                if len(held) > limit:
                    bucket(held_key, held)
                    pivot, held = held[0], held[:0]
            if out:
                yield grouped(out)
                out.clear()
        bucket(held_key, held)
        if out:
            yield grouped(out)

    return task


def grouped(rows: list[tuple]) -> pa.RecordBatch:
    names, members, pivots = zip(*rows, strict=True)
    sizes = [len(h) for h in members]
    small = np.repeat([p is None for p in pivots], sizes)
    pivot = pa.array(np.repeat(np.array([0 if p is None else p for p in pivots], dtype=np.int64), sizes), mask=small)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, dtype=np.int64), sizes)), pa.array(np.concatenate(members)), pivot], names=["group", "h", "pivot"])


def shingles(lines: list[str]) -> list[np.ndarray]:
    """Each line's distinct shingles as sorted 64-bit hashes."""
    cp, starts = code_points([x.lower() for x in lines])
    h = windows(cp, SHINGLE)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(29)
        h *= STEP
    return [np.unique(h[a : b - SHINGLE]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether the Jaccard similarity of two sets of shingles is at least the threshold."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < threshold * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return both >= threshold * (len(x) + len(y) - both)


def group_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Labels of a group's lines that exact Jaccard similarities link; sizes of intersections come from products of 0/1 matrices, a pair of tiles at a time."""
    labels, sizes = Labels(len(sets)), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle of one line is in no intersection.
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[place]
    owner, column = owner[keep], column[place[keep]]
    width = int(shared.sum())
    step = min(HEIGHT, max(16, TILE // max(1, width)))
    bounds = np.searchsorted(owner, np.arange(0, len(sets) + step, step))

    def tile(k: int) -> np.ndarray:
        rows = slice(bounds[k], bounds[k + 1])
        out = np.zeros((min(step, len(sets) - k * step), width), dtype=np.float32)
        out[owner[rows] - k * step, column[rows]] = 1
        return out

    for a in range(len(bounds) - 1):
        first = tile(a)
        for b in range(a, len(bounds) - 1):
            both = (first @ (first if a == b else tile(b)).T).astype(np.float64)
            n, m = sizes[a * step : a * step + both.shape[0], None], sizes[None, b * step : b * step + both.shape[1]]
            near = both >= np.maximum(threshold * (n + m - both), 1)
            for i in np.flatnonzero(near.any(1)).tolist():
                labels.link(np.append(np.flatnonzero(near[i]) + b * step, i + a * step))
    return labels.of


def sets_of_lines(text: list[str]) -> list[np.ndarray]:
    return [x for a, b in runs([len(x) for x in text], CHUNK) for x in shingles(text[a:b])]


def links_task(threshold: float, sets_of=sets_of_lines):
    """Sorted (group, h, line) to links (a, b) of hashes that connect the similar lines of each group; ``sets_of`` reads the third column."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, _, h, value in bucket_runs(batches):
            distinct, at = np.unique(h, return_index=True)
            sets = dict(zip(distinct.tolist(), sets_of([value[i] for i in at.tolist()]), strict=True))
            links = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = h[s:e].tolist()
                if e - s == 2:
                    if similar(sets[own[0]], sets[own[1]], threshold):
                        links.append(own)
                else:
                    of = group_links([sets[x] for x in own], threshold)
                    links += [(own[i], own[of[i]]) for i in np.flatnonzero(of != np.arange(e - s)).tolist()]
            if links:
                x, y = np.array(links, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return task


def pivots_task(threshold: float, sets_of=sets_of_lines):
    """(h, pivot, value, pivot's value) to (h, pivot, near)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            near = np.zeros(batch.num_rows, dtype=bool)
            for k in range(0, batch.num_rows, LIMIT):
                part = batch.slice(k, LIMIT)
                pivots = part.column(1).to_pylist()
                for i, x in enumerate(sets_of(part.column(2).to_pylist())):
                    if pivots[i] != last:
                        last, own = pivots[i], sets_of([part.column(3)[i].as_py()])[0]
                    near[k + i] = similar(x, own, threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(near)], names=["h", "pivot", "near"])

    return task


def bucket_links(bands: DataFrame, values_of, threshold: float, sets_of=sets_of_lines, limit: int = LIMIT) -> DataFrame:
    """(a, b): links that connect all h of a bucket (key, h) whose sets are similar.

    ``values_of`` gives (h, value) of the wanted (h), and ``sets_of`` sets of values.
    """
    groups = cut(bands.repartition("key").sortWithinPartitions("key").mapInArrow(groups_task(limit), "group long, h long, pivot long").distinct())
    values = values_of(groups.select("h").distinct()).toDF("h", "value")
    small, large = groups.where("pivot IS NULL").select("group", "h"), groups.where("pivot != h")
    found = []
    if not large.isEmpty():
        values = cut(values)
        # A line meets a pivot once, however many buckets they share. Rows are dealt by line, and again by pivot with the hot ones split by Spark.
        pivot = values.select(other_key("h").alias("k"), F.col("value").alias("pivot_value"))
        met = large.select("h", "pivot").distinct().join(values, "h").withColumn("k", other_key("pivot")).join(pivot, "k")
        met = cut(met.select("h", "pivot", "value", "pivot_value").mapInArrow(pivots_task(threshold, sets_of), "h long, pivot long, near boolean"))
        found.append(met.where("near").select(F.col("h").alias("a"), F.col("pivot").alias("b")))
        near = large.join(met, ["h", "pivot"])
        # Lines that their pivot is not similar to meet the whole bucket: blocks of them with blocks of all.
        sizes = near.groupBy("group").agg(F.ceil(F.count_if(~F.col("near")) / limit).cast("int").alias("blocks"), F.ceil((F.count("*") + 1) / limit).cast("int").alias("turns"), F.first("pivot").alias("pivot")).where("blocks > 0")
        salted = lambda n, salt: F.pmod(F.xxhash64("h", F.lit(salt)), F.col(n)).cast("int")
        rest = near.select("group", "h", "near").join(sizes.drop("pivot"), "group").unionByName(sizes.select("group", F.col("pivot").alias("h"), F.lit(True).alias("near"), "blocks", "turns"))
        own = rest.where("NOT near").select("group", "h", salted("blocks", 1).alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
        all_of = rest.select("group", "h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), salted("turns", 2).alias("turn"))
        small = small.unionByName(own.unionByName(all_of).select(F.xxhash64("group", "block", "turn").alias("group"), "h").distinct())
    rows = small.join(values, "h").select("group", "h", "value").repartition("group").sortWithinPartitions("group")
    found.append(rows.mapInArrow(links_task(threshold, sets_of), "a long, b long"))
    return reduce(DataFrame.unionByName, found)


def membership(hashes: DataFrame, column: str) -> np.ndarray:
    """A filter of 2**FILTER_BITS bits over a column of hashes, in bytes: 4 MB whatever the number of hashes. A set bit says maybe, a clear one no."""
    place = F.pmod(F.col(column), F.lit(1 << FILTER_BITS)).cast("long")
    rows = hashes.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8 + (1 << 12) * 2, dtype=np.uint8)
    for r in rows.toLocalIterator():  # at most 1025 rows of 4 kB
        # Bucket n holds the values 32768 * (n - 1) + 1 to 32768 * n; bit 0 is the first of them.
        at = ((r["bucket"] - 1) * 32768 + 32768) // 8
        out[at : at + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def maybe_in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = np.mod(h, 1 << FILTER_BITS) + 32767
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def texts_of(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(h, line) of the wanted hashes, each once. Only lines that may be wanted are shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(membership(wanted, "h"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in (part for batch in batches for part in text_runs(batch.column(0), CHUNK)):
            distinct: dict[int, str] = {}
            for text in texts:
                for line in text.split("\n"):
                    if len(line) >= SHINGLE and not line.isspace():
                        distinct.setdefault(line_hash(line), line)
            h = np.fromiter(distinct, dtype=np.int64, count=len(distinct))
            hit = np.flatnonzero(maybe_in(shared.value, h))
            lines = list(distinct.values())
            yield pa.RecordBatch.from_arrays([pa.array(h[hit]), pa.array([lines[i] for i in hit.tolist()], pa.string())], names=["h", "line"])

    return docs.select(text_col).mapInArrow(task, "h long, line string").join(wanted, "h", "left_semi").groupBy("h").agg(F.min("line").alias("line"))


def similar_lines(docs: DataFrame, text_col: str, threshold: float, limit: int = LIMIT) -> DataFrame:
    """(node, component) of the hashes of lines that are similar to another, not equal one."""
    bands = docs.select(text_col).mapInArrow(bands_task, "key long, h long")
    return connected_components(bucket_links(bands, lambda wanted: texts_of(docs, text_col, wanted), threshold, limit=limit))


def dedup_lines(docs: DataFrame, threshold: float = 0.8, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the text's repeated lines taken out, and n_lines, n_removed.

    Lines are the parts between newlines. Equal lines, and lines whose sets of lower-cased
    7-character shingles have a Jaccard similarity of at least ``threshold``, are linked; of
    each component the line first by id and place stays. Blank lines are neither compared nor
    taken out; lines shorter than a shingle are compared whole. A text that loses all its
    lines becomes empty; null texts stay null with 0 lines; rows without an id stay as they
    are; rows that share an id are one document and change alike; other columns are kept; an
    empty table gives no rows. Equal lines are told by two hashes, of 64 and of 32 bits;
    lines that one of them takes for equal and the other does not all stay.
    """
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.col("__id").isNotNull())
    # A line with any character that is not white space, as str.isspace in the tasks above has it; the test for equality is theirs too.
    place = cut(own.select("__id", F.posexplode(F.split("__text", "\n", -1)).alias("__no", "__line")).where(F.ltrim("__line", F.lit(BLANKS)) != "").select("__id", "__no", F.xxhash64("__line").alias("h"), F.hash("__line").alias("h2")))
    found = similar_lines(own, "__text", threshold, limit)
    # Lines of one 64-bit hash that differ in the other one are different lines: they are left as they are.
    heads = place.groupBy("h").agg(F.min(F.struct("__id", "__no")).alias("first"), F.count("*").alias("n"), F.min("h2").alias("low"), F.max("h2").alias("high")).where("low = high")
    heads = heads.join(found, heads["h"] == found["node"], "left").select("h", "first", "n", F.coalesce("component", "h").alias("component"))
    groups = heads.groupBy("component").agg(F.min("first").alias("keeper"), F.sum("n").alias("total")).where("total > 1")
    repeated = cut(heads.select("h", "component").join(groups, "component").select("h", "keeper"))
    # Names that the table does not have.
    tid, gone_of = (next(x for x in (f"__{name}{k}" for k in range(len(docs.columns) + 1)) if x not in docs.columns) for name in ("id", "gone"))
    gone = place.join(repeated, "h").where(F.struct("__id", "__no") != F.col("keeper")).groupBy(F.col("__id").alias(tid)).agg(F.collect_set("__no").alias(gone_of))
    left = docs.join(gone, docs[id_col] == gone[tid], "left")
    # The parts are made once for each text, and those that stay are taken by their places.
    lines = F.split(F.col(text_col), "\n", -1)
    stay = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone_of)), lambda i: F.get(x, i)), "\n")
    kept = F.element_at(F.transform(F.array(lines), stay), 1)
    return left.withColumns({"n_lines": F.coalesce(F.size(lines), F.lit(0)), "n_removed": F.coalesce(F.size(gone_of), F.lit(0)), text_col: F.when(F.col(gone_of).isNull(), F.col(text_col)).otherwise(kept)}).drop(tid, gone_of)
