"""Embedding near-duplicates by spherical k-means cells.

Equal vectors become one class. Centroids are fitted on a bounded sample; every class
belongs to the cell of its nearest centroid and also visits each cell whose border with
its own it is near to. A cell's members are compared with its visitors and with each other
by blocked cosine products. A large cell is dealt into blocks of members and of visitors,
so no task gets all of it. Blocks send on counts of links and the links that connect them,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmeter.llm.common import cut, least_hashed
from voxmeter.llm.components import Labels, connected_components

#: Vectors that the driver fits centroids on, at most: those with the smallest hashed ids.
FIT_ROWS = 20_000
MAX_CELLS = 4096
BLOCK = 2048


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # A very small or large vector is scaled first, lest its squares vanish or overflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of unit vectors; the first ones are spread evenly over the rows. An empty cell keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        home = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.sqrt((sums * sums).sum(1))
        good = norm > 1e-9
        c[good] = sums[good] / norm[good, None]
    return c


def border(x: np.ndarray, c: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Signed distance of each vector to the border between its home and each cell; 0 at home."""
    sims = x @ c.T
    own = sims[np.arange(len(x)), home][:, None]
    gaps = np.sqrt(np.maximum(2 - 2 * c[home] @ c.T, 1e-18))
    return np.where(np.arange(len(c)) == home[:, None], 0.0, (own - sims) / gaps)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def cells_task(shared, dim: int, reach: float):
    """Classes to rows (cell, home, visitor, rep, copies, vec): one for the home cell and one per visited cell."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                x = unit(matrix(part.column(2), dim))
                home = np.argmax(x @ c.T, axis=1)
                row, cell = np.nonzero(border(x, c, home) <= reach)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(home[row].astype(np.int32)), *(part.column(i).take(pa.array(row)) for i in range(3))], names=["cell", "home", "rep", "copies", "vec"])

    return task


def compare(c: np.ndarray, cell: int, members: tuple, visitors: tuple, threshold: float, reach: float, out: list) -> None:
    """Links between a block of a cell's members and a block of its visitors (members again among them)."""
    rep, copies, x = members
    v_home, v_rep, v_copies, v = visitors
    own_links, links = np.zeros(len(rep), dtype=np.int64), np.zeros(len(v_rep), dtype=np.int64)
    labels = Labels(len(rep) + len(v_rep))
    for k in range(0, len(v_rep), 512):
        near = x @ v[k : k + 512].T >= threshold
        near &= rep[:, None] != v_rep[None, k : k + 512]
        i, j = np.nonzero(near)
        if not len(i):
            continue
        j = j + k
        # A pair with two homes is counted in the lower-numbered cell that both come to.
        away = v_home[j] != cell
        lower = away & (v_home[j] < cell)
        if lower.any():
            a, b = i[lower], v_home[j[lower]]
            distance = (x[a] * (c[cell] - c[b])).sum(1) / np.sqrt(np.maximum(((c[cell] - c[b]) ** 2).sum(1), 1e-18))
            counted = np.ones(len(i), dtype=bool)
            counted[np.flatnonzero(lower)[distance <= reach]] = False
            i, j, away = i[counted], j[counted], away[counted]
        np.add.at(links, j, copies[i])
        np.add.at(own_links, i[away], v_copies[j[away]])
        order = np.argsort(j, kind="stable")
        i, j = i[order], j[order]
        for group in np.split(np.arange(len(j)), np.flatnonzero(np.diff(j)) + 1):
            if len(group):
                labels.link(np.append(i[group], len(rep) + j[group[0]]))
    ids = np.concatenate([rep, v_rep])
    total = np.concatenate([own_links, links])
    root = ids[labels.of]
    # A label's representative is its first thing; the same class may stand on both sides.
    keep = (total > 0) | (root != ids)
    out.append((ids[keep], root[keep], total[keep]))


def links_task(shared, dim: int, threshold: float, reach: float):
    """Rows (cell, block, turn, role, home, rep, copies, vec) sorted by their first four columns to (a, b, n)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        key, members, visitors, out = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal members, visitors, out
            if members and visitors:
                m, v = (tuple(map(np.concatenate, zip(*side, strict=True))) for side in (members, visitors))
                compare(c, key[0], m[1:], v, threshold, reach, out)
            members, visitors = [], []
            if out:
                cols, out = tuple(map(np.concatenate, zip(*out, strict=True))), []
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["a", "b", "n"])

        for batch in batches:
            cell, block, turn, role, home, rep, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            x = unit(matrix(batch.column(7), dim)) if batch.num_rows else None
            changes = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(turn) != 0) | (np.diff(role) != 0)) + 1
            for rows in np.split(np.arange(batch.num_rows), changes):
                if not len(rows):
                    continue
                a = rows[0]
                if (cell[a], block[a], turn[a]) != key:
                    yield from done()
                    key = (int(cell[a]), int(block[a]), int(turn[a]))
                (visitors if role[a] else members).append((home[rows], rep[rows], copies[rows], x[rows]))
        yield from done()

    return task


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Cosines are taken in double precision. Vectors that are null, zero or hold a null or
    non-finite component link with nothing; vectors of another length than the commonest link
    only with equal ones. Repeated rows link with each other; null ids link with nothing and
    have null components; other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col("vec")
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    # -0.0 and 0.0 are one number.
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), F.transform(vectors[vec_col].cast("array<double>"), lambda e: F.when(e == 0, F.lit(0.0)).otherwise(e)).alias("vec")).withColumn("vec", F.when(F.col("vec_id").isNotNull() & whole, v))
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # Equal vectors are told by 128 bits of hash, so that rows find their class without their vectors.
    good = rows.where(v.isNotNull()).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64("vec", F.lit(1))})
    classes = cut(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")))
    common = classes.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return alone(rows)
    dim, n = common
    own = classes.where(F.size("vec") == dim).select("rep", "copies", "vec")
    sample = least_hashed(own, "rep", FIT_ROWS, n).select("vec").toArrow().column(0).combine_chunks()
    x = unit(matrix(sample, dim))
    k = max(1, min(MAX_CELLS, len(x) // 4, round(n**0.5 / 2)))
    centroids = spherical_kmeans(x, k)
    # Of two linked vectors with two homes, on both sides of the border, one is at most half their distance from it.
    reach = float(np.sqrt(max(0.0, (1 - threshold) / 2))) + 1e-9
    shared = spark.sparkContext.broadcast(centroids)
    placed = own.mapInArrow(cells_task(shared, dim, reach), "cell int, home int, rep long, copies long, vec array<double>")
    # At most MAX_CELLS rows.
    sizes = placed.groupBy("cell").agg(F.ceil(F.count_if(F.col("cell") == F.col("home")) / block).cast("int").alias("blocks"), F.ceil(F.count("*") / block).cast("int").alias("turns"))
    placed = placed.join(F.broadcast(sizes.where("blocks > 0")), "cell")
    part = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    # A member's row goes to its own block for every turn, a visitor's to its own turn for every block; members visit their cell too.
    members = placed.where(F.col("cell") == F.col("home")).select("cell", part("blocks", 1).alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(0).alias("role"), "home", "rep", "copies", "vec")
    visitors = placed.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part("turns", 2).alias("turn"), F.lit(1).alias("role"), "home", "rep", "copies", "vec")
    blocks = members.unionByName(visitors).repartition("cell", "block", "turn").sortWithinPartitions("cell", "block", "turn", "role")
    links = cut(blocks.mapInArrow(links_task(shared, dim, threshold, reach), "a long, b long, n long"))
    found = connected_components(links.select("a", "b"))
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    known = classes.drop("vec").join(counts, "rep", "left").join(found, F.col("rep") == F.col("node"), "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id", (F.col("component_id") == F.col("vec_id")).alias("kept"))
    return linked.unionByName(alone(rows.where(v.isNull())))
