"""SimHash, embeddings, lines and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxmeter.llm import components, embeddings, lines, simhash
from voxmeter.llm.common import xxh64_longs


def union(n, links):
    of = list(range(n))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_hash_equals_sparks(spark):
    x = np.array([0, 1, -1, 2**62, -(2**63)], dtype=np.int64)
    got = [r[0] for r in spark.createDataFrame([(int(v),) for v in x], "v long").select(F.xxhash64("v")).collect()]
    assert xxh64_longs(x.view(np.uint64)).view(np.int64).tolist() == got


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(400, 600)] + [(5, 5)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long").repartition(7)
    want = union(601, links)
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {x: want[x] for x in {v for a, b in links if a != b for v in (a, b)}}
    assert components.connected_components(df.limit(0)).count() == 0


def plain_fingerprint(text, n_words):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n_words]), 42) for i in range(max(1, len(words) - n_words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_tree_links_are_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 12, (300, 3), dtype=np.uint64)
    values = np.unique(base[rng.integers(0, 6, 300)] ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
    links = [(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 2]
    found = simhash.Trees(values, np.zeros(len(values), dtype=np.int64)).links(2, len(values))
    assert union(len(values), zip(*found, strict=True)) == union(len(values), links)
    # Every child hangs on its parent by their distance, and every value but the root hangs once.
    tree = simhash.Trees(values, np.zeros(len(values), dtype=np.int64))
    parent, edge = np.divmod(tree.edge, 65)
    assert sorted(tree.child.tolist()) == list(range(1, len(values)))
    assert np.array_equal(np.bitwise_count(values[tree.child] ^ values[parent]), edge)


@pytest.mark.parametrize("limit, radius", [(10, 1), (20, 2), (20, 3), (4096, 2)])
def test_large_shards_are_dealt_again(spark, limit, radius):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    # Families around five values, all of which share their upper bits with many.
    flips = np.uint64(1) << rng.integers(0, 40, (250, 2), dtype=np.uint64)
    values = np.unique((base[rng.integers(0, 5, 250)] & np.uint64(0xFFFFFFFFFF)) ^ flips[:, 0] ^ flips[:, 1])
    links = [(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= radius]
    df = spark.createDataFrame([(int(v), i) for i, v in enumerate(values.view(np.int64))], "fp long, rep long")
    got = simhash.tree_links(df, radius, limit).collect()
    assert union(len(values), [(r.a, r.b) for r in got]) == union(len(values), links)


def test_simhash(spark, docs_of):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "ONE", "a b", "A  b", "É b", "é b"]
    for _ in range(15):
        words = [rng.choice("red blue green on off up down left right".split()) for _ in range(rng.randrange(3, 400))]
        texts += [" ".join(words), " ".join([*words, "x"]), "  ".join(words).upper(), " ".join(words[:-1])]
    df = docs_of(texts)
    rows = {r.doc_id: r for r in simhash.near_duplicates(df.union(df)).collect()}
    fps = [plain_fingerprint(t, 3) for t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = union(len(fps), links)
    assert [rows[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [rows[i].component_id for i in range(len(texts))] == want
    assert simhash.near_duplicates(df).count() == len(texts)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "one"), (4, "one"), (None, "q")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in simhash.near_duplicates(null).collect()) == ["4", "4", "None"]


@pytest.mark.parametrize("block", [16, 2048])
def test_embeddings(spark, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 8))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 8)) * 0.08, base[:5], base[:5] * 3, base[70] + rng.normal(size=(80, 8)) * 0.05])
    odd = [None, [0.0] * 8, [float("nan")] * 8, [1.0, None] * 4, [1.0, 2.0], [1.0, 2.0], [float("inf")] * 8]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000 + i, v, 2) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int").repartition(5)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, block=block).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = union(len(x), zip(*np.nonzero(near), strict=True))
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(len(x))] == want
    assert [got[i].kept for i in range(len(x))] == [i == c for i, c in enumerate(want)]
    assert [got[1000 + i].n_links for i in range(7)] == [0, 0, 0, 0, 1, 1, 0]
    assert [got[1000 + i].component_id for i in range(7)] == [1000, 1001, 1002, 1003, 1004, 1004, 1006]


def test_embeddings_without_vectors(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embeddings.near_duplicates(df).collect()] == [(1, 0, 1, True)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def plain_lines(texts, threshold=0.8):
    shingle = lambda s: {s[i : i + 7] for i in range(len(s) - 6)}
    places = [(d, i, x) for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if x.strip()]
    distinct = list(dict.fromkeys(x for _, _, x in places))
    sets = [shingle(x.lower()) for x in distinct]
    links = [(i, j) for i in range(len(distinct)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    of = dict(zip(distinct, union(len(distinct), links), strict=True))
    first = {}
    for d, i, x in places:
        first.setdefault(of[x], (d, i))
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not x.strip() or first[of[x]] == (d, i)) for d, t in enumerate(texts)]


@pytest.mark.parametrize("limit", [6, 1024])
def test_lines(spark, docs_of, limit):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    pool = [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    family = [pool[0] + " and more of it " + pool[1]]
    for _ in range(30):  # near copies of near copies
        parts = rng.choice(family).split(" ")
        parts[rng.randrange(len(parts))] = word()
        family.append(" ".join(parts))
    texts = ["\n".join(rng.choice(pool + family + ["", "  ", "x", "short"]) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    texts += [None, "", "\n\n", pool[3].upper(), "y" * 20_000, "y" * 20_001]
    got = {r.doc_id: r for r in lines.dedup_lines(docs_of(texts), limit=limit).collect()}
    want = plain_lines(texts)
    assert [got[i].text for i in range(len(texts))] == want
    assert got[len(texts) - 6].n_lines == 0 and got[0].node == "x"
    assert all((r.n_removed == 0) == (r.text == texts[r.doc_id]) for r in got.values())


def test_lines_of_nothing(spark, docs_of):
    assert lines.dedup_lines(docs_of(["a"]).limit(0)).count() == 0
    df = spark.createDataFrame([(None, "same line here"), (2, "same line here"), (3, "same line here")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in lines.dedup_lines(df).collect()) == [("2", "same line here"), ("3", ""), ("None", "same line here")]


def test_a_text_of_many_equal_lines(spark, docs_of):
    """The rebuilt text takes time in proportion to its lines."""
    rows = lines.dedup_lines(docs_of(["same line of text\n" * 200_000 + "last one", "\n".join(f"{i} lines" for i in range(20))])).orderBy("doc_id").collect()
    assert rows[0].text == "same line of text\nlast one" and rows[0].n_removed == 199_999


def test_hot_groups_are_split(spark):
    """What one task gets of a bucket of similar lines is bounded, and lines that differ from the pivot are compared with all."""
    bands = spark.createDataFrame([(1, h) for h in range(3000)] + [(2, 5), (2, 6)], "key long, h long").repartition(3)
    rows = bands.repartition("key").sortWithinPartitions("key").mapInArrow(lines.groups_task(100), "group long, h long, pivot long").distinct().toPandas()
    large, small = rows[rows["pivot"].notna()], rows[rows["pivot"].isna()]
    assert sorted(large["h"]) == list(range(3000)) and large["pivot"].nunique() == 1 and sorted(small["h"]) == [5, 6]
    # Ten similar families in one bucket: all but one of them differ from the pivot.
    values = spark.createDataFrame([(h, [1000 * (h % 10) + k for k in range(50)] + [10**6 + h]) for h in range(600)], "h long, value array<long>")
    links = lines.bucket_links(bands.where("h < 600"), lambda wanted: values.join(wanted, "h", "left_semi"), 0.8, lambda v: [np.array(x) for x in v], limit=50).collect()
    assert union(600, [(r.a, r.b) for r in links]) == [h % 10 for h in range(600)]


def test_lines_of_any_white_space_are_blank(docs_of):
    """Separators count as blank in both tests, so such lines stay wherever they repeat."""
    texts = ["some words of a line\n\x1c\x1f  \x85\n\x1c\x1f  \x85", "\x1c\x1f  \x85\nanother line of words", "\x1c\x1f  \x85x\n\x1c\x1f  \x85x"]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(docs_of(texts)).collect()}
    assert got == {0: (texts[0], 0), 1: (texts[1], 0), 2: ("\x1c\x1f  \x85x", 1)}
