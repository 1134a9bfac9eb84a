"""Greedy string tiling against the plain algorithm."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from voxmeter.llm import decontam


def plain_tile(doc, item, least):
    """Again and again the longest common run of unmarked words, first in the document, then in the item."""
    least = min(least, len(item))
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and free_d[i + n] and free_i[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < max(1, least):
            return covered
        free_d[i : i + n] = [False] * n
        free_i[j : j + n] = [False] * n
        covered += n


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_tiles_are_the_plain_algorithms(least):
    rng = random.Random(least)
    for _ in range(300):
        item = [rng.randrange(rng.choice([2, 6, 30])) for _ in range(rng.randrange(1, 40))]
        doc = [rng.randrange(-1, 6) for _ in range(rng.randrange(0, 20))]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(len(item))
            doc[rng.randrange(len(doc) + 1) : 0] = item[a : a + rng.randrange(1, 25)]
        assert decontam.tile(np.array(doc, dtype=np.int64), np.array(item, dtype=np.int64), least) == plain_tile(doc, item, least), (doc, item)


@pytest.mark.parametrize(("listed", "fruitless"), [(0, 3), (10**9, 0), (1, 1)])
def test_tiles_of_repetitive_texts_are_the_plain_algorithms(monkeypatch, listed, fruitless):
    """Whether pairs of seeds are listed or diagonals are compared, and however early runs are left out."""
    monkeypatch.setattr(decontam, "LISTED", listed)
    monkeypatch.setattr(decontam, "FRUITLESS", fruitless)
    rng = random.Random(listed + fruitless)
    for _ in range(150):
        least = rng.choice([1, 2, 3])
        item = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(1, 30))]
        doc = [rng.randrange(-1, 2) for _ in range(rng.randrange(25))] + item[: rng.randrange(20)] * 2
        assert decontam.tile(np.array(doc, dtype=np.int64), np.array(item, dtype=np.int64), least) == plain_tile(doc, item, least), (doc, item)


@pytest.mark.parametrize("item", [[0] * 5000, [0, 1] * 2000, [0, 1, 2, 3, 4] * 800, ([0] * 50 + [7]) * 80])
def test_twenty_thousand_words_that_repeat_take_seconds(item):
    doc = np.array(([0, 1] if item[1] == 1 and item[2] == 0 else [0, 1, 2, 3, 4] if item[1] == 1 else [0]) * 20_000, dtype=np.int64)[:20_000]
    began = time.process_time()
    covered = decontam.tile(doc, np.array(item, dtype=np.int64), 3)
    assert covered == sum(x != 7 for x in item)
    # The last one has two million runs.
    assert time.process_time() - began < (40 if 7 in item else 4)


def test_rolled_hashes():
    rng = np.random.default_rng(1)
    x = rng.integers(-1, 5, 200)
    for n in (1, 2, 3, 17, 200):
        windows = [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]
        got = decontam.rolled(x, n).tolist()
        assert len(got) == len(windows) and len(set(got)) == len(set(windows)) == len(set(zip(got, windows, strict=True)))
        assert got == decontam.rolled(np.concatenate([x[:0], x]), n).tolist()
    # A window's hash does not depend on its place.
    assert decontam.rolled(x, 7)[50] == decontam.rolled(x[50:57], 7)[0]
    assert len(decontam.rolled(x[:3], 4)) == 0


@pytest.mark.parametrize("shard_chars", [60, 10**6])
def test_rows_against_brute_force(spark, docs_of, shard_chars):
    rng = random.Random(8)
    word = lambda: rng.choice("red blue green on off up down left right one two six".split())
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 25)))) for i in range(25)] + [(3, "red blue green on"), (90, None), (91, "..."), (None, "up down")]
    texts = [None, ""]
    for _ in range(60):
        own = [word() for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(3)):
            part = (rng.choice(items[:25])[1]).split(" ")
            half = len(part) // 2
            at = rng.randrange(len(own))
            own[at:at] = rng.choice([part, part[half:] + ["x"] + part[:half], part[:half]])
        texts.append(", ".join(own).title())
    known = {}
    kept = [(i, t.lower().split(" ")) for i, t in items if t and t != "..." and i is not None]
    number = lambda ws: [known.setdefault(w, len(known)) for w in ws]
    docs = docs_of(texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(docs.union(docs), bench, shard_chars=shard_chars).collect()}
    clean = [r.doc_id for r in decontam.clean(docs.union(docs), bench, shard_chars=shard_chars).collect()]
    found = 0
    for d, t in enumerate(texts):
        ids = number((t or "").lower().replace(",", "").split())
        share = [(plain_tile(ids, number(ws), 3) / len(ws), i) for i, ws in kept]
        want = sorted({i for c, i in share if c >= 0.6})
        found += bool(want)
        assert got[d].item_ids == want and got[d].contaminated == bool(want), (t, got[d], want)
        assert not want or got[d].coverage == pytest.approx(max(c for c, _ in share))
        assert clean.count(d) == (0 if want else 2)
    assert 5 < found < 60
