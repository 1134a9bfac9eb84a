"""Periodic runs against plain loops, and the query against the contract read word by word."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmeter.llm import periodic, queries


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q) and not any(all(words[x] == words[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words: list, runs: list) -> list:
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def pieces(rnd: random.Random, longest: int) -> list[str]:
    """Words in which short stretches come again and again, in part cut off."""
    out = []
    for _ in range(rnd.randint(0, 6)):
        unit = [rnd.choice("ab" if rnd.random() < 0.5 else "abcdefgh") for _ in range(rnd.randint(1, longest))]
        out += (unit * rnd.randint(1, 8))[: rnd.randint(1, 7 * longest)]
    return out


@pytest.mark.parametrize(("whole", "longest"), [(1 << 15, 9), (4, 25), (1, 7)])
def test_runs_are_those_of_plain_loops(monkeypatch, whole, longest):
    """Also where blocks are longer than what is transformed at once."""
    monkeypatch.setattr(periodic, "WHOLE", whole)
    rnd = random.Random(whole)
    for _ in range(60):
        docs = [pieces(rnd, longest) for _ in range(rnd.randint(1, 6))]
        for words, (n, runs, left) in zip(docs, periodic.search([" ".join(d).encode() for d in docs]), strict=True):
            expected = plain_runs(words)
            assert n == len(words)
            assert [(r["start"], r["length"], r["period"]) for r in runs] == expected
            assert left.split() == kept(words, expected)


def test_chance_agreements_do_not_hide_runs(monkeypatch):
    """All words have few residues and hashes, so blocks and extensions agree by chance all the time."""
    monkeypatch.setattr(periodic, "HASH_PRIME", 5)
    rnd = random.Random(3)
    real = periodic.occurrences
    monkeypatch.setattr(periodic, "occurrences", lambda values, scale: real(values % 3, scale))
    for _ in range(80):
        docs = [pieces(rnd, 8) for _ in range(3)]
        got = [[(r["start"], r["length"], r["period"]) for r in runs] for _, runs, _ in periodic.search([" ".join(d).encode() for d in docs])]
        assert got == [plain_runs(d) for d in docs]


def test_transforms_are_exact():
    rng = np.random.default_rng(1)
    for n in (1, 2, 8, 1 << 10, 1 << 16):
        x = rng.integers(0, periodic.PRIME, (n, 2))
        back = periodic.transform(periodic.transform(x) % periodic.PRIME, inverse=True) * pow(n, -1, periodic.PRIME) % periodic.PRIME
        assert (back == x).all()
    a, b = rng.integers(0, periodic.PRIME, (2, 4))
    root = pow(3, (periodic.PRIME - 1) // 4, periodic.PRIME)
    plain = [sum(int(v) * pow(root, i * k, periodic.PRIME) for i, v in enumerate(a)) % periodic.PRIME for k in range(4)]
    assert (periodic.transform(a[:, None])[:, 0] % periodic.PRIME).tolist() == plain
    assert (b >= 0).all()


def test_long_repetitive_texts_in_bearable_time():
    began = time.process_time()
    same, period = list(periodic.search([b"a " * 60_000, b"x y z w v " * 12_000]))
    assert (same[1], period[1]) == ([{"start": 0, "length": 60_000, "period": 1}], [{"start": 0, "length": 60_000, "period": 5}])
    assert (same[2], period[2]) == ("a", "x y z w v")
    assert time.process_time() - began < 30


def test_odd_rows(spark, docs_of):
    texts = [None, "", " \t\n", "a a a a a", "a a a a a a", "é é é é é é", "a\x0ba\x0ca\ra\ta\na b", "a a a a a a a a a a a a", "w " * 3000]
    docs = docs_of(texts)
    docs = docs.union(docs.where("doc_id >= 4")).union(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))).withColumns({"runs": F.lit(1), "id": F.lit(2), "n_words": F.lit("x"), "collapsed": F.lit(0)})
    got = periodic.periodic_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == 2 * len(texts) - 4 + 1
    of = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows}
    assert of[0] == of[1] == of[2] == (0, [], "")
    assert of[3] == (5, [], "a a a a a")
    assert of[4] == of[None] == (6, [(0, 6, 1)], "a")
    assert of[5] == (6, [(0, 6, 1)], "é")
    assert of[6] == (7, [(0, 6, 1)], "a b")
    assert of[7][1] == [(0, 6, 1)] or of[7][0] == 7  # a non-breaking space is part of a word
    assert of[8] == (3000, [(0, 3000, 1)], "w")
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_query_reads_the_contract(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    short = {k for k, t in docs.items() if len(t or "") < 12_000}
    planted = 0
    for r in queries.op11_periodic_runs(spark, sf_dir).collect():
        if r.doc_id not in short:
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_runs, (r.start, r.length, r.period)) == (len(runs), best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(kept(words, runs)))
    assert planted > 5
