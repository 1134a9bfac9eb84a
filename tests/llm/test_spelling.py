"""Spelling variants against plain loops and SQL."""

from __future__ import annotations

import random

import pytest
from comparing import connect, rows_of

from voxmeter.llm import queries, spelling


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes the difference."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts: dict[str, int], ratio: float = 10) -> dict[str, tuple]:
    others = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, near_by in others.items():
        best = min(near_by, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(others[w]), counts.get(form[w]))
    return out


def variants(spark, counts: dict[str, int], **options) -> dict[str, tuple]:
    rows = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n int, form string, root int")
    got = spelling.group_variants(rows, **options)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return {r.word: tuple(r)[1:] for r in got.collect()}


def corpus(rnd: random.Random, n: int, letters: str, lengths: range) -> dict[str, int]:
    words = {"".join(rnd.choice(letters) for _ in range(rnd.choice(lengths))): rnd.choice((1, 5, 200, 3000)) for _ in range(n)}
    for w in list(words):
        i = rnd.randrange(len(w))
        words.setdefault(rnd.choice((w[:i] + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1 :])), rnd.choice((1, 2, 30)))
    words.pop("", None)
    return words


@pytest.mark.parametrize(("letters", "lengths"), [("abcde", range(3, 8)), ("aeéßzàö😀", range(1, 6)), ("abcdefghijklmnop", range(6, 10)), ("ab", range(60, 70))])
def test_variants_are_those_of_plain_loops(spark, monkeypatch, letters, lengths):
    """Trees, cells and parts of cells are small, so that all of them come up."""
    for name, value in (("CELL", 40), ("LEAF", 4), ("TELLING", 2), ("LIMIT", 30), ("BATCH", 16), ("SAMPLE", 200)):
        monkeypatch.setattr(spelling, name, value)
    counts = corpus(random.Random(letters), 250, letters, lengths)
    assert variants(spark, counts) == plain_variants(counts)


def test_chains_ties_and_many_neighbours(spark):
    counts = {"abcdefg": 1, "abcdefh": 10, "abcdeih": 100, "abcjeih": 1000, "zbcjeih": 1000, "tttttta": 5, "ttttttb": 5, "tttttt": 50}
    assert variants(spark, counts) == plain_variants(counts)
    assert variants(spark, counts)["abcdefg"][:2] == ("abcdefh", "abcjeih")
    star = {"base" + "x" * 6: 10**6} | {"base" + "x" * i + c + "x" * (5 - i): 2 for i in range(6) for c in "abcdefghijklmnopqrstuvw"}
    assert variants(spark, star) == plain_variants(star)
    assert variants(spark, counts, ratio=2) == plain_variants(counts, 2)
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([("a", 1)], "word string, n int"), ratio=1)


def test_odd_rows(spark):
    rows = spark.createDataFrame([("abcdefg", 30), (None, 3), ("abcdefh", None), ("", 2), ("x" * 30_000, 20), ("x" * 29_999, 2), ("y" * 300, 4)], "word string, n long")
    got = {r.word: tuple(r)[1:] for r in spelling.group_variants(rows).collect()}
    assert got == {"abcdefg": (None, "abcdefg", 30, 0, None), "": (None, "", 2, 0, None), "x" * 30_000: (None, "x" * 30_000, 20, 1, None), "x" * 29_999: ("x" * 30_000, "x" * 30_000, 2, 1, 20), "y" * 300: (None, "y" * 300, 4, 0, None)}
    assert spelling.group_variants(rows.limit(0)).count() == 0


def test_words_and_counts(spark, docs_of):
    docs = docs_of([None, "", "Straße STRASSE ÄPFEL naïve-ness x9y", "naïve naïve"])
    words = [tuple(r) for r in spelling.word_rows(docs).collect()]
    assert words == [(2, "straße"), (2, "strasse"), (2, "Äpfel"), (2, "naïve"), (2, "ness"), (2, "x"), (2, "y"), (3, "naïve"), (3, "naïve")]
    assert {tuple(r) for r in spelling.count_words(spelling.word_rows(docs), 5, 2).collect()} == {("naïve", 3)}


def test_query_equals_sql(spark, sf_dir):
    got = queries.op12_spelling_variants(spark, sf_dir)
    cur = connect(sf_dir).execute(queries.ORACLES["op12_spelling_variants"])
    columns = [d[0] for d in cur.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, cur.fetchall())
