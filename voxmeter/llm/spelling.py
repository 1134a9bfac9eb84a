"""Spelling variants, found by k-d trees over letter counts.

One inserted, deleted or replaced letter changes a word's letter counts by one up, one
down, or one of each: by two at most in sum. Words of one length are points of a k-d tree;
a word visits the trees of its own length and of one letter more, and of each tree only the
boxes that such a change can reach. The top of a tree deals its words into cells, one task
each; a cell's own tree prunes on, and in its leaves the order of the letters decides. No
list of pairs is made: a task sends on each word's count of near words and the best of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmeter.llm.common import cut

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Numbers in a vector: one for each of a to z, the others for what other characters are dealt to.
DIMENSIONS = 64
#: Words, of the lengths with more than a cell, that the trees' tops are grown on: those with low hashes. Where to split changes the work only.
SAMPLE = 50_000
#: Words of a cell, as the sample tells; words of a leaf; sample words of a cell at least.
CELL, LEAF, TELLING = 4096, 32, 16
#: A cell of more words is dealt into parts, all of which its visitors visit.
LIMIT = 1 << 16
#: Visitors that are compared at once.
BATCH = 1 << 14
#: Letters up to which words are compared letter by letter, all pairs of a leaf at once.
SHORT = 64


def characters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1)


def letter_counts(chars: np.ndarray) -> np.ndarray:
    """How often each letter is in each word; rare characters share what is left beyond a to z."""
    n, length = chars.shape
    other = 26 + chars % (DIMENSIONS - 26)
    at = np.where((chars >= 97) & (chars < 123), chars - 97, other) + (np.arange(n) * DIMENSIONS)[:, None]
    return np.bincount(at.reshape(-1), minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.int16)


class Tree:
    """A k-d tree of letter counts: a node splits on the letter that halves its words best, up to a count and above it."""

    def __init__(self, counts: np.ndarray, leaf: int):
        self.letter, self.most, self.children, self.leaves = [], [], [], []
        self.grow(counts, np.arange(len(counts)), leaf)

    def grow(self, counts: np.ndarray, own: np.ndarray, leaf: int) -> int:
        """A node's number; a leaf's is -1 less its number."""
        split = None
        if len(own) > leaf:
            # Up to a letter's middle count, or up to one less: whichever halves best.
            ordered = np.sort(np.ascontiguousarray(counts[own].T), axis=1)
            most = (ordered[:, len(own) // 2][:, None] - [0, 1]).astype(np.int16)
            low = (ordered[:, None, :] <= most[:, :, None]).sum(axis=2)
            half = np.minimum(low, len(own) - low)
            j, k = np.unravel_index(half.argmax(), half.shape)
            split = (int(j), int(most[j, k])) if half[j, k] else None
        if split is None:
            self.leaves.append(own)
            return -len(self.leaves)
        j, t = split
        node = len(self.letter)
        self.letter.append(j)
        self.most.append(t)
        self.children.append(())
        low = counts[own, j] <= t
        self.children[node] = (self.grow(counts, own[low], leaf), self.grow(counts, own[~low], leaf))
        return node

    def visits(self, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, visitors): the rows of ``counts`` that get into a leaf's box by at most ``up`` letters more and ``down`` letters less, 0 or 1 each."""
        none = np.full(len(counts), -1, dtype=np.int16)
        # The letters already raised and lowered on the way; -2: may not be.
        stack = [(0 if self.letter else -1, np.arange(len(counts)), none if up else none - 1, none if down else none - 1)]
        while stack:
            node, who, raised, lowered = stack.pop()
            if not len(who):
                continue
            if node < 0:
                yield -node - 1, who
                continue
            j, t = self.letter[node], self.most[node]
            value = counts[who, j] + (raised == j) - (lowered == j)
            below = value <= t
            climb = (value == t) & (raised == -1) & (lowered != j)
            fall = (value == t + 1) & (lowered == -1) & (raised != j)
            for child, stay, moved, way in ((self.children[node][0], below, fall, False), (self.children[node][1], ~below, climb, True)):
                go = stay | moved
                r, low = raised[go], lowered[go]
                (r if way else low)[moved[go]] = j
                stack.append((child, who[go], r, low))


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and of ``b``, words of one length, differ in exactly one place."""
    if a.shape[1] > SHORT:
        return np.stack([(a != w).sum(axis=1) == 1 for w in b], axis=1)
    off = np.zeros((len(a), len(b)), dtype=np.uint8)
    for p in range(a.shape[1]):
        off += a[:, p, None] != b[None, :, p]
    return off == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``b`` are a row of ``a`` with one more letter: what agrees from the front and from the back makes up the shorter."""
    n = a.shape[1]
    if n > SHORT:
        agree = lambda same: np.where(same.all(axis=1), n, same.argmin(axis=1))
        return np.stack([agree(a == w[:n]) + agree((a == w[1:])[:, ::-1]) >= n for w in b], axis=1)
    alike = np.zeros((len(a), len(b)), dtype=np.uint8)
    for places, shift in ((range(n), 0), (range(n - 1, -1, -1), 1)):
        go = np.ones((len(a), len(b)), dtype=bool)
        for p in places:
            go &= a[:, p, None] == b[None, :, p + shift]
            alike += go
    return alike >= n


def best_of(at: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``at`` that occurs: its number of pairs, and its ``other`` of largest n, the first of equal ones."""
    order = np.lexsort((other, -n[other], at))
    who, first, count = np.unique(at[order], return_index=True, return_counts=True)
    return who, count, other[order][first]


class Cell:
    """The members of one cell, sorted by word, and their tree."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n, self.chars = words, np.array(n), characters(words)
        self.tree = Tree(letter_counts(self.chars), LEAF)

    def near(self, words: list[str], n: list[int], longer: bool) -> Iterator[tuple[str, int, int, str]]:
        """(word, near words, n of the best, the best) of visitors, sorted by word, of the members' length; of visitors with one letter less, and of members too."""
        chars, n = characters(words), np.array(n)
        pairs = []
        for leaf, who in self.tree.visits(letter_counts(chars), 1, 0 if longer else 1):
            own = self.tree.leaves[leaf]
            q, m = np.nonzero((inserted if longer else replaced)(chars[who], self.chars[own]))
            if len(q):
                pairs.append((who[q], own[m]))
        if not pairs:
            return
        q, m = (np.concatenate(x) for x in zip(*pairs))
        for who, count, best in zip(*(x.tolist() for x in best_of(q, m, self.n))):
            yield words[who], count, int(self.n[best]), self.words[best]
        if longer:
            for who, count, best in zip(*(x.tolist() for x in best_of(m, q, n))):
                yield self.words[who], count, int(n[best]), words[best]


def lengths_of(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    yield from ((k, list(g)) for k, g in groupby(order, key=lambda i: len(words[i])))


def found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("word", "n_near", "best_n", "best"), r)) for r in rows], schema=pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]))


def near_words(words: DataFrame) -> DataFrame:
    """Distinct (word, n) to (word, n_near, best_n, best) of the words that have a near word: how many, and the one of largest n, the first of equal ones.

    Words are near if one inserted, deleted or replaced code point makes the difference.
    """
    scratch = cut(words.select("word", F.col("n").cast("long"), F.length("word").alias("length")).where("length > 0"))
    # Lengths of more words than a cell, of which there are at most as many as cells.
    large = {r.length: r.n for r in scratch.groupBy("length").agg(F.count("*").alias("n")).where(F.col("n") > CELL).collect()}
    sample: dict[int, list[str]] = {}
    # About SAMPLE words in all, whatever the corpus: those whose hash is below their share.
    chosen = F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE / max(1, sum(large.values()))))
    for r in scratch.where(F.col("length").isin(list(large)) & chosen).select("word").collect() if large else []:
        sample.setdefault(len(r.word), []).append(r.word)
    trees = {k: Tree(letter_counts(characters(w)), max(TELLING, CELL * len(w) // large[k])) for k, w in sample.items()}

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            cell = np.zeros(len(texts), dtype=np.int64)
            for k, own in lengths_of(texts):
                if k in trees:
                    for leaf, who in trees[k].visits(letter_counts(characters([texts[i] for i in own])), 0, 0):
                        cell[np.array(own)[who]] = leaf
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["word", "n", "length", "cell"])

    placed = cut(scratch.mapInArrow(members, "word string, n long, length int, cell long"))
    parts = {(r.length, r.cell): ceil(r.n / LIMIT) for r in placed.groupBy("length", "cell").agg(F.count("*").alias("n")).where(F.col("n") > LIMIT).collect()}

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members with role 0, visitors of their length with role 1, of one letter less with role 2."""
        for batch in batches:
            texts, at, length, cell, part, role = batch.column(0).to_pylist(), [], [], [], [], []

            def send(rows: list[int], k: int, c: int, p: int, what: int) -> None:
                at.extend(rows)
                for column, value in ((length, k), (cell, c), (part, p), (role, what)):
                    column.extend([value] * len(rows))

            for i, (k, c) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                send([i], k, c, i % parts.get((k, c), 1), 0)
            for k, own in lengths_of(texts):
                counts = letter_counts(characters([texts[i] for i in own]))
                for to, down, what in ((k, 1, 1), (k + 1, 0, 2)):
                    for leaf, who in trees[to].visits(counts, 1, down) if to in trees else [(0, np.arange(len(own)))]:
                        for p in range(parts.get((to, leaf), 1)):
                            send(np.array(own)[who].tolist(), to, leaf, p, what)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(length, pa.int32()), pa.array(cell, pa.int64()), pa.array(part, pa.int32()), pa.array(role, pa.int32())], names=["word", "n", "length", "cell", "part", "role"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell, role and word."""
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("length", "cell", "part", "role", "word", "n"))))
        for _, group in groupby(rows, key=lambda r: r[:3]):
            cell = None
            for role, own in groupby(group, key=lambda r: r[3]):
                if role == 0:
                    cell = Cell(*map(list, zip(*(r[4:] for r in own))))
                elif cell is not None:
                    while some := [r[4:] for _, r in zip(range(BATCH), own)]:
                        if out := list(cell.near(*map(list, zip(*some)), role == 2)):
                            yield found(out)

    key = ["length", "cell", "part"]
    dealt = placed.mapInArrow(visits, "word string, n long, length int, cell long, part int, role int").repartition(*key).sortWithinPartitions(*key, "role", "word")
    near = dealt.mapInArrow(compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def word_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS) -> DataFrame:
    """(id, word): every occurrence of a maximal run of letters, with A to Z lower-cased. Null texts have none."""
    text = F.translate(docs[text_col].cast("string"), UPPER, LOWER)
    return docs.select(docs[id_col].alias("id"), F.explode(F.regexp_extract_all(text, F.lit(letters), F.lit(0))).alias("word"))


def count_words(rows: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the distinct words of at least ``min_length`` code points with at least ``min_count`` occurrences."""
    return rows.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def group_variants(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Distinct (word, n) to (word, form, root, n, n_near, form_n).

    A word's form is its near word of largest n, the first in code-point order of equal ones,
    if that is at least ``ratio`` times the word's n, else null. ``root`` is where forms
    lead from the word, itself if it has none; ``n_near`` counts near words. Null words and
    counts are no words; an empty table gives no rows; other columns are not read. Words
    may have any characters and any length.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than the word")
    words = cut(words.select("word", F.col("n").cast("long").alias("n")).dropna())
    best = near_words(words)
    is_form = F.col("best_n") >= F.col("n") * ratio
    out = cut(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    # Each form has ``ratio`` times the n of the one before, so the largest n bounds the steps; each turn doubles them.
    most = words.agg(F.max("n")).first()[0] or 1
    steps = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(max(2.0, log(most) / log(ratio) + 1)))):
        steps = cut(steps.join(steps.toDF("root", "next"), "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return out.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
