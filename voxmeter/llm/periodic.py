"""Periodic runs of words, found by block convolution.

At each dyadic scale L the words are cut into blocks of L. A run of period q from L to
2L - 1 and of four periods or more holds a whole block and the same words q on. Sums of
squared differences between a block and the words at each of these distances come from
exact number-theoretic transforms in the integers modulo 65537; where one is zero the block
may occur. Blocks in a row with one distance seed a stretch that is extended word by word
on both sides, and the words themselves decide. All documents of a batch are one array.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxmeter.llm.common import runs as text_ranges

#: A prime with roots of unity of every power of two up to 2**16, and a generator.
PRIME, GENERATOR = 65537, 3
#: Words of the longest block that is transformed whole; a longer one is sought by its first words, at all its distances.
WHOLE = 1 << 15
#: Numbers that are transformed at once, which fit the processor's cache.
ROOM = 1 << 16
#: Characters of the texts that are searched at once (a longer text is alone).
CHUNK = 2_000_000
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Modulus and base of the hashes that measure extensions; the words are compared afterwards.
HASH_PRIME, HASH_BASE = (1 << 31) - 1, 1_000_003
OUT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def folded(x: np.ndarray) -> np.ndarray:
    """The same residues of few bits: 65536 is -1."""
    return (x & 0xFFFF) - (x >> 16)


@lru_cache(maxsize=64)
def powers(n: int, inverse: bool) -> np.ndarray:
    """The first n / 2 powers of a root of unity of order n, about zero."""
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    out = np.ones(max(n // 2, 1), dtype=np.int64)
    k = 1
    while k < len(out):
        out[k : 2 * k] = out[:k][: len(out) - k] * pow(root, k, PRIME) % PRIME
        k *= 2
    return np.where(out > PRIME // 2, out - PRIME, out)


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transforms of the columns of ``x`` (rows a power of two up to 2**16), in natural order, unscaled.

    Values may leave the range of residues, never that of 64 bits: a stage at most doubles the bound.
    """
    n, width = x.shape
    x, step, length = np.ascontiguousarray(x).reshape(-1), width, n
    while length > 1:
        a, b = x.reshape(2, length // 2, step)
        y = np.empty((length // 2, 2, step), dtype=np.int64)
        np.add(a, b, out=y[:, 0])
        if length == 2:
            np.subtract(a, b, out=y[:, 1])
        else:
            y[:, 1] = folded((a - b) * powers(length, inverse)[:, None])
        x, step, length = y.reshape(-1), step * 2, length // 2
    return x.reshape(n, width)


def occurrences(values: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of the blocks of ``scale`` values that seem to occur ``scale`` to 2 * ``scale`` - 1 values on.

    ``values`` are residues. All real occurrences are found; others, if their squared
    differences add to a multiple of the prime, may be.
    """
    width = min(scale, WHOLE)
    n = -(-len(values) // scale)
    # What follows the end matches nothing but by chance.
    padded = np.concatenate([values, (np.arange((n + 3) * scale - len(values)) * 40503 + 12345) % PRIME])
    squares = np.concatenate([[0], np.cumsum(padded * padded)])
    within = np.arange(width)[:, None]
    flip, signs = -np.arange(2 * width) % (2 * width), 1 - 2 * (np.arange(2 * width)[:, None] % 2)
    unscale = pow(2 * width, PRIME - 2, PRIME)
    rows, found = max(1, ROOM // (2 * width)), []
    for first in range(0, n, rows):
        own = np.arange(first, min(first + rows, n)) * scale
        k = len(own)
        # A block longer than ``width`` has its distances in parts of ``width``.
        for shift in range(scale, 2 * scale, width):
            # A window is two blocks; if blocks are whole, neighbours share them.
            shared = scale == width
            spectra = spectrum(padded, np.append(own, own[-1] + [scale, 2 * scale]) if shared else np.concatenate([own, own + shift, own + shift + width]), width)
            block, left, right = (spectra[:, i : i + k] for i in ((0, 1, 2) if shared else (0, k, 2 * k)))
            # A shift by half the size changes the signs of the odd terms; a reversed index is a reversed block.
            both = folded(folded((left + signs * right) * block[flip]))
            cross = folded(folded(transform(both, inverse=True)[:width]) * unscale)
            start = own + shift + within
            sums = squares[own + width] - squares[own] + squares[start + width] - squares[start]
            distance, which = np.nonzero((sums - 2 * cross) % PRIME == 0)
            found.append((first + which, distance + shift))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def spectrum(padded: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Transforms of the ``width`` values from each start, filled up with as many zeros, as columns of residues."""
    x = np.zeros((2 * width, len(starts)), dtype=np.int64)
    x[:width] = padded[starts[None, :] + np.arange(width)[:, None]]
    return folded(transform(x))


class Words:
    """Codes of words with hashes of all their prefixes, to measure how far two places agree."""

    def __init__(self, codes: np.ndarray):
        self.codes, n = codes, len(codes)
        power = np.ones(n + 1, dtype=np.int64)
        k = 1
        while k <= n:
            power[k : 2 * k] = power[:k][: n + 1 - k] * pow(HASH_BASE, k, HASH_PRIME) % HASH_PRIME
            k *= 2
        self.power, self.n = power, n
        self.sums = np.concatenate([[0], np.cumsum((codes + 1) % HASH_PRIME * power[:n] % HASH_PRIME)])

    def agree(self, a: np.ndarray, d: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a seem those from a + d."""
        one, two = (self.sums[a + n] - self.sums[a]) % HASH_PRIME, (self.sums[a + d + n] - self.sums[a + d]) % HASH_PRIME
        return one * self.power[d] % HASH_PRIME == two

    def reach(self, a: np.ndarray, d: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Up to ``most`` words from ``a`` on (or before ``a``) that agree with those d later: by bisection."""
        low, high = np.zeros_like(a), most.copy()
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high + 1) // 2, low)
            same = self.agree(a - mid if back else a, d, mid)
            low, high = np.where(same, mid, low), np.where(same | ~open_, high, mid - 1)
        return low

    def stretches(self, a: int, b: int, d: int, lower: int, upper: int) -> list[tuple[int, int]]:
        """The longest ranges of lower <= x < upper whose words equal those d later and that meet [a, b): by comparison."""
        off = np.flatnonzero(self.codes[lower:upper] != self.codes[lower + d : upper + d]) + lower
        edges = np.concatenate([[lower - 1], off, [upper]])
        first, last = np.searchsorted(edges, a, side="right") - 1, np.searchsorted(edges, b)
        return [(x + 1, y) for x, y in zip(edges[first:last].tolist(), edges[first + 1 : last + 1].tolist()) if y > x + 1]


def find_runs(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period), sorted, of all runs in documents that are ranges of one array of word codes.

    ``starts`` are the documents' first places and the array's end; longer documents come
    first, and every document ends with a code that occurs nowhere else.
    """
    sizes, words = np.diff(starts) - 1, Words(codes)
    # Neighbouring codes get values far apart; different words may share one.
    values = codes * 40503 % PRIME
    known: dict[tuple[int, int], int] = {}
    scale = 1
    while (n_docs := int(np.searchsorted(-sizes, -max(LEAST_WORDS, LEAST_PERIODS * scale), side="right"))) > 0:
        block, d = occurrences(values[: starts[n_docs]], scale)
        # Blocks, and what they equal, lie within a document.
        doc = np.searchsorted(starts, block * scale, side="right") - 1
        inside = (block + 1) * scale + d < starts[doc + 1]
        block, d = block[inside], d[inside]
        order = np.lexsort((block, d))
        block, d = block[order], d[order]
        new = np.ones(len(block), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (block[1:] != block[:-1] + 1)
        heads = np.flatnonzero(new)
        count = np.diff(np.append(heads, len(block)))
        # A stretch of three periods holds two whole blocks in a row or, at scale one, all but one of its words.
        keep = count >= (2 if scale > 1 else LEAST_WORDS - 1)
        a, d = block[heads[keep]] * scale, d[heads[keep]]
        b = a + count[keep] * scale
        doc = np.searchsorted(starts, a, side="right") - 1
        lower, upper = starts[doc], starts[doc + 1] - 1 - d
        start = a - words.reach(a, d, np.minimum(a - lower, scale), back=True)
        stop = b + words.reach(b, d, np.minimum(upper - b, scale), back=False)
        least = np.maximum(LEAST_WORDS, LEAST_PERIODS * d) - d
        for s, e, q, n, lo, hi in zip(*(z[stop - start >= least].tolist() for z in (start, stop, d, least, lower, upper))):
            exact = np.array_equal(codes[s:e], codes[s + q : e + q]) and (s == lo or codes[s - 1] != codes[s - 1 + q]) and (e == hi or codes[e] != codes[e + q])
            # Where hashes or residues agreed by chance, the words are searched. Smaller periods of the same words came up at a smaller scale.
            for x, y in [(s, e)] if exact else words.stretches(s, e, q, lo, hi):
                if y - x >= n:
                    known.setdefault((x, y + q), q)
        scale *= 2
    found = np.array([(s, e - s, q) for (s, e), q in known.items()], dtype=np.int64).reshape(-1, 3)
    doc = np.searchsorted(starts, found[:, 0], side="right") - 1
    out = np.column_stack([doc, found[:, 0] - starts[doc], found[:, 1], found[:, 2]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def search(texts: list[bytes]) -> Iterator[tuple[int, list[dict], str]]:
    """(words, runs, text without repetitions) of each text."""
    split = [t.split() for t in texts]
    code: dict[bytes, int] = {}
    for words in split:
        for w in set(words).difference(code):
            code[w] = len(code)
    order = sorted(range(len(split)), key=lambda i: -len(split[i]))
    starts = np.zeros(len(split) + 1, dtype=np.int64)
    np.cumsum([len(split[i]) + 1 for i in order], out=starts[1:])
    codes = np.empty(starts[-1], dtype=np.int64)
    for k, i in enumerate(order):
        codes[starts[k] : starts[k + 1] - 1] = np.fromiter(map(code.__getitem__, split[i]), dtype=np.int64, count=len(split[i]))
        codes[starts[k + 1] - 1] = len(code) + k
    rows = find_runs(codes, starts)
    at = np.searchsorted(rows[:, 0], np.arange(len(order) + 1))
    place = {i: k for k, i in enumerate(order)}
    for i, words in enumerate(split):
        own = rows[at[place[i]] : at[place[i] + 1], 1:]
        if len(own):
            # +1 where a run's repetitions begin, -1 where it ends.
            edges = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edges, own[:, 0] + own[:, 2], 1)
            np.add.at(edges, own[:, 0] + own[:, 1], -1)
            kept = [words[j] for j in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()]
        else:
            kept = words
        yield len(words), [{"start": s, "length": n, "period": q} for s, n, q in own.tolist()], b" ".join(kept).decode("utf-8", "replace")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_words, runs (start, length, period; by start, then period) and the text with the repetitions of runs left out.

    Words are what stands between white space of ASCII; the text left has single spaces. A
    run is a stretch of words with smallest period q, of at least four periods and six
    words, that no neighbouring word extends; a word goes if some run has it after its first
    q words. Null and empty texts have no words and no runs. Rows are searched each on its
    own, so ids may repeat or be null; texts of any length are searched whole, in memory
    in proportion to the text, and in time of n log(n)^2. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
            for a, b in text_ranges([len(t) for t in texts], CHUNK):
                n, found, left = zip(*search(texts[a:b]))
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(found, kinds), pa.array(left, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(task, f"id {kind}, {OUT}").withColumnRenamed("id", id_col)
