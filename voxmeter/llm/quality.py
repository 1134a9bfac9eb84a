"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features, each time adding a small step of a shallow tree on one
feature's bins (then on one pair's), so that every feature and chosen pair ends up as one
lookup table. A text's score is the sum of its bins' entries through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmeter.llm.common import code_points, cut, held_out, least_hashed, runs

FEATURES = ["log_chars", "log_words", "word_length", "letters", "upper", "digits", "spaces", "sentence_marks", "commas", "symbols", "distinct_words", "common_word", "repeated_lines", "line_length", "word_end_symbols", "capital_words", "lines_per_char", "long_words"]
CHUNK = 1_500_000
#: Labelled rows that the driver fits on, at most; beyond that, those with the smallest hashed ids.
FIT_ROWS = 40_000
LETTER, UPPER, DIGIT, SPACE, MARK, COMMA = 1, 2, 4, 8, 16, 32
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Bits of each code point's class."""
    if not _classes:
        c = np.zeros(0x110000, dtype=np.uint8)
        for i in range(0x30000):
            ch = chr(i)
            c[i] = LETTER * ch.isalpha() | UPPER * ch.isupper() | DIGIT * ch.isdigit() | SPACE * ch.isspace()
        c[[ord(x) for x in ".?!;:"]] |= MARK
        c[ord(",")] |= COMMA
        _classes.append(c)
    return _classes[0]


def features(texts: list[str]) -> np.ndarray:
    """One row of FEATURES per text; an empty text's are 0."""
    cp, starts = code_points(texts)
    kind = classes()[cp]
    kind[starts[1:] - 1] = 0  # the newlines between texts
    count = lambda mask: np.add.reduceat(mask, starts[:-1], dtype=np.int64).astype(float)
    has = lambda bit: (kind & bit) > 0
    letter, space = has(LETTER), has(SPACE)
    n = np.diff(starts) - 1.0
    n_letters, n_spaces = count(letter), count(space)
    n_upper, n_digits, n_marks, n_commas = count(has(UPPER)), count(has(DIGIT)), count(has(MARK)), count(has(COMMA))
    symbol = (kind == 0) & (cp != 10)
    symbol_end = symbol.copy()
    symbol_end[:-1] &= space[1:] | (cp[1:] == 10)
    capital = has(UPPER)
    capital[1:] &= ~letter[:-1]
    words = np.zeros((len(texts), 3))
    lines = np.zeros((len(texts), 2))
    for i, t in enumerate(texts):
        w = t.split()
        if w:
            distinct = set(w)
            words[i] = len(w), len(distinct), sum(len(x) > 14 for x in w)
            seen: set[str] = set()
            all_lines = t.split("\n")
            repeated = 0
            for x in all_lines:
                repeated += len(x) if x in seen else 0
                seen.add(x)
            lines[i] = len(all_lines), repeated
    n_words = words[:, 0]
    per = lambda a, b: a / np.maximum(b, 1)
    return np.column_stack([np.log1p(n), np.log1p(n_words), per(n - n_spaces, n_words), per(n_letters, n), per(n_upper, n_letters), per(n_digits, n), per(n_spaces, n), per(n_marks, n_words), per(n_commas, n_words), per(n - n_letters - n_digits - n_spaces - n_marks - n_commas, n), per(words[:, 1], n_words), per(n_marks, n), per(lines[:, 1], n), per(n, lines[:, 0]), per(count(symbol_end), n_words), per(count(capital), n_words), per(lines[:, 0], n), per(words[:, 2], n_words)])


def feature_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the features of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in runs([len(t) for t in texts], CHUNK):
                x = features(texts[a:b]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, x.T)], names=["doc_id", *FEATURES])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col]).mapInArrow(task, "doc_id long, " + ", ".join(f"{f} float" for f in FEATURES))


@dataclass
class Gam:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += values[np.searchsorted(edges, x[:, j], side="right")]
        for (i, j), values in zip(self.pairs, self.pair_tables, strict=True):
            out += values[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return out


def quantile_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]


def leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 5.0)


def cuts(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A depth-limited tree over ordered bins: the leaf value of each bin, from sums of gradients and Hessians."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not depth or not len(left_g):
        return np.full(len(g), leaf(g.sum(), h.sum()))
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + 5.0) + right_g**2 / (right_h + 5.0)
    at = int(np.argmax(gain)) + 1
    return np.concatenate([cuts(g[:at], h[:at], depth - 1), cuts(g[at:], h[at:], depth - 1)])


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best split of a grid of bins by one cut on each axis: its gain and the cells' leaf values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    part = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    gs, hs = part(cg), part(ch)
    gain = sum(a**2 / (b + 5.0) for a, b in zip(gs, hs, strict=True))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    v = [leaf(a[i, j], b[i, j]) for a, b in zip(gs, hs, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 250, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.08, bins: int = 48, pair_bins: int = 10) -> Gam:
    """Boosts the tables on 0/1 labels; with one class only, the base rate is the model."""
    m = Gam(base=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), edges=quantile_edges(x, bins), pair_edges=quantile_edges(x, pair_bins))
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    if len(set(y.tolist())) < 2:
        return m
    at = [np.searchsorted(e, c, side="right") for e, c in zip(m.edges, x.T, strict=True)]
    f = np.full(len(y), m.base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, bin_of in enumerate(at):
            g, h = gradient()
            step = rate * cuts(np.bincount(bin_of, g, len(m.tables[j])), np.bincount(bin_of, h, len(m.tables[j])), 2)
            m.tables[j] += step
            f += step[bin_of]
    pair_at = [np.searchsorted(e, c, side="right") for e, c in zip(m.pair_edges, x.T, strict=True)]
    size = [len(e) + 1 for e in m.pair_edges]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(pair_at[i] * size[j] + pair_at[j], v, size[i] * size[j]).reshape(size[i], size[j])

    g, h = gradient()
    ranked = sorted(((quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])), reverse=True)
    m.pairs = [(i, j) for _, i, j in ranked[:n_pairs]]
    m.pair_tables = [np.zeros((size[i], size[j])) for i, j in m.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(m.pairs):
            g, h = gradient()
            step = rate * quadrants(grid(i, j, g), grid(i, j, h))[1]
            m.pair_tables[k] += step
            f += step[pair_at[i], pair_at[j]]
    return m


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5) of every row.

    Fits on labelled rows that are not held out: all of them up to ``fit_rows``, beyond that
    the ``fit_rows`` with the smallest hashed ids. Only the text is an input of a score.
    Null and null-labelled ids teach nothing; an id labelled more than once teaches its
    highest label; null texts count as empty and are scored; repeated rows get equal scores;
    without a label every score is 0.5; an empty table gives no rows.
    """
    rows = cut(feature_table(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id"))))
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    labelled = cut(rows.where(~F.col("held_out")).join(known, "doc_id"))
    sample = least_hashed(labelled, "doc_id", fit_rows, labelled.count()).select("label", *FEATURES).toArrow()
    model = fit(np.column_stack([sample.column(f).to_numpy() for f in FEATURES]).astype(float), (sample.column("label").to_numpy() > 0).astype(float)) if sample.num_rows else Gam()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 18 * 48 + 6 * 100 numbers

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i + 2).to_numpy() for i in range(len(FEATURES))]).astype(float)
            p = 1 / (1 + np.exp(-np.clip(shared.value.margin(x), -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", *FEATURES).mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")
