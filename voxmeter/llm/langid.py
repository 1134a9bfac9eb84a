"""Language identification with interpolated Kneser-Ney character models.

Training: character 4-grams of all training texts are counted where the texts lie
(one sorted array per task and language), summed by Spark, and the lower orders
follow from the distinct higher ones by joins, as Kneser-Ney asks. The model is
stored as sorted arrays of whole 64-bit n-gram keys with the log-probabilities of all
languages beside them, so no two n-grams share an entry, and it grows with the corpus.
It is broadcast in shards of a bounded number of entries: all that is known of a
character with those before it lies in the shard of the two characters before it, and
a text's sums go from shard to shard.

Scoring looks up every character of every text; the language with the lowest
cross-entropy per character wins, and a text that fits even its best language far
worse than that language's training texts do is marked as rejected.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmeter.llm.common import code_points, cut, held_out, text_runs, xxh64_longs

ORDER = 4
#: N-grams and contexts of all languages in a shard of the model, about.
SHARD_ROWS = 2_000_000
#: Characters of texts that a task works on at once, and n-grams of a language that it holds, about.
CHUNK = 1 << 18
HELD = 1_500_000
SPACE = np.uint64(32)
_alpha: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter or a mark inside words."""
    if not _alpha:
        _alpha.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _alpha[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters with one space after each word, all texts in a row.

    Returns 4-gram keys (four 16-bit symbols, the newest lowest; before its first
    symbol a text has spaces), the symbols' number in each text and its letters.
    """
    cp, starts = code_points([t.lower() for t in texts])
    is_letter = letters()[cp]
    before = np.empty_like(is_letter)
    before[0], before[1:] = False, is_letter[:-1]
    keep = is_letter | before
    counts = np.add.reduceat(keep, starts[:-1], dtype=np.int64)
    n_letters = np.add.reduceat(is_letter, starts[:-1], dtype=np.int64)
    sym = np.where(is_letter, cp & 0xFFFF, 32)[keep].astype(np.uint64)
    at = np.cumsum(counts) - counts
    place = np.arange(len(sym)) - np.repeat(at, counts)
    key = sym.copy()
    for k in range(1, ORDER):
        old = np.full_like(sym, SPACE)
        old[k:] = sym[: max(0, len(sym) - k)]
        old[place < k] = SPACE
        key |= old << np.uint64(16 * k)
    return key, counts, n_letters


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)


def count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to (lang, key, n), one array per language that is merged as it grows and sent on when it is large."""
    names = ["lang", "key", "n"]
    held: dict[str, list] = {}

    def out(lang: str) -> pa.RecordBatch:
        keys, n = merged(held.pop(lang))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=names)

    for batch in batches:
        for lang in batch.column(0).unique().to_pylist():
            for _, _, texts in text_runs(batch.filter(pc.equal(batch.column(0), lang)).column(1), CHUNK):
                key, _, _ = symbols(texts)
                if len(key):
                    part = held.setdefault(lang, [])
                    part.append(np.unique(key, return_counts=True))
                    if len(part) > 32:
                        held[lang] = [merged(part)]
                        if len(held[lang][0][0]) > HELD:
                            yield out(lang)
    for lang in list(held):
        yield out(lang)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, key, n) of the highest order to (order, kind, key, lang, value).

    kind 'p': ln of the interpolated probability of a seen n-gram; kind 'b': ln of the
    weight that a seen context leaves to the next lower order.
    """
    tables, out = {ORDER: counts}, []
    for n in range(ORDER - 1, 0, -1):
        keep = (1 << (16 * n)) - 1
        tables[n] = tables[n + 1].groupBy("lang", F.col("key").bitwiseAND(F.lit(keep).cast("long")).alias("key")).agg(F.count("*").alias("n"))
    lower = None
    for n in range(1, ORDER + 1):
        t = tables[n].withColumn("ctx", F.shiftrightunsigned("key", 16) if n > 1 else F.lit(0).cast("long"))
        seen = t.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        rate = seen.select("lang", F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5)))).alias("d"))
        ctx = t.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(F.broadcast(rate), "lang").withColumn("back", F.col("d") * F.col("kinds") / F.col("total"))
        p = t.join(ctx, ["lang", "ctx"]).withColumn("own", (F.col("n") - F.col("d")) / F.col("total"))
        if n == 1:
            # Below the single characters lies a uniform share over the code space of one symbol.
            p = p.select("lang", "key", (F.col("own") + F.col("back") / 65536).alias("p"))
        else:
            p = p.withColumn("low", F.col("key").bitwiseAND(F.lit((1 << (16 * (n - 1))) - 1).cast("long")))
            p = p.join(lower.select("lang", F.col("key").alias("low"), F.col("p").alias("p_low")), ["lang", "low"]).select("lang", "key", (F.col("own") + F.col("back") * F.col("p_low")).alias("p"))
        lower = p = cut(p)
        out.append(p.select(F.lit(n).alias("order"), F.lit("p").alias("kind"), "key", "lang", F.log("p").alias("value")))
        out.append(ctx.select(F.lit(n).alias("order"), F.lit("b").alias("kind"), F.col("ctx").alias("key"), "lang", F.log("back").alias("value")))
    return reduce(DataFrame.unionByName, out)


@dataclass
class Model:
    """What one shard holds: per order, sorted keys and values by key and language. All orders below three are in every shard."""

    langs: list[str]
    p: dict[int, tuple[np.ndarray, np.ndarray]]
    b: dict[int, tuple[np.ndarray, np.ndarray]]


@dataclass
class Shards:
    """A trained model as rows (order, p, key, lang, value), languages by number, and the number of shards it is taken in."""

    langs: list[str]
    rows: DataFrame
    n: int

    def load(self, k: int) -> Model:
        rows = self.rows
        if self.n > 1:
            middle = F.when(F.col("order") < 3, None).otherwise(F.when(F.col("p"), F.shiftrightunsigned("key", 16)).otherwise(F.col("key"))).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
            rows = rows.where((F.col("order") < 3) | (F.pmod(F.xxhash64(middle), F.lit(self.n)) == k))
        return assemble(self.langs, rows.toArrow())


def shard_of(key: np.ndarray, n: int) -> np.ndarray:
    """The shard of each 4-gram key: that of the two symbols before the newest."""
    return np.mod(xxh64_longs((key >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).view(np.int64), n)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == keys


def log_p(model: Model, key: np.ndarray, n: int = ORDER) -> np.ndarray:
    """ln p of each key's newest symbol, by language: found n-grams directly, the rest by back-off."""
    if n == 0:
        return np.full((len(key), len(model.langs)), -np.log(65536.0), dtype=np.float32)
    key = key & np.uint64((1 << (16 * n)) - 1) if n < ORDER else key
    keys, values = model.p[n]
    at, hit = find(keys, key)
    out = values[at] if len(keys) else np.empty((len(key), len(model.langs)), dtype=np.float32)
    if not hit.all():
        rest = ~hit
        out[rest] = backed_off(model, key[rest], n)
    return out


def backed_off(model: Model, key: np.ndarray, n: int) -> np.ndarray:
    keys, weights = model.b[n]
    at, hit = find(keys, key >> np.uint64(16) if n > 1 else np.zeros_like(key))
    return (np.where(hit[:, None], weights[at], np.float32(0)) if len(keys) else np.float32(0)) + log_p(model, key, n - 1)


def assemble(langs: list[str], rows: pa.Table) -> Model:
    """Sorted arrays from the rows of a shard; what a language lacks of an n-gram is its backed-off value."""
    model = Model(langs, {}, {})
    order, is_p, key, lang, value = (rows.column(i).to_numpy() for i in range(5))
    for n in range(1, ORDER + 1):
        for p, into in ((False, model.b), (True, model.p)):
            own = (order == n) & (is_p == p)
            keys, at = np.unique(key[own].view(np.uint64), return_inverse=True)
            grid = np.full((len(keys), len(langs)), np.nan, dtype=np.float32)
            grid[at, lang[own]] = value[own]
            into[n] = (keys, grid if p else np.where(np.isnan(grid), np.float32(0), grid))
        keys, values = model.p[n]
        lack = np.isnan(values)
        some = lack.any(1)
        values[some] = np.where(lack[some], backed_off(model, keys[some], n), values[some])
    return model


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", shard_rows: int = SHARD_ROWS) -> Shards | None:
    """Models of every language with a letter in a text; None if there is none. Null languages and texts teach nothing."""
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text")).dropna()
    counts = cut(rows.mapInArrow(count_task, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))
    langs = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    of = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    rows = cut(kneser_ney(counts).select(F.col("order").cast("int"), (F.col("kind") == "p").alias("p"), "key", of.alias("lang"), F.col("value").cast("float")))
    return Shards(langs, rows, max(1, -(-rows.count() // shard_rows)))


def score(spark: SparkSession, docs: DataFrame, model: Shards | None, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred, score, entropy (of the best language, in nats a symbol) and n_letters of every row."""
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(0).cast("long").alias("n_letters"))
    langs, shards = model.langs, model.n

    def task(shared, k: int):
        """Adds the shard's part to each text's sums; after the last shard they are judged."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, last = shared.value, k == shards - 1
            for batch in batches:
                sums = batch.column(batch.num_columns - 2)
                totals = np.zeros((batch.num_rows, len(langs))) if k == 0 else np.asarray(sums.flatten()).reshape(-1, len(langs)).copy()
                n, n_letters = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
                for a, b, texts in text_runs(batch.column(batch.num_columns - 1), CHUNK):
                    key, n[a:b], n_letters[a:b] = symbols(texts)
                    own = np.flatnonzero(shard_of(key, shards) == k) if shards > 1 else slice(None)
                    text = np.repeat(np.arange(a, b), n[a:b])[own]
                    p = log_p(m, key[own])
                    if len(text):
                        first = np.flatnonzero(np.diff(text, prepend=-1))
                        totals[text[first]] += np.add.reduceat(p, first, axis=0, dtype=np.float64)
                kept = batch.columns[:-2]
                if not last:
                    yield pa.RecordBatch.from_arrays([*kept, pa.FixedSizeListArray.from_arrays(pa.array(totals.ravel()), len(langs)).cast(pa.list_(pa.float64())), batch.column(batch.num_columns - 1)], names=[*keep, "sums", "text"])
                    continue
                has = n > 0
                h = -totals / np.maximum(n, 1)[:, None]
                odds = np.exp((h.min(1)[:, None] - h) * np.sqrt(np.maximum(n, 1))[:, None] * 2)
                best = [langs[i] if w else "und" for i, w in zip(h.argmin(1), has, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(best, pa.string()), pa.array(np.where(has, 1 / odds.sum(1), 0.0)), pa.array(np.where(has, h.min(1), np.nan), from_pandas=True), pa.array(n_letters)], names=[*keep, "lang_pred", "score", "entropy", "n_letters"])

        return run

    rows = docs.select(*keep, F.lit(None).cast("array<double>").alias("sums"), F.col(text_col).alias("text"))
    schema = docs.select(*keep).schema
    for field in ("lang_pred string", "score double", "entropy double", "n_letters long"):
        schema = schema.add(*field.split())
    for k in range(shards):
        shared = spark.sparkContext.broadcast(model.load(k))
        if k == shards - 1:
            return rows.mapInArrow(task(shared, k), schema)
        rows = cut(rows.mapInArrow(task(shared, k), rows.schema))
        shared.unpersist()


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", z: float = 8.0, slack: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Predicts each row's language: id, held_out, lang_pred, score, rejected, entropy, n_letters.

    Learns from the rows that are not held out and have a language. Null texts and texts
    without a letter are ``und`` with score 0 and rejected; an id that is null is not held
    out and teaches nothing; repeated rows are judged alike; equal cross-entropies go to the
    first language in alphabetical order; an empty table gives no rows. ``rejected``: the
    best language's cross-entropy is over its training texts' mean by more than ``slack``
    nats and by ``z`` standard deviations, each made of a part between texts and a part that
    shrinks with length.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    model = train(rows.where(~F.col("held_out") & F.col("doc_id").isNotNull()), shard_rows=shard_rows)
    scored = cut(score(docs.sparkSession, rows, model, "doc_id", "text", ["doc_id", "lang", "held_out"]))
    known = scored.where(~F.col("held_out") & (F.col("lang") == F.col("lang_pred")) & (F.col("n_letters") > 0))
    mean = known.groupBy("lang").agg(F.avg("entropy").alias("mean"))
    off = F.pow(F.col("entropy") - F.col("mean"), 2)
    limits = known.join(F.broadcast(mean), "lang").groupBy(F.col("lang").alias("lang_pred")).agg(F.first("mean").alias("mean"), F.avg(F.when(F.col("n_letters") >= 200, off)).alias("between"), F.avg(off * F.col("n_letters")).alias("within"))
    spread = F.sqrt(F.coalesce("between", F.lit(0.0)) + F.coalesce("within", F.lit(0.0)) / F.greatest("n_letters", F.lit(1)))
    limit = F.col("mean") + F.greatest(F.lit(slack), z * spread)
    # One row per language, each with a model in the broadcast above.
    return scored.join(F.broadcast(limits), "lang_pred", "left").select("doc_id", "held_out", "lang_pred", "score", ((F.col("lang_pred") == "und") | F.coalesce(F.col("entropy") > limit, F.lit(False))).alias("rejected"), "entropy", "n_letters")
