"""Scorers: the built-in lexicon as column expressions, user-supplied ones by Arrow batches, and a registry of analyzers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmeter.constants import EMOTIONS, LEXICON_EMOTIONS, MAX_BATCH
from voxmeter.functions import churn, emotion, nps, pain
from voxmeter.functions.text import has_negative_word, lexicon_sentiment

Scorer = Callable[[list[str]], list]
#: What a scorer that fails, or leaves a comment out, stands for.
DEFAULT = {"emotions": {}, "pain_points": [], "churn_risk": 0.5, "sentiment": "neutral"}


def lexicon_scores(df: DataFrame, comment: str = "comment") -> DataFrame:
    """Adds the sixteen emotions, pain_points, churn_risk and sentiment by word lists, with fixed values in place of random ones."""
    mood, bad = F.col("sentiment"), has_negative_word(F.col(comment))
    primary = lambda e: [k for k, names in LEXICON_EMOTIONS.items() if e in names]
    scores = {e: F.when(mood.isin(primary(e)), 0.8).otherwise(0.15) if primary(e) else F.lit(0.15) for e in EMOTIONS}
    out = df.withColumn("sentiment", lexicon_sentiment(F.col(comment))).withColumns(scores)
    return out.withColumns({"pain_points": F.when(bad, F.array(F.lit("mock_pain_point"))).otherwise(F.array().cast("array<string>")), "churn_risk": F.when(bad, 0.85).otherwise(0.2)})


def asked(scorer: Scorer, texts: list[str], retries: int) -> list:
    """One answer a text, None where there is none; a scorer that raises is asked again."""
    for _ in range(retries):
        try:
            answers = list(scorer(texts))
            return (answers + [None] * len(texts))[: len(texts)]
        except Exception:  # noqa: BLE001  the contract: a scorer's failure is a fallback, never an error
            continue
    return [None] * len(texts)


def as_text(answer) -> str:
    return answer if isinstance(answer, str) else json.dumps(DEFAULT if answer is None else answer, ensure_ascii=False)


def score_comments(df: DataFrame, scorer: Scorer, comment: str = "comment", key: str = "comment_id", retries: int = 3, batch_size: int = MAX_BATCH) -> DataFrame:
    """(key, content, is_fallback): each comment's response as JSON text from ``scorer``, which gets at most ``batch_size`` comments at a time.

    A scorer that raises is asked again up to ``retries`` times; after that, and where it
    gives too few answers, the answer is the default one.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[comment].fillna("").tolist()
            answers = [a for k in range(0, len(texts), batch_size) for a in asked(scorer, texts[k : k + batch_size], retries)]
            yield pd.DataFrame({key: frame[key], "content": list(map(as_text, answers)), "is_fallback": [a is None for a in answers]})

    return df.select(key, comment).mapInPandas(task, f"{key} {dict(df.dtypes)[key]}, content string, is_fallback boolean")


#: Tasks of one round of calls at most; with more batches than that a task takes several. A task and its file of
#: answers cost a tenth of a second, so they must not grow in number with the comments; a run that dies loses
#: the calls of the tasks under way.
MOST_TASKS = 1000
ANSWERS = "batch_id long, digest long, contents array<string>, is_fallback array<boolean>"


def gathered(df: DataFrame, comment: str = "comment") -> DataFrame:
    """(batch_id, digest, rows): each batch's rows in the order of pos, and a hash of its comments in this order. A batch is bounded by its size."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in df.columns])), lambda a, b: a["pos"] - b["pos"])
    return df.groupBy("batch_id").agg(rows.alias("rows")).select("batch_id", F.xxhash64(F.transform("rows", lambda r: F.coalesce(r[comment], F.lit("")))).alias("digest"), "rows")


def answers(spark: SparkSession, path: str) -> DataFrame:
    """The durable answers, one row per batch and digest, should one have been written twice."""
    rows = spark.read.schema(ANSWERS).parquet(path)
    one = F.min(F.struct("contents", "is_fallback")).alias("a")
    return rows.groupBy("batch_id", "digest").agg(one).select("batch_id", "digest", "a.*")


def ask(batches: DataFrame, scorer: Scorer, path: str, comment: str = "comment", retries: int = 3, together: int | None = None) -> DataFrame:
    """Answers of all ``batches``, from the table of answers under ``path`` where it has them, else from ``scorer``, which gets a whole batch a call.

    Calls start in the order of batch_id, ``together`` of them in a task (one, or as many as
    leave no more than ``MOST_TASKS`` tasks). A task's answers are part of the table as soon
    as it has ended, whatever becomes of the job: no batch that has an answer is asked again,
    by later outputs or by another run over the same comments in the same batches, and a run
    that dies costs the calls of the tasks under way. Failed calls are kept as fallbacks.
    """
    spark = batches.sparkSession
    # The table exists, if empty, before it is read.
    spark.createDataFrame([], ANSWERS).write.mode("append").parquet(path)
    pending = batches.select("batch_id", "digest", F.transform("rows", lambda r: F.coalesce(r[comment], F.lit(""))).alias("texts")).join(answers(spark, path).select("batch_id", "digest"), ["batch_id", "digest"], "left_anti")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                got = asked(scorer, batch.column(2)[i].as_py(), retries)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([list(map(as_text, got))], pa.list_(pa.string())), pa.array([[a is None for a in got]], pa.list_(pa.bool_()))], names=["batch_id", "digest", "contents", "is_fallback"])

    last = pending.agg(F.max("batch_id")).first()[0]
    if last is not None:
        together = together or last // MOST_TASKS + 1
        dealt = pending.repartitionById(last // together + 1, F.floor(F.col("batch_id") / together).cast("int")).sortWithinPartitions("batch_id")
        # By this algorithm a task's file is moved to its place when the task commits, not when the job does.
        dealt.mapInArrow(task, ANSWERS).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return answers(spark, path)


def answered(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """The rows of ``batches`` with content, the answer to each. Rows are not moved again: they are with their batch."""
    both = batches.join(replies, ["batch_id", "digest"])
    rows = both.select(F.explode(F.arrays_zip("rows", "contents")).alias("r"))
    return rows.select("r.rows.*", F.col("r.contents").alias("content"))


def lexicon_scorer(comments: list[str]) -> list[dict]:
    """A scorer by the contract, for tests and as an example."""
    from voxmeter.constants import LEXICON_NEGATIVE, LEXICON_POSITIVE

    out = []
    for c in comments:
        lower = c.lower()
        good, bad = (any(w in lower for w in words) for words in (LEXICON_POSITIVE, LEXICON_NEGATIVE))
        mood = "positive" if good and not bad else "negative" if bad and not good else "neutral"
        out.append({"emotions": {e: 0.8 if e in LEXICON_EMOTIONS[mood] else 0.15 for e in EMOTIONS}, "pain_points": ["mock_pain_point"] if bad else [], "churn_risk": 0.85 if bad else 0.2, "sentiment": mood})
    return out


ANALYZERS: dict[str, Callable[[], Column]] = {
    "nps_category": lambda: nps.category(F.col("nps")),
    "churn_category": lambda: churn.category(F.col("churn_risk")),
    "dominant_emotion": emotion.dominant,
    "pain_point_count": lambda: F.size(pain.clean(F.col("pain_points"))),
}


def register(name: str, analyzer: Callable[[], Column]) -> None:
    ANALYZERS[name] = analyzer


def analyze(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Adds the columns of the named analyzers, of all by default."""
    return df.withColumns({n: ANALYZERS[n]() for n in names or ANALYZERS})
