"""From raw documents to packed training sequences: five stages, each written and read again.

``STAGES`` takes and gives DataFrames with the columns of documents; the last gives the
pieces of the packed sequences. All stages take empty tables, which give no rows, texts of
any length, and further columns under any name, which all but the last keep. Rows without
an id are never learnt from nor compared with others, and stay unless a stage says otherwise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmeter.llm import decontam, langid, lines, packing, shingles, simhash
from voxmeter.llm.common import checkpoint_dir, table
from voxmeter.llm.components import connected_components


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text fits a learned language; those without a letter and those that fit none go.

    Null and empty texts go; rows that share an id go together if one of them goes.
    """
    rejected = langid.identify(docs).where("rejected").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document, or an earlier place, has; those that lose all their text go.

    Null and empty texts stay; rows that share an id are one document and change alike.
    """
    left = lines.dedup_lines(docs).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates: five-word shingles with a Jaccard similarity of 0.8 or more, or a SimHash within three bits.

    Null texts and texts without a word are copies of each other; rows that share an id stay
    or go together; of equal ones the least id stays.
    """
    near = simhash.near_duplicates(docs, n_words=5, radius=3).where("doc_id != component_id").select("doc_id", "component_id")
    links = shingles.similar_texts(docs, n_words=5, threshold=0.8).unionByName(near.toDF("a", "b"))
    copies = connected_components(links).where("node != component").select(F.col("node").alias("doc_id")).distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold a benchmark item; null and empty texts hold none, repeated rows are judged alike."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; null and empty texts are one end token, repeated rows are packed each on their own."""
    return packing.pack(docs)


STAGES = [("language id", language), ("line dedup", line_dedup), ("simhash dedup", simhash_dedup), ("decontamination", decontaminate), ("packing", pack)]

#: No SQL says what the language models and packing do; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        # Two folders in turn: no more copies of the corpus are left behind.
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k % 2}")
        docs = spark.read.parquet(f"{folder}/{k % 2}")
    return docs
