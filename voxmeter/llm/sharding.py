"""Proportional stratified interleaving: shards that each hold every source in its share of the whole.

Rows of a source are shuffled by a keyed hash and ranked; a rank's fraction of its source is
the row's place, all sources' rows are sorted by place, and the order is cut into shards of
equal counts. Only DataFrame functions. No source and no range of places is one task: both
rankings cut their order into buckets, number the rows within each and add the counts of the
buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxmeter.llm.common import cut

SHARDS = 24
#: The contract counts a row's bytes and this for its length.
ROW_BYTES = 8
#: Rows of a bucket on average, and buckets a shuffle partition at least, so that partitions are even.
BUCKET_ROWS, BUCKETS_EACH = 1_000_000, 8
#: Copies of one row that a single step makes.
COPIES = 1 << 16


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from 32 bits of the MD5 of the parts' texts."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def buckets(spark: SparkSession, n_rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_EACH, -(-n_rows // BUCKET_ROWS))


def bucket_of(unit: Column, n: int) -> Column:
    """Number of the equal range of [0, 1) that holds ``unit``."""
    return F.least(F.floor(unit * n), F.lit(n - 1)).cast("long")


def copies(df: DataFrame, n: str, at: str) -> DataFrame:
    """Each row ``n`` times, numbered by ``at`` from 0; many copies are made by several tasks."""
    long = lambda x: F.lit(x).cast("long")
    some = df.withColumn("__block", F.explode(F.sequence(long(0), F.floor((F.col(n) - 1) / COPIES))))
    return some.withColumn(at, F.explode(F.sequence(F.col("__block") * COPIES, F.least((F.col("__block") + 1) * COPIES, F.col(n)) - 1))).drop("__block")


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, seed: str = "shuffle", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: the id, source, size, text_crc32, copy, shard and slot.

    A row's place is (rank in its source + the source's own offset in [0, 1)) / rows of the
    source: any range of places holds each source's share of it to within one row, and
    sources of few rows don't meet at one place. Shards are cut by counts, which differ by
    one at most, so a shard's count of a source is off its share by one or two, and by its
    part of the chance with which sources of fewer rows than shards fall, if there are many
    such. Equal texts are not kept together. Slots number a shard's rows from 0 in the order
    of their places.

    ``size`` is the text's UTF-8 bytes and 8, ``text_crc32`` its unsigned checksum; null texts
    count as empty. A null source is a source of its own. Rows that agree in id, source, size
    and checksum are one row before they are shuffled, with its ``copy`` numbered from 0, and
    get places of their own; the same id with different contents is different rows. An empty
    table gives no rows; other columns, whatever their names, are not read.
    """
    spark, data = docs.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), docs[text_col].alias("text"))
    rows = rows.select("id", "source", (F.octet_length(data) + ROW_BYTES).cast("long").alias("size"), F.crc32(data.cast("binary")).alias("text_crc32"))
    known = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"))
    one = rows.groupBy("id", "source", "size", "text_crc32").agg(F.count("*").alias("n"))
    one = cut(one.withColumn("h", unit_hash(F.lit(f"{seed}:"), known)))
    total = one.agg(F.sum("n")).first()[0] or 0
    n_buckets = buckets(spark, total)

    # Ranks within a source: by the hash, which spreads a source's rows evenly over its buckets.
    ranked = one.withColumn("bucket", bucket_of(F.col("h"), n_buckets))
    order = ["h", "id", "size", "text_crc32"]
    before = F.sum("n").over(W.partitionBy("source", "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    counts = ranked.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.sum("n").alias("m"))
    counts = counts.withColumns({"of_source": F.sum("m").over(W.partitionBy("s")), "before": F.sum("m").over(W.partitionBy("s").orderBy("b")) - F.col("m")}).drop("m")
    ranked = ranked.withColumn("first", before).join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    ranked = copies(ranked, "n", "copy")
    offset = unit_hash(F.lit(f"{seed}:source:"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    placed = ranked.withColumn("place", (F.col("before") + F.col("first") + F.col("copy") + offset) / F.col("of_source"))
    placed = cut(placed.select("id", "source", "size", "text_crc32", "copy", "h", "place", bucket_of(F.col("place"), n_buckets).alias("bucket")))

    # Ranks among all: by the place, of which every range of one length has as many rows as another.
    within = F.row_number().over(W.partitionBy("bucket").orderBy("place", *order, "source", "copy")) - 1
    starts = placed.groupBy("bucket").agg(F.count("*").alias("m")).select("bucket", (F.sum("m").over(W.orderBy("bucket")) - F.col("m")).alias("start"))
    out = placed.withColumn("within", within).join(starts, "bucket").withColumn("at", F.col("start") + F.col("within"))
    # Shard s holds the ranks from ceil(s * total / n_shards) on.
    out = out.withColumn("shard", F.expr(f"(at * {n_shards}L) div {max(total, 1)}L").cast("int"))
    slot = F.col("at") - F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return out.select(F.col("id").alias(id_col), "source", "size", "text_crc32", F.col("copy"), "shard", slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, seed: str = "shuffle", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> None:
    """All columns of ``docs`` as Parquet under ``path``, a folder ``shard=s`` for each shard, with ``slot``; columns of these names are replaced.

    Ranges of (shard, slot) are dealt out, so a shard is one file or several, whose names and
    rows are in the order of ``slot``. Rows that agree in id, source, size and checksum take
    the places of their copies in any order. Rules for odd rows are those of ``assign_shards``.
    """
    rows, data = docs.drop("shard", "slot"), F.coalesce(F.col(text_col), F.lit(""))
    keys = {"__id": F.col(id_col), "__source": F.col(source_col).cast("string"), "__size": (F.octet_length(data) + ROW_BYTES).cast("long"), "__crc": F.crc32(data.cast("binary"))}
    full = rows.withColumns(keys).withColumn("__copy", F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0))).cast("long") - 1)
    to = assign_shards(docs, n_shards, seed, id_col, text_col, source_col).toDF("__i", "__s", "__z", "__c", "__k", "shard", "slot")
    same = F.col("__id").eqNullSafe(F.col("__i")) & F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z")) & (F.col("__crc") == F.col("__c")) & (F.col("__copy") == F.col("__k"))
    dealt = full.join(to, same).select(*rows.columns, "shard", "slot")
    n = max(n_shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
