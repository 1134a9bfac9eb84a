"""Fixed-size and token-bounded batches, prompts, and the batch-size formula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxmeter.constants import MAX_BATCH, PROMPT_TOKENS, TOKENS_PER_COMMENT, TOKENS_PER_REQUEST
from voxmeter.functions.text import batch_tokens, estimate_tokens
from voxmeter.sources.io import PLACE_BITS
from voxmeter.sources.scratch import cut



def range_sorted(df: DataFrame, *order: str) -> DataFrame:
    """Range partitions sorted by the order, written once, with __p, the partition, and __r, the row's place in it from 0."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    return rows.withColumns({"__p": F.shiftright("__m", PLACE_BITS), "__r": F.col("__m").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}).drop("__m")


def with_row_index(df: DataFrame, order: str) -> DataFrame:
    """Adds __i, the row's place in the order from 0: its place in its range partition, shifted by the sizes of the partitions before."""
    rows = range_sorted(df, order)
    # One row per partition.
    offsets = rows.groupBy("__p").agg(F.count("*").alias("n")).select("__p", (F.sum("n").over(W.orderBy("__p")) - F.col("n")).alias("offset"))
    return rows.join(F.broadcast(offsets), "__p").withColumn("__i", F.col("offset") + F.col("__r")).drop("__p", "__r", "offset")


def fixed_batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds batch_id = place // size and pos within the batch."""
    return numbered_batches(with_row_index(df, order), "__i", size).drop("__i")


def numbered_batches(df: DataFrame, index: str, size: int) -> DataFrame:
    """Adds batch_id and pos by a column that numbers the rows from 0."""
    return df.withColumns({"batch_id": F.floor(F.col(index) / size).cast("long"), "pos": (F.col(index) % size).cast("int")})


def token_batches(df: DataFrame, order: str, text: str, by: str, budget: int = TOKENS_PER_REQUEST) -> DataFrame:
    """Adds batch_no within each ``by`` so that each batch's comments fit the budget; nothing is left out. A comment is in the batch in which its running token sum begins."""
    room = int((budget / 1.5 - PROMPT_TOKENS) * 0.9)
    rows = range_sorted(df.withColumn("tokens", estimate_tokens(F.coalesce(text, F.lit("")))), by, order)
    # A hot key lies in many range partitions: sums run within each, and sums of whole partitions are added.
    running = F.sum("tokens").over(W.partitionBy("__p", by).orderBy("__r")) - F.col("tokens")
    parts = rows.groupBy(F.col(by).alias("__by"), F.col("__p").alias("__q")).agg(F.sum("tokens").alias("__n"))
    offsets = parts.withColumn("__before", F.sum("__n").over(W.partitionBy("__by").orderBy("__q")) - F.col("__n")).drop("__n")
    out = rows.withColumn("__running", running).join(offsets, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__p") == F.col("__q")))
    return out.withColumn("batch_no", F.floor((F.col("__running") + F.col("__before")) / room).cast("long")).select(*df.columns, "tokens", "batch_no")


def batch_token_totals(df: DataFrame, text: str, by: str = "batch_id") -> DataFrame:
    n = F.count("*")
    return df.groupBy(by).agg(n.alias("comments"), batch_tokens(estimate_tokens(F.coalesce(text, F.lit("")))).alias("request_tokens"), (F.floor(F.sum(F.length(F.coalesce(text, F.lit("")))) / 4) + 50 * n).cast("long").alias("simple_tokens"))


def prompts(df: DataFrame, text: str) -> DataFrame:
    """One prompt per batch: its comments in order under numbered heads. A batch is bounded by its size."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.col(text), F.lit("")).alias("txt"))))
    parts = F.transform(F.col("rows"), lambda r, i: F.concat(F.lit("COMENTARIO_"), (i + 1).cast("string"), F.lit(": "), r["txt"], F.lit("\n")))
    return df.groupBy("batch_id").agg(rows.alias("rows")).select("batch_id", F.size("rows").alias("n_comments"), F.array_join(parts, "---\n").alias("prompt"))


def batch_size(usage: Column, max_batch: int = MAX_BATCH) -> Column:
    """Comments per request from the state of the limits.

    ``usage`` is a struct: remaining_tokens, tokens_per_minute, remaining_requests,
    used_share (0 to 1) and rate_limit_streak.
    """
    by_tokens = F.lit((TOKENS_PER_REQUEST - PROMPT_TOKENS) // TOKENS_PER_COMMENT)
    low = usage["remaining_tokens"] < usage["tokens_per_minute"] * 0.2
    n = F.when(low, F.least(by_tokens, F.floor(usage["remaining_tokens"] / (2 * TOKENS_PER_COMMENT)))).otherwise(by_tokens)
    n = F.when(usage["remaining_requests"] < 5, F.least(n, F.lit(10))).otherwise(n)
    n = F.greatest(F.lit(1), F.least(n, F.lit(max_batch)))
    n = F.when(usage["rate_limit_streak"] >= 2, F.greatest(F.lit(5), F.floor(n / 4))).when(usage["rate_limit_streak"] >= 1, F.greatest(F.lit(8), F.floor(n / 2))).otherwise(n)
    n = F.when(usage["used_share"] > 0.7, F.floor(n * 0.6)).when(usage["used_share"] > 0.5, F.floor(n * 0.75)).otherwise(n)
    return F.greatest(F.lit(3), n).cast("int")


def size_now(spark: SparkSession, usage: dict[str, float], max_batch: int = MAX_BATCH) -> int:
    """The batch size for one state of the limits, whose fields are those of ``batch_size``."""
    state = F.struct(*[F.lit(v).alias(k) for k, v in usage.items()])
    return spark.range(1).select(batch_size(state, max_batch)).first()[0]


def advised_batch_size(used_share: Column, max_batch: int = MAX_BATCH) -> Column:
    """The plain advice: half the largest batch over 80 % use, three quarters over 60 %."""
    return F.when(used_share > 0.8, max(10, max_batch // 2)).when(used_share > 0.6, max(15, int(max_batch * 0.75))).otherwise(max_batch)
