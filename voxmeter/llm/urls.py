"""URL filters: host-suffix and path-prefix expressions joined with rules on short hashes.

Only DataFrame functions. A URL's expressions are made and joined in the task that read
it; before the one shuffle each task keeps one row per URL, so neither a common host nor
repeated rows can fill a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH_BITS = 32
#: Rules are broadcast up to this size, else joined by a shuffle on the short hash, each under ``SALTS`` keys, lest all URLs of a top-level rule meet in one task.
BROADCAST_BYTES = 64 << 20
RULE_BYTES = 200
SALTS = 32
#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def short_hash(expression: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(expression), 64 - HASH_BITS)


def directory(path: Column) -> Column:
    """The path up to its last slash, with it; empty if there is none."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of ``pages``: the id, host, path, rule (host || path of the longest that fits) and verdict.

    Expressions of a URL are its host's suffixes at label borders with each prefix of its
    path that ends in a slash, and with no path; of no more labels and slashes than some rule
    has, so a long host or path makes no more of them. A rule is filed under its host and the
    directory of its path; equal short hashes are confirmed by the expressions' full
    SHA-256 digests and by the rule's path being a prefix of the URL's. The longest rule
    wins, then the longest host, then ``allow``. Null and odd
    URLs have empty host and path, fit no rule and get ``default``; repeated rows are all
    kept; no rules or no rows are fine; other columns are ignored.
    """
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    own = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).dropna().where(F.col("r_host") != "")
    # One small job over the rules.
    known = own.agg(F.max(F.size(F.split("r_host", r"\."))).alias("labels"), F.max(F.regexp_count(directory(F.col("r_path")), F.lit("/"))).alias("slashes"), F.sum(F.octet_length("r_host") + F.octet_length("r_path") + RULE_BYTES).alias("bytes")).first()
    labels, slashes, size = (x or 0 for x in known)
    # The last ``labels`` labels, the last one first, and the path up to each of its first ``slashes`` slashes; split() itself stops there.
    parts = F.transform(F.slice(F.split(F.reverse("host"), r"\.", labels + 1), 1, max(labels, 1)), lambda x: F.reverse(x))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.reverse(F.slice(parts, 1, i)), "."))
    # What follows the last slash is no step. A path that does not begin with a slash cannot occur.
    steps = F.split("path", "/", slashes + 1)
    prefixes = F.concat(F.array(F.lit("")), F.when(F.size(steps) > 1, F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>")))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))
    # The null expression meets no rule, so it counts the row once.
    exploded = rows.select("id", "host", "path", F.explode(F.concat(F.array(F.lit(None).cast("string")), expressions)).alias("expression")).withColumn("short", F.when(F.col("expression").isNotNull(), short_hash(F.col("expression"))))
    own = own.withColumn("filed", F.concat("r_host", F.lit("\n"), directory(F.col("r_path")))).select(short_hash(F.col("filed")).alias("short"), F.sha2("filed", 256).alias("digest"), "r_host", "r_path", "r_verdict")
    on = ["short"]
    if size <= broadcast_bytes:
        own = F.broadcast(own)
    else:
        on = ["short", "salt"]
        own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        exploded = exploded.withColumn("salt", F.pmod(F.xxhash64("id", "host", "path"), F.lit(SALTS)).cast("int"))
    fits = F.col("digest").isNotNull() & (F.col("digest") == F.sha2("expression", 256)) & F.startswith(F.col("path"), F.col("r_path"))
    rule = F.when(fits, F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("n_host"), F.concat("r_host", "r_path").alias("rule"), F.when(F.col("r_verdict") == "allow", 1).otherwise(0).alias("first"), F.col("r_verdict").alias("verdict")))
    best = exploded.join(own, on, "left").groupBy("id", "host", "path").agg(F.count_if(F.col("expression").isNull()).alias("rows"), F.max(rule).alias("best"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy")).drop("copy")
