"""Reading comment tables, checking their columns, paging, and writing reports."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxmeter.constants import ALIASES, EMOTIONS, EXACT_RENAMES, REQUIRED_COLUMNS
from voxmeter.sources.scratch import scratch_path

FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc"}


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """A comment table by its extension; CSV is UTF-8 with a header, all columns text."""
    kind = FORMATS.get(path.rstrip("/").rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"unknown format: {path}")
    reader = spark.read
    if kind == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"', encoding="UTF-8")
    return reader.format(kind).load(path)


#: Where a row was read: its file, its part of the file, and a number that grows within the part.
FILE, PART, NUMBER = "__file", "__part", "__number"


def with_origin(read: DataFrame) -> DataFrame:
    """Rows just read from files, with the file and the part of it that they come from."""
    return read.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(PART))


def with_row_number(df: DataFrame, name: str) -> DataFrame:
    """Adds the row's place from 0 in the order of the files' names and of the rows in them, without moving a row.

    ``df`` was written with ``NUMBER``, a monotonically increasing id given in the pass that
    read the rows. One small row per part of a file tells how many come before it.
    """
    parts = df.groupBy(FILE, PART).agg(F.min(NUMBER).alias("__low"), F.count("*").alias("__n"))
    before = parts.select(F.col(FILE).alias("__f"), F.col(PART).alias("__q"), "__low", (F.sum("__n").over(W.orderBy(FILE, PART)) - F.col("__n")).alias("__before"))
    # A part is up to 128 MB of a file by default, so this is a row of some hundred bytes for each of them.
    joined = df.join(F.broadcast(before), (F.col(FILE) == F.col("__f")) & (F.col(PART) == F.col("__q")))
    return joined.withColumn(name, F.col("__before") + F.col(NUMBER) - F.col("__low")).drop(FILE, PART, NUMBER, *before.columns)


def missing_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    if missing := missing_columns(df, required):
        raise ValueError(f"missing columns: {missing}")
    return df


def rename_columns(df: DataFrame) -> DataFrame:
    """Trimmed names, fixed renames, then aliases in any case; two columns for one name are an error."""
    of = {alias: name for name, aliases in ALIASES.items() for alias in aliases}
    names = [EXACT_RENAMES.get(c.strip(), c.strip()) for c in df.columns]
    names = [of.get(c.lower(), c) for c in names]
    if twice := sorted({c for c in names if names.count(c) > 1}):
        raise ValueError(f"several columns are named {twice}")
    return df.toDF(*names)


def table_info(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """One row: number of rows and columns, their names, whether all required ones are there, and which are not."""
    missing = missing_columns(df, required)
    words = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_columns"), words(df.columns).alias("column_names"), F.lit(not missing).alias("has_required"), words(missing).alias("missing"))


def preview(df: DataFrame, order: str, n: int = 5, preferred: list[str] | None = None) -> DataFrame:
    """The first n rows by ``order``, of the preferred columns that exist."""
    columns = [c for c in preferred if c in df.columns] if preferred else df.columns
    return df.orderBy(order).limit(n).select(*columns)


EXPORT_PREVIEW = ["comment_id", "nps", "nota", "comment", "nps_category", "churn_risk", *EMOTIONS[:5]]


@dataclass
class Pages:
    """A result in its order, written once, with how many rows each of its ranges has: pages are read by pushed-down filters, from the row groups that hold them."""

    rows: DataFrame
    before: list[int]

    @property
    def n_rows(self) -> int:
        return self.before[-1]

    def page(self, number: int, size: int = 100, current: int = 0) -> DataFrame:
        """Page ``number`` from 0, in order; a page that does not exist gives the current one."""
        at = number if 0 <= number < -(-self.n_rows // size) else current
        low, high = at * size, min((at + 1) * size, self.n_rows)
        wanted = F.lit(False)
        for p in range(max(0, bisect_right(self.before, low) - 1), len(self.before) - 1):
            if self.before[p] >= high:
                break
            if self.before[p + 1] > low:
                wanted = wanted | ((F.col("__p") == p) & (F.col("__r") >= low - self.before[p]) & (F.col("__r") < high - self.before[p]))
        # No more rows than a page has.
        return self.rows.where(wanted).coalesce(1).sortWithinPartitions("__p", "__r").drop("__p", "__r")


#: monotonically_increasing_id() is the partition's number and, in this many lower bits, the row's place in it.
PLACE_BITS = 33
#: Bytes of a row group of a paged result.
GROUP_BYTES = 8 << 20


def pages(df: DataFrame, *order: str) -> Pages:
    """``df`` sorted by ranges and written to the shared folder. Equal keys keep the places they got."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    rows = rows.withColumns({"__p": F.shiftright("__m", PLACE_BITS), "__r": F.col("__m").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}).drop("__m")
    path = scratch_path(df.sparkSession, "pages")
    rows.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    rows = df.sparkSession.read.parquet(path)
    # A number for each range.
    counts = {r[0]: r[1] for r in rows.groupBy("__p").count().collect()}
    return Pages(rows, [0, *accumulate(counts.get(p, 0) for p in range(max(counts, default=-1) + 1))])


def page(df: DataFrame, order: str, number: int, size: int = 100, current: int = 0) -> DataFrame:
    """One page; who wants several keeps what ``pages`` gives."""
    return pages(df, order).page(number, size, current)


def page_count(df: DataFrame, size: int = 100) -> DataFrame:
    return df.agg(F.ceil(F.count("*") / size).cast("long").alias("pages"))


def drop_internal(df: DataFrame, keep_raw: bool = False) -> DataFrame:
    return df if keep_raw else df.drop(*[c for c in df.columns if c.startswith("_") or c in ("index", "temp_path")])


def drop_emotions(df: DataFrame) -> DataFrame:
    return df.drop(*EMOTIONS, *[c for c in df.columns if c.startswith("emo_")])


def write_csv(bundle: dict[str, DataFrame], path: str) -> None:
    """The main dataset of a bundle, else its first. Arrays become text."""
    df = bundle.get("Analisis_Completo") or next(iter(bundle.values()))
    flat = [F.array_join(c, ", ").alias(c) if kind.startswith("array<string") else F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).mode("overwrite").csv(path)


def write_json(bundle: dict[str, DataFrame], path: str) -> None:
    """Each dataset as JSON records in a directory of its own."""
    for name, df in bundle.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


MANIFEST = "number long, version string, format string, datasets array<string>"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """The bundles committed under ``path``, none if there is nothing."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def write_bundle(bundle: dict[str, DataFrame], path: str, kind: str = "json") -> None:
    """All datasets as one: they are written to a new folder, and a manifest that names it is added when the last one is complete.

    ``read_bundle`` follows the newest manifest, so an export that dies leaves the bundle
    before it, or none, never half of one. Works on any store that Spark writes to.
    """
    spark, version = next(iter(bundle.values())).sparkSession, uuid.uuid4().hex
    number = (manifests(spark, path).agg(F.max("number")).first()[0] or 0) + 1
    for name, df in bundle.items():
        df.write.format(kind).save(f"{path}/data-{version}/{name}")
    # One small file, in its place when its job commits.
    spark.createDataFrame([(number, version, kind, list(bundle))], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The datasets of the newest complete bundle under ``path``."""
    newest = manifests(spark, path).orderBy(F.desc("number"), F.desc("version")).first()
    if newest is None:
        raise ValueError(f"no complete bundle under {path}")
    return {name: spark.read.format(newest.format).load(f"{path}/data-{newest.version}/{name}") for name in newest.datasets}


def write_parquet(bundle: dict[str, DataFrame], path: str) -> None:
    for name, df in bundle.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
