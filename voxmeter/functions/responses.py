"""Raw batch responses: a table of JSON-like texts to one row per comment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmeter.constants import EMOTIONS
from voxmeter.functions.emotion import clamp, score_of
from voxmeter.functions.text import let



def extract_json(content: Column) -> Column:
    """The JSON part of a response: all of it, a fenced block, the widest array, the widest object, else all of it."""
    c = F.trim(content)
    found = lambda pattern, group: F.nullif(F.trim(F.regexp_extract(c, pattern, group)), F.lit(""))
    return F.when(F.regexp_like(c, F.lit(r"^[\[{]")), c).otherwise(F.coalesce(found(r"(?s)```json(.*?)```", 1), found(r"(?s)```[ ]*\n(.*?)```", 1), found(r"(?s)\[.*\]", 0), found(r"(?s)\{.*\}", 0), c))


def repair_json(c: Column) -> Column:
    """Mends what models often break: text around, trailing commas, bare keys, single and doubled quotes."""
    c = F.regexp_replace(F.regexp_replace(c, r"^[^\[{]*", ""), r"[^}\]]*$", "")
    c = F.regexp_replace(F.regexp_replace(c, r",\s*\}", "}"), r",\s*\]", "]")
    c = F.regexp_replace(c, r"(\w+):\s*", '"$1": ')
    c = F.replace(F.replace(c, F.lit("'"), F.lit('"')), F.lit('\\"'), F.lit('"'))
    return F.regexp_replace(c, r'""(\w+)""', '"$1"')


def part(v: Column, path: str, kind: str) -> Column:
    """What a parsed value has at a path, if it is of a kind; else null."""
    return F.try_variant_get(v, path, kind)


def is_object(v: Column) -> Column:
    return part(v, "$", "map<string,variant>").isNotNull()


def elements(v: Column) -> Column:
    """The elements of a parsed array, or the one object; null for anything else."""
    return F.coalesce(part(v, "$", "array<variant>"), F.when(is_object(v), F.array(v)))


def parsed(content: Column) -> Column:
    """An answer's elements as variants: it is parsed once, and once more only after a repair."""
    of = lambda text_: let(F.try_parse_json(text_), elements)
    return let(extract_json(content), lambda payload: F.coalesce(of(payload), of(repair_json(payload))))


def first_item(content: Column) -> Column:
    """The first element of an answer, if it is an object."""
    return let(F.try_element_at(parsed(content), F.lit(1)), lambda x: F.when(is_object(x), x))


def response_rows(df: DataFrame, content: str = "content", expected: str = "expected_count") -> DataFrame:
    """One row per expected comment: the other columns, pos (from 0) and item, the element as a variant where it is an object."""
    rows = df.withColumn("__items", parsed(F.col(content)))
    rows = rows.where(F.col(expected) > 0).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col(expected) - 1)))
    item = let(F.try_element_at("__items", F.col("pos") + 1), lambda x: F.when(is_object(x), x))
    return rows.withColumn("item", item).drop("__items", content)


def normalized(df: DataFrame, default_churn: float = 0.5) -> DataFrame:
    """item to the sixteen emotions, pain_points, churn_risk, sentiment and is_fallback; what is bad or missing gets its default."""
    j = lambda name, kind="string": part(F.col("item"), f"$.{name}", kind)
    points = F.filter(j("pain_points", "array<string>"), lambda x: x.isNotNull() & ~x.isin("", "0", "false"))
    mood = F.lower(j("sentiment"))
    return (
        df.withColumn("__e", j("emotions", "map<string,string>"))
        .withColumns({e: score_of(F.coalesce("__e", F.create_map().cast("map<string,string>")), e) for e in EMOTIONS})
        .withColumns({
            "pain_points": F.coalesce(points, F.array().cast("array<string>")),
            "churn_risk": clamp(F.coalesce(j("churn_risk").try_cast("double"), F.lit(default_churn))),
            "sentiment": F.when(mood.isin("positive", "negative", "neutral"), mood).otherwise("neutral"),
            "is_fallback": F.col("item").isNull(),
        })
        .drop("__e", "item")
    )


def valid_structure(item: Column) -> Column:
    """Whether an element has the four fields with their right kinds."""
    kinds = part(item, "$.emotions", "map<string,variant>").isNotNull() & part(item, "$.pain_points", "array<variant>").isNotNull()
    return F.coalesce(kinds & part(item, "$.churn_risk", "string").try_cast("double").isNotNull() & part(item, "$.sentiment", "string").isNotNull(), F.lit(False))


def parse_rates(rows: DataFrame, by: str = "batch_id") -> DataFrame:
    """Share of expected responses that parsed, in percent."""
    return rows.groupBy(by).agg((F.avg((~F.col("is_fallback")).cast("int")) * 100).alias("success_rate"))


def serialized_emotion_means(df: DataFrame, column: str = "emotions_json") -> DataFrame:
    """Mean of each emotion over all rows, from a column of serialised maps; rows that don't parse count as none."""
    n = df.agg(F.count("*").alias("n"))
    long = df.select(F.explode(F.from_json(column, "map<string,double>")).alias("emotion", "score")).groupBy("emotion").agg(F.sum("score").alias("total"))
    return long.crossJoin(F.broadcast(n)).select("emotion", (F.col("total") / F.col("n")).alias("mean"))
