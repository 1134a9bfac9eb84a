"""String functions over comments, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmeter.constants import CHURN_HIGH, CHURN_MEDIUM, ENTITIES, LEXICON_NEGATIVE, LEXICON_POSITIVE, MAX_COMMENT, MOJIBAKE, NPS_NEGATIVE, NPS_POSITIVE, PROMPT_TOKENS, SPANISH_INDICATORS

LETTERS = "a-zA-ZáéíóúÁÉÍÓÚñÑ"
#: White space as Python's strip() and \\s have it.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def count_of(c: Column, words: list[str]) -> Column:
    """How many of the words occur, each counted once."""
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(w)).cast("int") for w in words])


def clean_comment(c: Column, max_length: int = MAX_COMMENT) -> Column:
    """Trimmed, single-spaced, without odd symbols, cut at a word near ``max_length`` with '...'; null gives ''."""
    t = F.regexp_replace(normalize_space(strip(c)), r"[^a-zA-Z0-9 _.,!?¿¡()\-\p{L}\p{N}]+", "")
    at_word = lambda head: F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)).otherwise(head)
    return let(t, lambda x: F.coalesce(F.when(F.length(x) > max_length, F.concat(let(F.substring(x, 1, max_length), at_word), F.lit("..."))).otherwise(x), F.lit("")))


def nps_parse(c: Column) -> Column:
    """NPS in a text: a number from 0 to 10, a share of a known scale, or a word; else null."""
    return let(F.lower(strip(c)), _nps_of)


def _nps_of(v: Column) -> Column:
    number = lambda pattern: F.nullif(F.regexp_extract(v, pattern, 1), F.lit("")).try_cast("double")
    within = lambda x: F.when((x >= 0) & (x <= 10), x)
    ten = F.lit(10.0)
    found = [number(p) for p in (r"\b([0-9]|10)\b", r"nps[:\s]*([0-9]|10)", r"score[:\s]*([0-9]|10)", r"rating[:\s]*([0-9]|10)")]
    scaled = [within(number(r"(\d+)/10")), F.least(ten, number(r"(\d+)%") / 10), F.least(ten, number(r"(\d+)/5") * 2), F.least(ten, number(r"(\d+)/100") / 10)]
    # least() skips nulls: without a match there is no value.
    scaled = [scaled[0], *(F.when(F.regexp_like(v, F.lit(p)), x) for p, x in zip((r"\d+%", r"\d+/5", r"\d+/100"), scaled[1:], strict=True))]
    return F.coalesce(*found, *scaled, F.when(contains_any(v, NPS_POSITIVE), 9.0).when(contains_any(v, NPS_NEGATIVE), 3.0))


def nps_number(c: Column) -> Column:
    """A numeric NPS, kept from 0 to 10."""
    return F.when((c >= 0) & (c <= 10), c.cast("double"))


def to_number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def valid_comment(c: Column, least: int = 5) -> Column:
    return let(c, lambda x: (F.length(x) >= least) & (strip(x) != "") & F.regexp_like(x, F.lit(f"[{LETTERS}]")))


def fix_encoding(c: Column) -> Column:
    return replaced(c, MOJIBAKE)


def strip_html(c: Column) -> Column:
    return replaced(F.regexp_replace(c, "<[^>]+>", ""), ENTITIES)


def nfc(c: Column) -> Column:
    """Unicode NFC; Spark has no function for it."""

    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    # Below U+0300 there is no combining mark and nothing that NFC changes: such texts never leave the JVM.
    return F.coalesce(F.pandas_udf(f, "string")(F.when(F.regexp_like(c, F.lit(r"[^\x{0}-\x{2FF}]")), c)), c)


def without_accents(c: Column) -> Column:
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "".join(k for k in unicodedata.normalize("NFD", x) if unicodedata.category(k) != "Mn"), na_action="ignore")

    return F.pandas_udf(f, "string")(c)


def normalize_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def fix_punctuation(c: Column) -> Column:
    """Runs of end marks to their last one, no space before marks, one after an end mark before a letter."""
    c = F.regexp_replace(c, r"([.!?]){2,}", "$1")
    c = F.regexp_replace(c, r"(?U)\s+([.!?,:;])", "$1")
    return F.regexp_replace(c, rf"(?U)([.!?])\s*([{LETTERS}])", "$1 $2")


def expand_chat(c: Column) -> Column:
    for short, word in (("q", "que"), ("x", "por"), ("k", "que")):
        c = F.regexp_replace(c, rf"(?iU)\b{short}\b", word)
    return c


def limit_repeats(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)([^lr])\1{2,}", "$1$1")


def fix_common(c: Column) -> Column:
    return limit_repeats(expand_chat(fix_punctuation(c)))


def standard_marks(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "„‚—–", "\"'--"), r"\.{3,}", "...")


def before_form(c: Column) -> Column:
    return strip_html(fix_encoding(c))


def after_form(c: Column) -> Column:
    return strip(standard_marks(fix_common(normalize_space(c))))


def normalize_text(c: Column, accents: bool = True) -> Column:
    """Encoding, tags, Unicode form, space, Spanish fixes, marks; in this order."""
    return after_form((nfc if accents else without_accents)(before_form(c)))


def normalize_column(df: DataFrame, c: str, accents: bool = True) -> DataFrame:
    """``normalize_text`` of a column in place. What the Unicode form is taken of is a column of its own, which its test, its value and its fallback share."""
    return df.withColumn(c, before_form(F.col(c))).withColumn(c, after_form((nfc if accents else without_accents)(F.col(c))))


def normalize_light(c: Column) -> Column:
    return strip(fix_encoding(normalize_space(c)))


def normalization_stats(original: Column, normal: Column) -> Column:
    changes = F.size(F.filter(F.zip_with(F.split(original, ""), F.split(normal, ""), lambda a, b: a != b), lambda x: F.coalesce(x, F.lit(False))))
    return F.struct(
        F.length(original).alias("original_length"),
        F.length(normal).alias("normalized_length"),
        (F.length(normal) - F.length(original)).alias("length_change"),
        F.when((original == "") | (normal == ""), 0).otherwise(changes).alias("character_changes"),
        F.regexp_count(original, F.lit("<[^>]+>")).alias("html_tags_removed"),
        F.regexp_like(original, F.lit(r"(?U)\s{2,}")).alias("whitespace_normalized"),
    )


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def batch_tokens(tokens: Column, prompt: int = PROMPT_TOKENS) -> Column:
    """Tokens of a request (aggregate): prompt, comments, and half as many again for the response."""
    total = F.lit(prompt) + F.sum(tokens)
    return (total + F.floor(total * 0.5)).cast("long")


def churn_keywords(c: Column) -> Column:
    return let(F.lower(F.coalesce(c, F.lit(""))), lambda v: F.least(F.lit(1.0), count_of(v, CHURN_HIGH) * 0.3 + count_of(v, CHURN_MEDIUM) * 0.1))


def is_spanish(c: Column) -> Column:
    return let(F.lower(c), lambda v: count_of(v, SPANISH_INDICATORS) >= 2)


def lexicon_sentiment(c: Column) -> Column:
    mood = lambda good, bad: F.when(good & ~bad, "positive").when(bad & ~good, "negative").otherwise("neutral")
    return let(F.lower(c), lambda v: mood(contains_any(v, LEXICON_POSITIVE), contains_any(v, LEXICON_NEGATIVE)))


def has_negative_word(c: Column) -> Column:
    return F.coalesce(let(F.lower(c), lambda v: contains_any(v, LEXICON_NEGATIVE)), F.lit(False))
