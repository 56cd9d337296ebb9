"""Stage D: languages of scraped records, in the forms that callers ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.lang import labelled
from tidemark.functions.text import language_sample, strip


def prepared(scrapes: DataFrame, config: Config) -> DataFrame:
    """`text` becomes what the language is decided on; rows that failed keep their place with a blank one."""
    return scrapes.withColumn("text", language_sample(F.col("ok"), F.col("title"), F.col("body"), config.sample_chars, config.min_body_chars))


def _blank(text_col: str):
    return F.length(strip(F.coalesce(F.col(text_col), F.lit("")))) == 0


def with_meta(df: DataFrame, chinese_only: bool = False, text_col: str = "text") -> DataFrame:
    """Adds lang and lang_reason; blank texts are 'unknown'. chinese_only keeps rows of Chinese only."""
    rows = labelled(df, text_col, "_lang").withColumn("lang", F.when(_blank(text_col), "unknown").otherwise(F.col("_lang"))).drop("_lang")
    rows = rows.withColumn("lang_reason", F.when(_blank(text_col), "empty").otherwise("ok"))
    return rows.filter(F.col("lang") == "zh") if chinese_only else rows


def compact(df: DataFrame, chinese_only: bool = False, ord_col: str = "ord", text_col: str = "text") -> DataFrame:
    """(ord, lang, text) without blank texts."""
    rows = labelled(df.filter(~_blank(text_col)).select(ord_col, F.col(text_col).alias("text")), "text", "lang").select(ord_col, "lang", "text")
    return rows.filter(F.col("lang") == "zh") if chinese_only else rows


def aligned(df: DataFrame, chinese_only: bool = False, ord_col: str = "ord", text_col: str = "text") -> DataFrame:
    """(ord, lang, text) of every row; what isn't wanted is blank in both."""
    rows = labelled(df.select(ord_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "_lang").withColumn("lang", F.when(_blank("text"), "").otherwise(F.col("_lang")))
    keep = (F.col("lang") != "") & ((F.col("lang") == "zh") | F.lit(not chinese_only))
    return rows.select(ord_col, F.when(keep, F.col("lang")).otherwise("").alias("lang"), F.when(keep, F.col("text")).otherwise("").alias("text"))
