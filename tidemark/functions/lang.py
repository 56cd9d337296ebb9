"""Language by script, as Column expressions: ja, zh, en (any Latin text) or other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let, strip

KANA = "[\\u3040-\\u309F\\u30A0-\\u30FF\\u31F0-\\u31FF]"
HAN = "[\\u4E00-\\u9FFF]"
#: fixed values
CHINESE_SIGNS = "[，。、《》「」！？；：]"
#: fixed values: signs that make a heading a decoration
SYMBOLS = "[~!@#$%^&*()_+\\-=\\[\\]{},.<>?/\\\\|\"'`：；・…—―※★☆◆■]"


def has_kana(text: Column) -> Column:
    return text.rlike(KANA)


def han_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HAN))


def han_ratio(text: Column) -> Column:
    return han_count(text) / F.greatest(F.length(text), F.lit(1))


def chinese_by_script(text: Column) -> Column:
    return ~has_kana(text) & (text.rlike(CHINESE_SIGNS) | (han_ratio(text) >= 0.10))


def chinese_like(text: Column) -> Column:
    """The translator's own test: it counts characters where chinese_by_script takes a share."""
    enough = han_count(text) >= F.greatest(F.lit(10), F.floor(F.length(text) * 0.08))
    return (F.length(text) > 0) & ~has_kana(text) & (text.rlike(CHINESE_SIGNS) | enough)


def _cut(text: Column) -> Column:
    """The text without a decorated heading and without URLs. A decorated text of one line leaves nothing."""
    first = F.substring_index(text, "\n", 1)
    symbols = F.regexp_count(first, F.lit(SYMBOLS)) / F.greatest(F.length(first), F.lit(1))
    rest = F.when(symbols >= 0.35, F.regexp_extract(text, "(?s)^[^\\n]*\\n(.*)$", 1)).otherwise(text)
    return F.when(F.contains(text, F.lit("://")), F.regexp_replace(rest, "https?://\\S+", " ")).otherwise(rest)


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit(""))


def _reduced(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[ \\t\\u3000]+", " "), " +\\n", "\n"), "\\n{3,}", "\n\n"))


def detection_text(text: Column) -> Column:
    """The text as it is classified: no decorated heading, no URLs, blanks reduced."""
    return _reduced(let(_plain(text), _cut))


def _label(cut: Column, rest: Column | None) -> Column:
    """Tests in the order of their cost: blanks are reduced only where the share of Han decides."""
    unknown = F.lit("other") if rest is None else F.coalesce(rest, F.lit("other"))
    latin = F.when(cut.rlike("[A-Za-z]"), "en").otherwise(unknown)
    return F.when(F.length(strip(cut)) == 0, "other").when(has_kana(cut), "ja").when(cut.rlike(CHINESE_SIGNS), "zh").when(~cut.rlike(HAN), latin).when(han_ratio(_reduced(cut)) >= 0.10, "zh").otherwise(unknown)


def classify(text: Column, rest: Column | None = None) -> Column:
    """The label of a text; `rest` decides what scripts can't (an optional library), 'other' without it."""
    return let(let(_plain(text), _cut), lambda cut: _label(cut, rest))


def labelled(df: DataFrame, text_col: str, name: str, rest: Column | None = None) -> DataFrame:
    """Adds the label as a column, step by step in projected columns, which keeps all of it in generated code."""
    steps = df.withColumn("_text", _plain(F.col(text_col))).withColumn("_cut", _cut(F.col("_text")))
    return steps.withColumn(name, _label(F.col("_cut"), rest)).drop("_text", "_cut")
