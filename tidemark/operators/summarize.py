"""Stage E: sentences, their rank by term frequency, and extractive summaries.

A text's sentences depend on that text alone: they are cut, glued and ranked row by row, in Arrow batches, and nothing is exchanged.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.lang import HAN
from tidemark.functions.text import BLANKS, LINE_ENDS, clip, strip
from tidemark.sources.models import Model, answered

SHORT_SENTENCE, TITLE_CHARS, LAST_RESORT = 12, 80, 400
_ENDS, _HAN = re.compile("(?<=[。！？!?\n])"), re.compile(HAN)


def sentence_array(text: Column) -> Column:
    """Sentences end after 。！？!? or a line end; blank ones are dropped."""
    parts = F.split(text, "(?<=[。！？!?\\n])")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 0)


def _merged(text: str) -> list[str]:
    """The sentences; those of fewer than 12 characters belong to the one before, glued without a blank."""
    out: list[str] = []
    for s in _ENDS.split(text):
        s = s.strip(BLANKS)
        if out and s and len(s) < SHORT_SENTENCE:
            out[-1] += s
        elif s:
            out.append(s)
    return [s.strip(BLANKS) for s in out]


def _scored(text: str) -> list[tuple[int, str, float]]:
    """(i, sentence, score): the sum of the text's counts of its ideographs, x 0.6 for fewer than 15 characters, x 0.8 for more than 120."""
    rows = _merged(text)
    found = [_HAN.findall(s) for s in rows]
    counts = Counter(c for x in found for c in x)
    return [(i, s, sum(counts[c] for c in x) * (0.6 if len(s) < 15 else 0.8 if len(s) > 120 else 1.0)) for i, (s, x) in enumerate(zip(rows, found))]


def merged_sentences(text: Column) -> Column:
    """array<string> of a text's sentences, short ones glued to the one before."""
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _merged(t) for t in texts], dtype=object)

    return run(text)


def best_sentences(text: Column, top: int) -> Column:
    """array<struct<rank, i, sentence, score>> of a text's best sentences; earlier ones first among equals."""
    @F.pandas_udf("array<struct<rank:int,i:int,sentence:string,score:double>>")
    def run(texts: pd.Series) -> pd.Series:
        def best(t: str) -> list[dict]:
            chosen = sorted(_scored(t), key=lambda x: (-x[2], x[0]))[:top]
            return [{"rank": k + 1, "i": i, "sentence": s, "score": float(n)} for k, (i, s, n) in enumerate(chosen)]

        return pd.Series([None if t is None else best(t) for t in texts], dtype=object)

    return run(text)


def sentences(df: DataFrame, id_col: str, text_col: str, merge: bool = True) -> DataFrame:
    """(id, i, sentence), numbered from 0. Null and blank texts have no rows; repeated ids are cut separately."""
    parts = merged_sentences(F.col(text_col)) if merge else sentence_array(F.col(text_col))
    return df.select(id_col, F.posexplode(parts).alias("i", "sentence"))


def ranked(df: DataFrame, id_col: str, text_col: str, top: int) -> DataFrame:
    """(id, rank, i, sentence, score) of the best sentences."""
    return df.select(id_col, F.explode(best_sentences(F.col(text_col), top)).alias("x")).select(id_col, "x.*")


def extractive(df: DataFrame, id_col: str, text_col: str, config: Config) -> DataFrame:
    """(id, summary): a first line of at most 80 characters as title, and the best sentences of the rest as bullets. Blank texts have
    a blank summary."""
    text = clip(strip(F.coalesce(F.col(text_col), F.lit(""))), config.summary_chars)
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_lines", F.filter(F.transform(F.split("_text", LINE_ENDS), strip), lambda x: F.length(x) > 0))
    titled = (F.size("_lines") > 0) & (F.length(F.get("_lines", F.lit(0))) <= TITLE_CHARS)
    rest = F.when(titled, F.slice("_lines", F.lit(2), F.size("_lines"))).otherwise(F.col("_lines"))
    rows = rows.select("_id", "_text", F.when(titled, F.get("_lines", F.lit(0))).alias("_title"), clip(F.array_join(rest, "\n"), config.summary_chars).alias("_body"))
    joined = rows.withColumn("p", best_sentences(F.col("_body"), config.bullets))
    bullets = F.coalesce(F.array_join(F.transform("p", lambda x: F.concat(F.lit("• "), x["sentence"])), "\n"), F.lit(""))
    summary = F.when(F.col("_title").isNotNull(), F.concat("_title", F.lit("\n"), bullets)).when(bullets != "", bullets).otherwise(clip(F.col("_text"), LAST_RESORT))
    return joined.select(F.col("_id").alias(id_col), F.when(F.length("_text") == 0, "").otherwise(summary).alias("summary"))


def summarized(df: DataFrame, id_col: str, text_col: str, config: Config, model: Model | None = None) -> DataFrame:
    """(id, summary) by a model, the extractive one where it gives nothing."""
    plain = extractive(df, id_col, text_col, config)
    if model is None:
        return plain
    asked = answered(df.select(id_col, clip(strip(F.coalesce(F.col(text_col), F.lit(""))), config.summary_chars).alias("_t")), id_col, "_t", model, config.summary_batch)
    return plain.join(asked, id_col, "left").select(id_col, F.when(F.col("summary") == "", "").otherwise(F.coalesce(F.nullif(strip(F.col("answer")), F.lit("")), "summary")).alias("summary"))
