"""Stage F: translations, with what was done to each text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.lang import chinese_like
from tidemark.functions.text import clip, strip
from tidemark.sources.models import Model, answered

# fixed values: what stands before texts that weren't translated
NOT_DONE, NOT_WANTED = "【翻訳未実施】", "【翻訳対象外（zh_only）】"


def translated(df: DataFrame, id_col: str, text_col: str, config: Config, model: Model | None = None, chinese_only: bool = False) -> DataFrame:
    """(id, src, ja, ok, engine, reason). Blank texts stay blank; without a model, and where it gives nothing, a text stands clipped
    behind a mark and counts as ok; chinese_only passes other texts over."""
    given = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), given.alias("_given"), strip(given).alias("_src"))
    kind = F.when(F.length("_src") == 0, "empty").when(F.lit(chinese_only) & ~chinese_like(F.col("_src")), "skip").otherwise("do")
    rows = rows.withColumn("_kind", kind)
    if model is None:
        rows = rows.withColumn("answer", F.lit(None).cast("string"))
    else:
        asked = rows.filter("_kind = 'do'").select("_id", clip(F.col("_src"), config.translation_chars).alias("_t"))
        rows = rows.join(answered(asked, "_id", "_t", model, config.translation_batch), "_id", "left")
    short = clip(F.col("_src"), config.clip_chars)
    ja = F.when(kind == "empty", "").when(F.col("_kind") == "skip", F.concat(F.lit(NOT_WANTED), short)).otherwise(F.coalesce(F.nullif(strip(F.col("answer")), F.lit("")), F.concat(F.lit(NOT_DONE), short)))
    engine = F.when(F.col("_kind") == "skip", "skip").when(F.col("_kind") == "do", "fallback" if model is None else model.name)
    reason = F.when(F.col("_kind") == "empty", "empty").when(F.col("_kind") == "skip", "zh_only_skip").otherwise("ok")
    return rows.select(F.col("_id").alias(id_col), F.when(F.col("_kind") == "do", F.col("_given")).otherwise(F.col("_src")).alias("src"), ja.alias("ja"), (F.col("_kind") != "empty").alias("ok"), engine.alias("engine"), reason.alias("reason"))
