"""Stage A: interests to candidate URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import urls
from tidemark.functions.text import strip
from tidemark.operators.ordering import first_of, limited
from tidemark.schemas import CANDIDATE
from tidemark.sources.fetch import Fetcher, reachable
from tidemark.sources.models import Model, answered

PROMPT = "Name recent news articles on the topic below as a JSON array of objects with title, url, source and date_iso (YYYY-MM-DD). Answer with the array only. Topic: "


def interests(text: Column) -> Column:
    """The keywords of a list: separated by commas, semicolons, line ends or ideographic commas, without inner white space."""
    parts = F.filter(F.split(text, "[,\\n;、]+"), lambda p: F.length(strip(p)) > 0)
    return F.transform(parts, lambda p: F.regexp_replace(p, "(?U)\\s+", ""))


def recipients(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), "(?U)[,\\s;]+")
    return F.filter(parts, lambda p: F.contains(p, F.lit("@")))


def answer_json(text: Column) -> Column:
    """The JSON array of an answer, rescued from a fenced block where the answer doesn't start with one."""
    text = strip(text)
    fenced = F.regexp_extract(text, "(?s)```json\\s*(.*?)\\s*```", 1)
    return F.when(text.startswith("[") | (fenced == ""), text).otherwise(strip(fenced))


def candidates(df: DataFrame, raw_col: str, config: Config, strict: bool = True) -> DataFrame:
    """Candidates of answers in `raw_col`: title, url, source, date_iso, is_article_url. What is no JSON array raises an error, or
    gives no rows if not strict."""
    raw = df.select(answer_json(F.coalesce(F.col(raw_col), F.lit(""))).alias("j"))
    items = F.from_json("j", "array<string>")  # element by element: one that is no object costs only itself
    valid = F.col("j").startswith("[") & items.isNotNull()
    if strict:
        items = F.when(valid, items).otherwise(F.raise_error(F.concat(F.lit("no JSON array: "), F.substring("j", 1, 200))).cast("array<string>"))
    objects = raw.select(F.explode(items).alias("o")).filter(F.ltrim("o").startswith("{"))
    rows = objects.select(F.from_json("o", f"struct<{CANDIDATE}>").alias("c")).select(F.coalesce("c.title", F.lit("")).alias("title"), strip(F.coalesce("c.url", F.lit(""))).alias("url"), F.coalesce("c.source", F.lit("")).alias("source"), "c.date_iso")
    kept = rows.filter(F.col("url").rlike("^https?://") & urls.in_domains(urls.host(F.col("url")), config.accepted_domains))
    return kept.withColumn("is_article_url", urls.looks_like_article(F.col("url")))


def discovered(df: DataFrame, config: Config, ord_col: str = "ord", url_col: str = "url") -> DataFrame:
    """The first of each URL that isn't blank, up to the limit of discovery."""
    return limited(first_of(df.filter(F.length(url_col) > 0), url_col, ord_col=ord_col), config.discovery_limit, ord_col)


def proposed(df: DataFrame, text_col: str, config: Config, model: Model | None, fetcher: Fetcher | None = None) -> DataFrame:
    """(ord, url) that a model proposes for the interests in `text_col`: an answer for each interest, its candidates, the first of each URL,
    those that can be reached if a fetcher is given, up to the limit. Without a model there is none."""
    words = df.select(F.explode(interests(F.col(text_col))).alias("interest")).distinct().withColumn("id", F.xxhash64("interest"))
    if model is None:
        return words.limit(0).select(F.lit(0).cast("bigint").alias("ord"), F.col("interest").alias("url"))
    asked = words.select("id", F.concat(F.lit(PROMPT), "interest").alias("t"))
    urls_ = candidates(answered(asked, "id", "t", model, 1), "answer", config, strict=False).select("url").distinct()
    rows = urls_.select(F.xxhash64("url").alias("ord"), "url")  # answers have no order of their own
    return discovered(reachable(rows, fetcher) if fetcher is not None else rows, config)
