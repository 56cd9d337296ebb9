"""Stage C: pages to titles and bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import html, urls
from tidemark.functions.text import clean, composed, without_title
from tidemark.sources.fetch import Fetcher, fetched

COLUMNS = ("ord", "input_url", "resolved_url", "status_code", "content_type", "extractor", "used_amp", "ok", "reason", "title", "body", "text", "chars")


def _read(pages: DataFrame, chain: list | None) -> DataFrame:
    usable = html.mentions_html_type(F.col("content_type")) & F.col("html").isNotNull() & F.col("error").isNull()
    return pages.withColumn("_page", F.when(usable, F.col("html"))).withColumn("_got", html.extracted(F.col("_page"), chain, raw=True))


def scraped(pages: DataFrame, config: Config, fetcher: Fetcher | None = None, chain: list | None = None) -> DataFrame:
    """One row for each page of (ord, url, final_url, status_code, content_type, html, error), in the schema of a scrape.
    Pages without a text are tried again at their AMP link, if a fetcher is given."""
    first = _read(pages, chain).withColumn("used_amp", F.lit(False))
    if config.follow_amp and fetcher is not None:
        retry = first.filter(F.col("_page").isNotNull() & F.col("_got.body").isNull()).withColumn("_amp", urls.amp_link(F.col("_page"))).filter("_amp is not null")
        again = fetched(retry.select("ord", F.col("_amp").alias("url")), fetcher).filter("error is null and html is not null")
        again = _read(again.join(retry.select("ord", F.col("url").alias("_url")), "ord").drop("url").withColumnRenamed("_url", "url"), chain).withColumn("used_amp", F.lit(True)).select(first.columns)
        first = first.join(again.select("ord"), "ord", "left_anti").unionByName(again)
    title, body = F.trim(F.coalesce(F.col("_got.title"), F.lit(""))), F.col("_got.body")
    rows = first.withColumn("title", F.when(body.isNotNull(), title)).withColumn("body", clean(without_title(title, body)))
    rows = rows.withColumn("_whole", composed(F.col("title"), F.col("body"), 1 << 30)).withColumn("text", composed(F.col("title"), F.col("body"), config.max_chars))
    reason = F.when(F.col("error").isNotNull(), F.concat(F.lit("exception:"), F.col("error"))).when(F.col("_page").isNull(), "non_html_or_fetch_error").when(body.isNull(), "no_extractor_matched").when(F.length("_whole") < config.min_chars, "too_short").otherwise("ok")
    rows = rows.withColumn("reason", reason).withColumn("ok", F.col("reason") == "ok").withColumn("extractor", F.col("_got.extractor"))
    rows = rows.withColumn("input_url", F.col("url")).withColumn("resolved_url", F.coalesce("final_url", "url")).withColumn("chars", F.coalesce(F.length("body"), F.lit(0)))
    return rows.select(*COLUMNS)
