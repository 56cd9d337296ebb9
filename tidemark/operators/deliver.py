"""Stage G: digests in parts, as plain text and HTML."""

from __future__ import annotations

import datetime as dt
import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.text import escape_html, strip
from tidemark.operators.ordering import chunked


def today(config: Config) -> str:
    """The date in the configured zone, or in UTC where there is no such zone."""
    try:
        zone: dt.tzinfo = zoneinfo.ZoneInfo(config.timezone)
    except (KeyError, ValueError):
        zone = dt.timezone.utc
    return dt.datetime.now(zone).strftime("%Y-%m-%d")


def subject(part: Column, total: Column, date: str, config: Config) -> Column:
    plain = f"{config.subject_prefix} {date}"
    return F.when(total > 1, F.concat(F.lit(plain + " ("), part.cast("string"), F.lit("/"), total.cast("string"), F.lit(")"))).otherwise(plain)


def plain_body(items: Column, config: Config) -> Column:
    """Numbered lines, a blank line and the footer; numbers start again in each part."""
    lines = F.transform(items, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), F.when(i < 99, 2).otherwise(F.length((i + 1).cast("string"))), F.lit("0")), F.lit(". "), strip(F.coalesce(x, F.lit("")))))
    return F.concat(F.array_join(lines, "\n"), F.lit(f"\n\n-- {config.footer}"))


def html_body(items: Column, config: Config) -> Column:
    """A page with the items as a list; they are escaped and keep their line breaks."""
    lines = F.transform(items, lambda x: F.concat(F.lit("<li>"), F.replace(escape_html(F.coalesce(x, F.lit(""))), F.lit("\n"), F.lit("<br>")), F.lit("</li>")))
    title, footer = escape_html(F.lit(config.subject_prefix)), escape_html(F.lit(config.footer))
    return F.concat(F.lit('<!doctype html>\n<html><head><meta charset="utf-8"><title>'), title, F.lit("</title></head><body><h1>"), title, F.lit("</h1><ol>"), F.array_join(lines, ""), F.lit("</ol><p>"), footer, F.lit("</p></body></html>\n"))


def rendered(df: DataFrame, item_col: str, date: str, config: Config, ord_col: str = "ord") -> DataFrame:
    """(part, total_parts, subject, plain, html), items in order. No rows for no items."""
    rows = chunked(df.select(F.col(ord_col).alias("ord"), F.col(item_col).alias("item")), config.items_per_mail)
    parts = rows.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("items"))  # a part has at most items_per_mail
    size = config.items_per_mail
    total = df.agg(F.greatest(F.ceil(F.count("*") / size) if size > 0 else F.lit(1), F.lit(1)).cast("int").alias("total_parts"))  # counted, not built
    both = parts.join(F.broadcast(total))  # one row
    return both.select("part", "total_parts", subject(F.col("part"), F.col("total_parts"), date, config).alias("subject"), plain_body(F.col("items"), config).alias("plain"), html_body(F.col("items"), config).alias("html"))
