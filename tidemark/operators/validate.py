"""Stage B: which fetched pages are articles, with one reason each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import HTML_TYPES, Config
from tidemark.functions import html, urls
from tidemark.functions.text import let
from tidemark.operators.ordering import capped, first_of, limited


def audited(pages: DataFrame, config: Config) -> DataFrame:
    """One row for each page of (ord, url, final_url, status_code, content_type, html, error): input_url, normalized_url, final_url,
    status_code, content_type, decision, reason, metrics. Cheap tests on the URL come first; metrics exist only for HTML.
    The status code is recorded and decides nothing."""
    rows = pages.withColumn("_head", html.shown_head(F.col("html"), config.head_bytes)).withColumn("normalized_url", urls.finalized(F.coalesce("url", F.lit("")), config.strip_amp))
    bad_scheme = ~urls.is_http(F.col("normalized_url"))
    root = F.lit(False) if config.allow_root_path else urls.is_root(F.col("normalized_url"))
    early = F.when(bad_scheme, "invalid_url_scheme").when(root, "root_like_path").when(F.col("error").isNotNull(), F.concat(F.lit("exception:"), F.col("error")))
    is_html = html.is_html_type(F.col("content_type"), HTML_TYPES) | html.html_signs(F.substring("_head", 1, config.sniff_bytes))
    rows = rows.withColumn("_early", F.coalesce(early, F.when(~F.coalesce(is_html, F.lit(False)), "non_html_content")))
    link = urls.canonical_link(F.col("_head"))
    landed = F.coalesce("final_url", "normalized_url")
    rows = rows.withColumn("_canonical", F.when(F.col("_early").isNull(), link)).withColumn("_landed", landed)
    if config.use_canonical:
        rows = rows.withColumn("_landed", F.coalesce(F.when(F.col("_canonical").isNotNull(), urls.safe_canonical(F.col("_landed"), F.col("_canonical"), config.strip_amp)), F.col("_landed")))
    rows = rows.withColumn("final_url", F.when(F.col("_early").isNull(), urls.finalized(F.col("_landed"), config.strip_amp)).otherwise(landed))

    def judged(m: Column) -> Column:
        silent = ~(m["has_title"] | m["has_article"] | m["has_time"] | m["has_jsonld"])
        gate = F.when(m["text_len"] < config.min_text_bytes, "too_short_text").when(m["text_ratio"] < config.min_text_ratio, "too_low_text_ratio").when(silent, "no_article_signals").otherwise("accepted_content_ready")
        return F.struct(m.alias("metrics"), gate.alias("reason"))

    measured = html.metrics_of(F.coalesce("_head", F.lit("")), config.min_text_bytes, config.min_text_ratio)
    rows = rows.withColumn("_judged", F.when(F.col("_early").isNull(), let(measured, judged)))
    rows = rows.withColumn("metrics", F.col("_judged.metrics")).withColumn("reason", F.coalesce("_early", "_judged.reason"))
    rows = rows.withColumn("decision", F.when(F.col("reason") == "accepted_content_ready", "accepted").otherwise("filtered"))
    return rows.select("ord", F.col("url").alias("input_url"), "normalized_url", "final_url", "status_code", "content_type", "decision", "reason", "metrics")


def accepted(audit: DataFrame, config: Config) -> DataFrame:
    """(ord, final_url) of the accepted pages: first of each URL, then the cap by host, then the limit."""
    rows = first_of(audit.filter(F.col("decision") == "accepted").select("ord", "final_url"), "final_url")
    rows = capped(rows, F.lower(urls.part(F.col("final_url"), urls.NETLOC)), config.per_host)
    return limited(rows, config.max_results) if config.max_results > 0 else rows
