"""Queries over the tables: one for each operator of the pipeline, each over its whole table. Their SQL is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import HTML_TYPES, Config
from tidemark.functions import html, lang, text, urls
from tidemark.operators import deliver, discover, ordering, scrape, summarize, tagging, translate, validate
from tidemark.plans import fixtures as fx
from tidemark.plans import oracles, pipeline
from tidemark.sources.fetch import StoredFetcher, reachable

DATE = "2025-03-01"
#: the hosts of the test tables use reserved domains
CONFIG = Config(accepted_domains=("example", "test"), max_results=0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped records as the pages that they could have been."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<!doctype html><html><head><title>"), safe(F.coalesce("title", F.lit(""))), F.lit("</title></head><body><nav>Home</nav><article><p>"), F.replace(safe(F.col("body")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article></body></html>"))
    return _table(spark, sf_dir, "scrape_meta").select(F.col("scrape_id").alias("ord"), F.col("input_url").alias("url"), F.col("resolved_url").alias("final_url"), "status_code", "content_type", page.alias("html"), F.lit(None).cast("string").alias("error"))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("input_url")
    return _table(spark, d, "scrape_meta").select("scrape_id", urls.part(u, urls.SCHEME).alias("scheme"), urls.part(u, urls.NETLOC).alias("netloc"), urls.host(u).alias("host"), urls.part(u, urls.PATH).alias("path"), urls.part(u, urls.QUERY).alias("query"), urls.is_http(u).alias("is_http"), urls.is_root(u).alias("is_root"))


def url_strip_tracking(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "validation_meta").select("validation_id", "ingested_at", urls.without_tracking(F.col("input_url")).alias("url"))


def url_finalize(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "scrape_meta").select("scrape_id", urls.finalized(F.col("input_url")).alias("url"))


def url_deamp(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "scrape_meta").select("scrape_id", urls.without_amp(F.col("input_url")).alias("clean"))


def url_repair(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "candidates").select("cand_id", "discovered_at", urls.repaired(F.col("url")).alias("repaired"), urls.finalized(F.col("url")).alias("final"))


def url_canonical_safe(spark: SparkSession, d: str) -> DataFrame:
    """The URL asked for as the canonical link of the page it led to, and the other way round."""
    a, b = F.col("input_url"), F.col("resolved_url")
    return _table(spark, d, "scrape_meta").select("scrape_id", urls.safe_canonical(b, a).alias("asked"), urls.safe_canonical(a, b).alias("landed"))


def url_quote(spark: SparkSession, d: str) -> DataFrame:
    """URLs with the title as a last piece, which holds characters beyond ASCII, blanks and quotes."""
    return _table(spark, d, "scrape_meta").select("scrape_id", urls.quoted(F.concat(F.coalesce("resolved_url", F.lit("")), F.lit("/"), F.coalesce("title", F.lit("")))).alias("quoted"))


def root_and_scheme_reject(spark: SparkSession, d: str) -> DataFrame:
    """Of the URLs as they are and of the sites' roots."""
    rows = _table(spark, d, "scrape_meta").select("scrape_id", F.explode(F.array(F.col("input_url"), F.regexp_extract("input_url", "^(?:[a-z]+://)?[^/?#]+/?", 0))).alias("url")).filter("url is not null")
    u = urls.finalized(F.col("url"))
    reason = F.when(~urls.is_http(u), "invalid_url_scheme").when(urls.is_root(u), "root_like_path").otherwise("kept")
    return rows.select("scrape_id", "url", reason.alias("reason"))


def article_url_flag(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "candidates").select("cand_id", "discovered_at", urls.looks_like_article(F.col("url")).alias("is_article_url"))


def whitelist_semi_join(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _table(spark, d, "candidates").filter(urls.in_domains(urls.host(urls.finalized(u)), CONFIG.accepted_domains)).select("cand_id", "discovered_at", "url")


def candidates_json(spark: SparkSession, d: str) -> DataFrame:
    """Candidates as the answers that a model could have given: bare arrays, and arrays in a fenced block after some words."""
    rows = _table(spark, d, "candidates")
    array = F.to_json(F.array(F.struct("title", "url", "source", "date_iso")))
    raw = F.when(F.col("cand_id") % 2 == 0, array).otherwise(F.concat(F.lit("Here they are:\n```json\n"), array, F.lit("\n```\n")))
    return discover.candidates(rows.select(raw.alias("raw")), "raw", CONFIG).select("title", "url", "source", "date_iso", "is_article_url")


def interests_split(spark: SparkSession, d: str) -> DataFrame:
    return fx.frame(spark, fx.LISTS, "ord bigint, list string").select("ord", F.posexplode(discover.interests(F.col("list"))).alias("k", "interest"))


def recipients_split(spark: SparkSession, d: str) -> DataFrame:
    return fx.frame(spark, fx.ADDRESSES, "ord bigint, list string").select("ord", F.posexplode(discover.recipients(F.col("list"))).alias("k", "address"))


def discovery_probe(spark: SparkSession, d: str) -> DataFrame:
    stored = StoredFetcher((("https://example.com/a", 200, "text/html", b"<p>x</p>"), ("https://example.com/b", 404, "text/html", b""), ("https://example.com/c", 200, "application/pdf", b"")))
    asked = spark.createDataFrame([(1, "https://example.com/a"), (2, "https://example.com/a"), (3, "https://example.com/b"), (4, "https://example.com/c"), (5, "https://example.com/d"), (6, "")], "ord bigint, url string")
    return reachable(asked, stored)


def discovery_first(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "candidates").select(F.col("cand_id").alias("ord"), "url")
    return discover.discovered(rows, Config(max_articles=40), "ord").select("ord", "url")


def html_sniff_type(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).withColumn("html", F.when(F.col("ord") % 3 == 0, F.regexp_replace("html", "(?s)^.*?<body>", "")).otherwise(F.col("html")))
    return rows.select("ord", html.is_html_type(F.col("content_type"), HTML_TYPES).alias("by_type"), html.mentions_html_type(F.col("content_type")).alias("mentioned"), F.coalesce(html.looks_like_html(F.col("html"), 8192), F.lit(False)).alias("by_content"))


def html_type_counts(spark: SparkSession, d: str) -> DataFrame:
    ct = F.col("content_type")
    return _table(spark, d, "scrape_meta").groupBy(html.is_html_type(ct, HTML_TYPES).alias("by_type"), html.mentions_html_type(ct).alias("mentioned")).agg(F.count("*").alias("records"))


def content_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = html.metrics(F.col("html"), CONFIG.head_bytes, CONFIG.min_text_bytes, CONFIG.min_text_ratio)
    return _pages(spark, d).filter("html is not null").select("ord", m.alias("m")).select("ord", "m.*")


def content_gate(spark: SparkSession, d: str) -> DataFrame:
    return validate.audited(_pages(spark, d), CONFIG).select("ord", "decision", "reason")


def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return validate.audited(_pages(spark, d), CONFIG).groupBy("decision", "reason").agg(F.count("*").alias("pages"))


def url_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "scrape_meta").select(F.col("scrape_id").alias("ord"), urls.finalized(F.col("input_url")).alias("url"))
    return ordering.first_of(rows, "url").select("ord", "url")


def url_domain_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "scrape_meta").select(F.col("scrape_id").alias("ord"), urls.finalized(F.col("input_url")).alias("url"))
    first = ordering.first_of(rows, "url")
    return ordering.capped(first, F.lower(urls.part(F.col("url"), urls.NETLOC)), 2).select("ord", "url")


def validate_accepted(spark: SparkSession, d: str) -> DataFrame:
    return validate.accepted(validate.audited(_pages(spark, d), CONFIG), Config(max_results=40)).select("ord", "final_url")


def audit_latest(spark: SparkSession, d: str) -> DataFrame:
    """The audit log without lines that were delivered again: the latest of each, and how many there were."""
    rows = _table(spark, d, "validation_meta")
    latest = rows.groupBy("validation_id").agg(F.max_by(F.struct("ingested_at", "final_url", "decision", "reason"), "ingested_at").alias("x"), F.count("*").alias("lines"))
    return latest.select("validation_id", "x.*", "lines")


def audit_reasons(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metrics")
    rows = _table(spark, d, "validation_meta")
    return rows.groupBy("decision", "reason").agg(F.count("*").alias("lines"), F.sum("elapsed_ms").alias("elapsed_ms"), F.count_if(m["text_len"] < 400).alias("short"), F.max(m["score_hint"]).alias("best_score"))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("clean"))


def clip_ellipsis(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", text.clip(F.col("text"), 200).alias("clipped"))


def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", F.replace(text.escape_html(F.col("text")), F.lit("\n"), F.lit("<br>")).alias("safe"))


def strip_title_dup(spark: SparkSession, d: str) -> DataFrame:
    t, b = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))
    doubled = F.concat(t, F.when(F.col("scrape_id") % 2 == 0, "\n").otherwise(" | \n"), b)
    return _table(spark, d, "scrape_meta").select("scrape_id", text.without_title(t, doubled).alias("without"), text.without_title(t, b).alias("plain"))


def compose_text(spark: SparkSession, d: str) -> DataFrame:
    t, b = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))
    return _table(spark, d, "scrape_meta").select("scrape_id", text.composed(t, b, 12000).alias("text"))


def source_choice(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "scrape_meta").select("scrape_id", text.chosen_source(F.col("body"), F.col("text")).alias("source"))


def scrape_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What scraping the pages gives; the pages are read, cleaned and judged."""
    return scrape.scraped(_pages(spark, d), CONFIG).groupBy("reason", "extractor").agg(F.count("*").alias("records"), F.count_if("ok").alias("ok"))


def scrape_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The outcomes that the table records."""
    return _table(spark, d, "scrape_meta").groupBy("reason", "extractor").agg(F.count("*").alias("records"), F.count_if("ok").alias("ok"), F.sum("chars").alias("chars"))


def normalize_html(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("ord", html.normalized(F.col("html")).alias("html"))


def extract_article(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("ord", html.extracted(F.col("html"), raw=True).alias("x")).select("ord", "x.title", "x.body", "x.extractor")


def extract_fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.createDataFrame([(1, "<article>one</article>"), (2, "<body></body>"), (3, None), (4, "<meta property='og:title' content='T'><p>plain</p>")], "ord bigint, html string")
    chain = [("json", lambda p: ("j", p) if p.startswith("{") else None), ("html", html.extract)]
    return pages.select("ord", html.extracted(F.col("html"), chain).alias("x")).select("ord", "x.*")


def amp_link(spark: SparkSession, d: str) -> DataFrame:
    """The AMP links of heads that write them in several ways; every fifth has none."""
    u, q, k = F.col("input_url"), F.lit('"'), F.col("scrape_id") % 5
    before, after = F.lit("<head><title>x</title><link rel=canonical href=/c>"), F.lit("</head><body><link rel='amphtml' href='https://example.com/second'></body>")
    link = F.when(k == 0, "").when(k == 1, F.concat(F.lit('<link rel="amphtml" href="'), u, q, F.lit(">"))).when(k == 2, F.concat(F.lit('<LINK href="'), u, F.lit('" rel="alternate amphtml">')))
    link = link.when(k == 3, F.concat(F.lit("<link rel='amphtml'\n href='"), u, F.lit("'>"))).otherwise(F.concat(F.lit("<link data-x=1 rel=amphtml href="), u, F.lit(" >")))
    rows = _table(spark, d, "scrape_meta").filter("input_url is not null")
    return rows.select("scrape_id", urls.amp_link(F.concat(before, link, F.when(k == 0, "</head>").otherwise(after))).alias("amp"))


def decode_charset(spark: SparkSession, d: str) -> DataFrame:
    cases = [("中文".encode("gbk"), "text/html; charset=gbk"), ('<meta charset="shift_jis">日本'.encode("shift_jis"), "text/html"), ("é".encode(), None), (b"\xff\xfe&amp;", "text/html; charset=utf-8"), (None, None)]
    rows = spark.createDataFrame([(k, bytearray(b) if b is not None else None, t) for k, (b, t) in enumerate(cases)], "ord bigint, raw binary, content_type string")
    return rows.select("ord", html.decoded(F.col("raw"), F.col("content_type")).alias("html"))


def lang_script_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _table(spark, d, "documents").select("doc_id", lang.has_kana(t).alias("kana"), lang.han_count(t).alias("han"), lang.chinese_by_script(t).alias("chinese"), lang.chinese_like(t).alias("chinese_like"))


def lang_classify(spark: SparkSession, d: str) -> DataFrame:
    return lang.labelled(_table(spark, d, "documents").select("doc_id", "text"), "text", "script_lang").select("doc_id", "script_lang")


def lang_counts(spark: SparkSession, d: str) -> DataFrame:
    return lang.labelled(_table(spark, d, "documents").select("text"), "text", "script_lang").groupBy("script_lang").agg(F.count("*").alias("texts"))


def lang_vs_label(spark: SparkSession, d: str) -> DataFrame:
    return lang.labelled(_table(spark, d, "lang_items").select("text", "lang"), "text", "script_lang").groupBy("script_lang", "lang").agg(F.count("*").alias("items"))


def lang_classify_cjk(spark: SparkSession, d: str) -> DataFrame:
    """By the Column, over titles and bodies."""
    return _table(spark, d, "scrape_meta").select("scrape_id", lang.classify(F.col("title")).alias("title_lang"), lang.classify(F.col("body")).alias("body_lang"))


def lang_with_meta(spark: SparkSession, d: str) -> DataFrame:
    return tagging.with_meta(_table(spark, d, "lang_items").select("item_id", "text")).select("item_id", "lang", "lang_reason")


def lang_compact_zh(spark: SparkSession, d: str) -> DataFrame:
    return tagging.compact(_table(spark, d, "lang_items"), True, "item_id").select("item_id", "lang", "text")


def lang_aligned_zh_only(spark: SparkSession, d: str) -> DataFrame:
    return tagging.aligned(_table(spark, d, "lang_items"), True, "item_id")


def zh_like_translator(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lang_items").select("item_id", F.coalesce(lang.chinese_like(F.col("text")), F.lit(False)).alias("like"))


def lang_sample(spark: SparkSession, d: str) -> DataFrame:
    return tagging.prepared(_table(spark, d, "scrape_meta"), CONFIG).select("scrape_id", "text")


def detect_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lang_items").select("item_id", lang.detection_text(F.col("text")).alias("plain"))


def detect_normalize_cases(spark: SparkSession, d: str) -> DataFrame:
    """Of texts with a decorated heading and a URL in front."""
    heading = F.when(F.col("item_id") % 3 == 0, "★☆★ !!!\n").when(F.col("item_id") % 3 == 1, "news ★\r\nhttps://example.com/x?y=1 ").otherwise("")
    return _table(spark, d, "lang_items").select("item_id", lang.detection_text(F.concat(heading, F.coalesce("text", F.lit("")))).alias("plain"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return summarize.sentences(_table(spark, d, "documents"), "doc_id", "text", merge=False)


def sentence_merge_short(spark: SparkSession, d: str) -> DataFrame:
    return summarize.sentences(_table(spark, d, "documents"), "doc_id", "text")


def tf_sentence_rank(spark: SparkSession, d: str) -> DataFrame:
    return summarize.ranked(_table(spark, d, "documents"), "doc_id", "text", 5)


def tf_sentence_rank_cjk(spark: SparkSession, d: str) -> DataFrame:
    return summarize.ranked(_table(spark, d, "scrape_meta"), "scrape_id", "body", 5)


def summary_extractive(spark: SparkSession, d: str) -> DataFrame:
    return summarize.extractive(_table(spark, d, "documents"), "doc_id", "text", CONFIG)


def summary_cjk(spark: SparkSession, d: str) -> DataFrame:
    return summarize.extractive(_table(spark, d, "scrape_meta"), "scrape_id", "body", CONFIG)


def translate_fallback(spark: SparkSession, d: str) -> DataFrame:
    return translate.translated(_table(spark, d, "documents"), "doc_id", "text", CONFIG).select("doc_id", "ja", "ok", "engine", "reason")


def translate_meta_zh_only(spark: SparkSession, d: str) -> DataFrame:
    return translate.translated(_table(spark, d, "documents"), "doc_id", "text", CONFIG, chinese_only=True).select("doc_id", "ja", "ok", "engine", "reason")


def digest_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select(F.col("doc_id").alias("ord"))
    return ordering.chunked(rows, 20).groupBy("part").agg(F.count("*").alias("items"), F.min("ord").alias("first"), F.max("ord").alias("last"))


def _mails(spark: SparkSession, d: str) -> DataFrame:
    return deliver.rendered(_table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("item")), "item", DATE, CONFIG)


def digest_plain(spark: SparkSession, d: str) -> DataFrame:
    return _mails(spark, d).select("part", "plain")


def digest_html(spark: SparkSession, d: str) -> DataFrame:
    return _mails(spark, d).select("part", "html")


def digest_subject(spark: SparkSession, d: str) -> DataFrame:
    return _mails(spark, d).select("part", "subject")


def pipeline_digest(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.run(_pages(spark, d), CONFIG, DATE).mails


def pipeline_counters(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.counters(pipeline.run(_pages(spark, d), CONFIG, DATE))


_NAMES = (
    "url_parts url_strip_tracking url_finalize url_deamp url_repair url_canonical_safe url_quote root_and_scheme_reject article_url_flag whitelist_semi_join candidates_json interests_split recipients_split discovery_probe discovery_first "
    "html_sniff_type html_type_counts content_metrics content_gate decision_counts url_dedupe_first url_domain_cap validate_accepted audit_latest audit_reasons clean_text clip_ellipsis html_escape strip_title_dup compose_text source_choice scrape_outcomes scrape_reasons "
    "normalize_html extract_article extract_fallback_chain amp_link decode_charset lang_script_flags lang_classify lang_counts lang_vs_label lang_classify_cjk lang_with_meta lang_compact_zh lang_aligned_zh_only zh_like_translator lang_sample detect_normalize detect_normalize_cases "
    "sentence_split sentence_merge_short tf_sentence_rank tf_sentence_rank_cjk summary_extractive summary_cjk translate_fallback translate_meta_zh_only digest_parts digest_plain digest_html digest_subject pipeline_digest pipeline_counters"
).split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in _NAMES}
ORACLES: dict[str, str] = oracles.ORACLES
