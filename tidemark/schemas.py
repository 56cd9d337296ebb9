"""Schemas of the records that stages exchange, as DDL."""

from __future__ import annotations

METRICS = "text_len: bigint, text_ratio: double, has_title: boolean, has_article: boolean, has_time: boolean, has_jsonld: boolean, score_hint: int"
CANDIDATE = "title: string, url: string, source: string, date_iso: string"
URL = "ord bigint, url string"
PAGE = "ord bigint, url string, final_url string, status_code int, content_type string, html string, error string"
VALIDATION = f"ord bigint, input_url string, normalized_url string, final_url string, status_code int, content_type string, decision string, reason string, metrics struct<{METRICS}>"
SCRAPE = "ord bigint, input_url string, resolved_url string, status_code int, content_type string, extractor string, used_amp boolean, ok boolean, reason string, title string, body string, text string, chars int"
TRANSLATION = "ord bigint, src string, ja string, ok boolean, engine string, reason string"
MAIL = "part int, total_parts int, subject string, plain string, html string"
