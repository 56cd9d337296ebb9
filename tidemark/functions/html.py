"""HTML: decoding, normalizing and extraction (Python, in Arrow batches), and the metrics of a page's head (Columns)."""

from __future__ import annotations

import html as entities
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let

# fixed values: tags that are left out, and what marks the main part
DROPPED = frozenset({"script", "style", "noscript", "nav", "footer", "header", "form", "aside"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
CANDIDATE_CLASSES = frozenset({"content", "article", "post"})
_BLANK, _TRAIL, _GAPS, _HIDDEN = re.compile(r"[ \t　]+"), re.compile(r" +\n"), re.compile(r"\n{3,}"), re.compile("[​-‏﻿]")


def clean(text: str) -> str:
    return _GAPS.sub("\n\n", _TRAIL.sub("\n", _BLANK.sub(" ", text.replace("\r", "")))).strip()


def normalize(page: str) -> str:
    """Entities resolved, compatibility characters composed, invisible ones dropped, blanks reduced."""
    page = _HIDDEN.sub("", unicodedata.normalize("NFKC", entities.unescape(page))).replace("\r", "")
    return _GAPS.sub("\n\n", _TRAIL.sub("\n", _BLANK.sub(" ", page)))


def _guess(raw: bytes) -> str | None:
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return None
    best = from_bytes(raw).best()
    return str(best) if best is not None and best.encoding else None


def decode(raw: bytes | None, content_type: str | None) -> str | None:
    """The page's text: by the charset of the content type, of a meta tag near the start, by a guess, or as UTF-8; normalized."""
    if raw is None:
        return None
    named = [m[1] for m in (re.search(r"charset=[\"']?([\w\-]+)", content_type or "", re.I), re.search(r"<meta[^>]+charset=[\"']?([\w\-]+)", raw[:4096].decode("ascii", "ignore"), re.I)) if m]
    for name in named:
        try:
            return normalize(raw.decode(name.lower(), "replace"))
        except LookupError:
            continue
    guess = _guess(raw)
    return normalize(guess if guess is not None else raw.decode("utf-8", "replace"))


class _Reader(HTMLParser):
    """Collects the title candidates, and the text of the body and of every candidate for the main part."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.titles: dict[str, str] = {}
        self.in_title = False
        self.stack: list[tuple[str, int | None]] = []
        self.dropped = 0
        self.parts: list[list[str]] = []
        self.open: list[int] = []
        self.all: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("content"):
            for key in ("property", "name"):
                if a.get(key) in ("og:title", "twitter:title"):
                    self.titles.setdefault(a[key], a["content"].strip())
        if tag in VOID:
            return
        if tag == "title" and "title" not in self.titles:
            self.in_title = True
            self.titles["title"] = ""
        self.dropped += tag in DROPPED
        number = None
        wanted = tag in ("article", "main") or a.get("role") == "main" or a.get("id") == "content" or CANDIDATE_CLASSES & set(a.get("class", "").split())
        if wanted and not self.dropped:
            number = len(self.parts)
            self.parts.append([])
            self.open.append(number)
        self.stack.append((tag, number))

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, number = self.stack.pop()
            self.dropped -= t in DROPPED
            if number is not None:
                self.open.remove(number)
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.titles["title"] += data
            return
        if not self.dropped:
            self.all.append(data)
            for number in self.open:
                self.parts[number].append(data)


def extract(page: str) -> tuple[str, str] | None:
    """(title, main text): the longest candidate, the first of equals; the whole text where there is no candidate."""
    reader = _Reader()
    reader.feed(page)
    reader.close()
    title = next((t for k in ("title", "og:title", "twitter:title") if (t := reader.titles.get(k, "").strip())), "")
    texts = [t for t in (clean("\n".join(p)) for p in reader.parts) if t] or [t for t in [clean("\n".join(reader.all))] if t]
    return (title, max(texts, key=len)) if texts else None


EXTRACTORS: list[tuple[str, object]] = [("html", extract)]


def register_extractor(name: str, function, first: bool = True) -> None:
    """Adds an extractor (page -> (title, text) or None) to the chain; one that raises counts as none."""
    EXTRACTORS.insert(0 if first else len(EXTRACTORS), (name, function))


def first_extracted(page: str | None, chain: list) -> tuple[str | None, str | None, str | None]:
    for name, function in chain if page is not None else []:
        try:
            found = function(page)
        except Exception:  # noqa: BLE001 - a page that one extractor can't read goes to the next
            continue
        if found:
            return found[0], found[1], name
    return None, None, None


def extracted(page: Column, chain: list | None = None, raw: bool = False) -> Column:
    """struct(title, body, extractor) of the first extractor that finds a text; nulls where none does. raw: pages are normalized in the same pass."""
    fixed = list(EXTRACTORS if chain is None else chain)

    @F.pandas_udf("title string, body string, extractor string")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([first_extracted(normalize(p) if raw and p is not None else p, fixed) for p in pages], columns=["title", "body", "extractor"])

    return run(page)


def decoded(raw: Column, content_type: Column) -> Column:
    @F.pandas_udf("string")
    def run(raws: pd.Series, types: pd.Series) -> pd.Series:
        return pd.Series([decode(r, t) for r, t in zip(raws, types)], dtype=object)

    return run(raw, content_type)


def normalized(page: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else normalize(p) for p in pages], dtype=object)

    return run(page)


def head(page: Column, size: int) -> Column:
    """The first bytes of a page, as sent: no more characters than bytes are encoded."""
    return F.substring(F.encode(F.substring(page, 1, size), "UTF-8"), 1, size)


def shown_head(page: Column, size: int) -> Column:
    """The first bytes of a page as Latin-1 characters, so that a cut in a character does no harm."""
    return F.decode(head(page, size), "ISO-8859-1")


def is_html_type(content_type: Column, types: tuple[str, ...]) -> Column:
    plain = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    found = F.lit(False)
    for t in types:
        found = found | plain.startswith(t)
    return found


def mentions_html_type(content_type: Column) -> Column:
    """The looser test of the scraper."""
    plain = F.lower(F.coalesce(content_type, F.lit("")))
    return F.contains(plain, F.lit("text/html")) | F.contains(plain, F.lit("application/xhtml"))


def looks_like_html(page: Column, size: int) -> Column:
    return html_signs(shown_head(page, size))


def html_signs(shown: Column) -> Column:
    return shown.rlike("(?i)<!doctype html|<html")


def metrics(page: Column, head_bytes: int, least_text: int, least_ratio: float) -> Column:
    return metrics_of(shown_head(page, head_bytes), least_text, least_ratio)


def metrics_of(shown: Column, least_text: int, least_ratio: float) -> Column:
    """Length in bytes and share of the text in a page's head (see shown_head), signals of an article, and a score for audits."""
    def measured(raw: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.regexp_replace(raw, "<[^>]+>", " "), "[ \\t\\n\\r\\f\\x0B]+", " "))
        return F.struct(
            F.length(bare).cast("bigint").alias("size"), F.greatest(F.length(raw), F.lit(1)).alias("whole"), raw.rlike("(?i)<title\\b").alias("title"), raw.rlike("(?i)<article\\b").alias("article"), raw.rlike("(?i)<time\\b").alias("time"),
            raw.rlike('(?i)"@type"\\s*:\\s*"(NewsArticle|Article)"').alias("jsonld"),
        )

    def described(m: Column) -> Column:
        share = m["size"] / m["whole"]
        points = lambda test, n: F.when(test, n).otherwise(0)
        score = points(m["size"] >= least_text, 2) + points(share >= least_ratio, 1) + points(m["jsonld"], 3) + points(m["article"], 2) + points(m["time"], 1) + points(m["title"], 1)
        return F.struct(m["size"].alias("text_len"), F.round(share, 4).alias("text_ratio"), m["title"].alias("has_title"), m["article"].alias("has_article"), m["time"].alias("has_time"), m["jsonld"].alias("has_jsonld"), score.cast("int").alias("score_hint"))

    return let(let(shown, measured), described)
