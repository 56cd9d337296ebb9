"""The stages as one lazy plan; each stage is DataFrame -> DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.text import chosen_source
from tidemark.operators import deliver, scrape, summarize, tagging, translate, validate
from tidemark.sources.fetch import Fetcher
from tidemark.sources.models import Model


MOST_BROADCAST = 100_000


@dataclass(frozen=True)
class Digest:
    audit: DataFrame
    scrapes: DataFrame
    tagged: DataFrame
    translations: DataFrame
    mails: DataFrame

    def release(self) -> None:
        """Gives back what was kept between the stages."""
        for kept in (self.audit, self.scrapes, self.translations):
            kept.unpersist()


def run(pages: DataFrame, config: Config, date: str, fetcher: Fetcher | None = None, summarizer: Model | None = None, translator: Model | None = None) -> Digest:
    """Pages (ord, url, final_url, status_code, content_type, html, error) to mails. A page is read once and keeps its text
    on its row; the few accepted ones are joined by `ord`. Blank results stay in their places. What several stages read (the audit
    without pages, the accepted texts, the translations) is kept, on disk where memory is short; release() gives it back."""
    audit = validate.audited(pages, config).persist()
    chosen = validate.accepted(audit, config).select("ord")
    # at most max_results keys go to the pages, which then needn't move; without that limit the optimizer decides by size
    kept = pages.join(F.broadcast(chosen) if 0 < config.max_results <= MOST_BROADCAST else chosen, "ord", "left_semi")
    scrapes = scrape.scraped(kept, config, fetcher).persist()
    tagged = tagging.with_meta(tagging.prepared(scrapes, config), config.chinese_only)
    source = tagged.select("ord", chosen_source(F.col("body"), F.col("text")).alias("source"))
    summaries = summarize.summarized(source, "ord", "source", config, summarizer)
    translations = translate.translated(summaries, "ord", "summary", config, translator, config.chinese_only).persist()
    return Digest(audit, scrapes, tagged, translations, deliver.rendered(translations, "ja", date, config))


def counters(digest: Digest) -> DataFrame:
    """One row of counts for a log."""
    scrapes = digest.scrapes.agg(F.count_if("ok").alias("scraped"), F.count("*").alias("pages"))
    tagged = digest.tagged.agg(F.count_if(F.col("lang") == "zh").alias("chinese"), F.count_if(F.length("text") > 0).alias("with_text"))
    texts = digest.translations.agg(F.count_if(F.length("ja") > 0).alias("translated"))
    return scrapes.crossJoin(tagged).crossJoin(texts)  # single rows
