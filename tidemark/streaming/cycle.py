"""The pipeline as a stream: each micro-batch of pages is one cycle, as a scheduled run would be.

Ranking windows don't run on streams, so the stages of a cycle run in foreachBatch; stateless ones (URLs, metrics, languages) run on
the stream itself. A URL can come again in a later cycle unless `distinct_for` names how long URLs are remembered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import Config
from tidemark.functions import urls
from tidemark.functions.lang import classify
from tidemark.plans.pipeline import Digest, run
from tidemark.schemas import PAGE
from tidemark.sources.sinks import append_json


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Pages from Parquet files that arrive in a folder."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tagged_urls(pages: DataFrame, config: Config) -> DataFrame:
    """The stateless part: final URL and language of each page as it comes."""
    return pages.withColumn("normalized_url", urls.finalized(F.col("url"), config.strip_amp)).withColumn("lang", classify(F.col("html")))


def once(pages: DataFrame, time_col: str, distinct_for: str) -> DataFrame:
    """The first page of each URL within the time that URLs are remembered."""
    return pages.withWatermark(time_col, distinct_for).dropDuplicatesWithinWatermark(["url"])


def start(pages: DataFrame, config: Config, checkpoint: str, date: Callable[[], str], deliver: Callable[[Digest, int], None], audit_path: str | None = None, available_now: bool = True, every: str = "1 day") -> StreamingQuery:
    """Starts the cycles. `deliver` gets each cycle's result; stop() ends the query after the running cycle."""
    def cycle(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        digest = run(kept, config, date())
        try:
            if audit_path:
                append_json(digest.audit, audit_path)
            deliver(digest, number)
        finally:
            digest.release()
            kept.unpersist()

    writer = pages.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
