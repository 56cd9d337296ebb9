"""Command line: one cycle, or cycles at an interval, over stored pages or a list of URLs."""

from __future__ import annotations

import argparse
import logging
import signal
import threading
import time
from dataclasses import replace
from functools import partial
from logging.handlers import RotatingFileHandler

from pyspark.sql import SparkSession
from pyspark.sql.functions import explode, lit

from tidemark.config import Config
from tidemark.operators.deliver import today
from tidemark.operators.discover import proposed, recipients
from tidemark.plans import pipeline
from tidemark.session import local
from tidemark.sources.fetch import Fetcher, HttpFetcher, fetched, url_list
from tidemark.sources.models import Model, from_config, summary_prompt, translation_prompt
from tidemark.sources.sinks import append_json, delivered, smtp_from

PAGE_COLUMNS = ("ord", "url", "final_url", "status_code", "content_type", "html", "error")


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("--pages", help="Parquet of pages; else the URLs are fetched")
    p.add_argument("urls", nargs="*")
    p.add_argument("--interests", help="topics for which a model proposes URLs, separated by commas")
    p.add_argument("--max-articles", type=int, help="bounds the URLs that discovery asks for")
    p.add_argument("--interval", type=float, default=86400, help="seconds between cycles")
    p.add_argument("--once", action="store_true")
    p.add_argument("--audit", default="audit.jsonl")
    p.add_argument("--log-level", default="INFO")
    p.add_argument("--log-file", help="log file, of which a few generations are kept")
    return p.parse_args(given)


def main(given: list[str] | None = None, model: Model | None = None, fetcher: Fetcher | None = None) -> int:
    args, config, stop = arguments(given), Config.from_env(), threading.Event()
    config = replace(config, max_articles=args.max_articles) if args.max_articles else config
    fetcher, model = fetcher or HttpFetcher(), model or from_config(config)
    logging.basicConfig(level=args.log_level.upper(), format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    if args.log_file:
        logging.getLogger().addHandler(RotatingFileHandler(args.log_file, maxBytes=5_000_000, backupCount=5, encoding="utf-8"))
    if threading.current_thread() is threading.main_thread():
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: stop.set())
    spark = local()
    while True:
        began = time.monotonic()
        try:
            cycle(spark, args, config, model, fetcher)
        except Exception:
            logging.exception("the cycle failed")
            if args.once:
                return 1
        if args.once or stop.wait(max(0.0, args.interval - (time.monotonic() - began))):
            return 0


def cycle(spark: SparkSession, args: argparse.Namespace, config: Config, model: Model | None, fetcher: Fetcher) -> dict[str, list]:
    """One run: pages, digest, audit, mails."""
    if args.interests:
        found = proposed(spark.createDataFrame([(args.interests,)], "t string"), "t", config, model, fetcher)
    else:
        found = url_list(spark, args.urls)
    pages = (spark.read.parquet(args.pages) if args.pages else fetched(found, fetcher).select(*PAGE_COLUMNS)).persist()
    digest = None
    try:
        summarizer, translator = from_config(config, partial(summary_prompt, bullets=config.bullets)), from_config(config, partial(translation_prompt, polite=config.polite))
        digest = pipeline.run(pages, config, today(config), fetcher if not args.pages else None, summarizer, translator)
        append_json(digest.audit, args.audit)
        to = [r[0] for r in spark.range(1).select(explode(recipients(lit(config.recipients)))).collect()]
        done = delivered(digest.mails, to, config, time.strftime("%Y%m%d-%H%M%S"), smtp_from(config))
        logging.info("sent %d, saved %d", len(done["sent"]), len(done["saved"]))
        return done
    finally:
        if digest:
            digest.release()
        pages.unpersist()


if __name__ == "__main__":
    raise SystemExit(main())
