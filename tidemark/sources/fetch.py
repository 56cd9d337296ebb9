"""Fetching pages: an adapter that runs in the executors, one session for each partition. Nothing here touches a network by
itself; a reader of stored pages is the offline form of the same source."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.operators.ordering import first_of

FIELDS = "ord bigint, url string, final_url string, status_code int, content_type string, html string, error string, elapsed_ms double"
RETRIED = frozenset({429, 500, 502, 503, 504})


class Fetcher(Protocol):
    """Made once per partition by open(); must be picklable."""

    def open(self) -> object: ...

    def get(self, session: object, url: str) -> tuple[int, str, str | None, bytes]:
        """Status, final URL, content type, content; any exception is recorded by its class."""
        ...


@dataclass(frozen=True)
class HttpFetcher:
    """HTTP by `requests`, with timeouts, retries and a bound on redirects."""

    connect_timeout: float = 5
    read_timeout: float = 15
    retries: int = 2
    backoff: float = 0.5
    redirects: int = 10
    agent: str = "tidemark/1.0"
    languages: str = "ja,en;q=0.8,*;q=0.5"
    pool: int = 8

    def open(self) -> object:
        import requests

        session = requests.Session()
        session.max_redirects = self.redirects
        session.headers.update({"User-Agent": self.agent, "Accept-Language": self.languages})
        adapter = requests.adapters.HTTPAdapter(pool_maxsize=self.pool, max_retries=self.retries)  # connections that fail are tried again
        session.mount("http://", adapter)
        session.mount("https://", adapter)
        return session

    def head(self, session, url: str) -> tuple[int, str, str | None]:
        answer = session.head(url, timeout=(self.connect_timeout, self.read_timeout), allow_redirects=True)
        return answer.status_code, answer.url, answer.headers.get("Content-Type")

    def get(self, session, url: str) -> tuple[int, str, str | None, bytes]:
        for attempt in range(self.retries + 1):
            answer = session.get(url, timeout=(self.connect_timeout, self.read_timeout))
            if answer.status_code not in RETRIED or attempt == self.retries:
                break
            time.sleep(self.backoff * 2**attempt)
        return answer.status_code, answer.url, answer.headers.get("Content-Type"), answer.content


@dataclass(frozen=True)
class StoredFetcher:
    """Answers from a small fixed mapping of URL to (status, content type, content); for tests and replays."""

    pages: tuple[tuple[str, int, str, bytes], ...]

    def open(self) -> object:
        return {u: (s, u, t, c) for u, s, t, c in self.pages}

    def get(self, session, url: str) -> tuple[int, str, str | None, bytes]:
        return session[url]


def fetched(df: DataFrame, fetcher: Fetcher, partitions: int | None = None) -> DataFrame:
    """Pages of (ord, url), lazily in the executors. `partitions` bounds how many URLs are fetched at a time."""
    from tidemark.functions.html import decode

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = fetcher.open()
        for frame in frames:
            rows = []
            for n, url in zip(frame["ord"], frame["url"]):
                began = time.perf_counter()
                row = [n, url, None, None, None, None, None]
                try:
                    status, final, kind, content = fetcher.get(session, url)
                    row[2:6] = final, status, (kind or "").lower(), decode(content, kind) if not kind or "html" in kind.lower() else None
                except Exception as e:  # noqa: BLE001 - a page that can't be had is a row with its error
                    row[6] = type(e).__name__
                rows.append([*row, round((time.perf_counter() - began) * 1000, 2)])
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])
            yield out.astype({"status_code": "Int32"})

    rows = df.select("ord", "url")
    return (rows.repartition(partitions) if partitions else rows).mapInPandas(run, FIELDS)


def probed(df: DataFrame, fetcher: Fetcher) -> DataFrame:
    """(ord, url, final_url, status_code, content_type) of (ord, url): by a HEAD request where the fetcher has one and it is answered, else by a whole one."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, head = fetcher.open(), getattr(fetcher, "head", None)
        for frame in frames:
            rows = []
            for n, url in zip(frame["ord"], frame["url"]):
                row = (None, None, None)
                for ask in (head, fetcher.get):
                    try:
                        status, final, kind, *_ = ask(session, url) if ask else (599, None, None)
                    except Exception:  # noqa: BLE001 - a URL that doesn't answer isn't reachable
                        continue
                    row = (final, status, (kind or "").lower())
                    if status < 400 and "html" in row[2]:
                        break
                rows.append((n, url, *row))
            yield pd.DataFrame(rows, columns=["ord", "url", "final_url", "status_code", "content_type"]).astype({"status_code": "Int32"})

    return df.select("ord", "url").mapInPandas(run, "ord bigint, url string, final_url string, status_code int, content_type string")


def reachable(df: DataFrame, fetcher: Fetcher) -> DataFrame:
    """(ord, url) of the URLs that answer with HTML and a status below 400, as they were landed on; the first of each."""
    asked = probed(first_of(df.filter(F.length("url") > 0), "url").withColumn("url", urls.quoted(F.col("url"))), fetcher)
    good = asked.filter((F.col("status_code") < 400) & F.contains(F.coalesce("content_type", F.lit("")), F.lit("html")))
    return first_of(good.select("ord", F.coalesce("final_url", "url").alias("url")), "url")


def url_list(spark: SparkSession, values: list[str]) -> DataFrame:
    """(ord, url) of a list of the driver, such as command-line arguments."""
    return spark.createDataFrame(list(enumerate(values)), "ord bigint, url string")
