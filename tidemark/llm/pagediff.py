"""Problem 3: the main body of pages, by differencing pages whose URLs are near.

Pages of a host are put in the order of their URL paths, and each is paired with its REACH neighbours on both sides. For each
pair the lines are aligned by their longest common subsequence; what two different articles share is furniture and is
deleted. Pairs whose longer lines share sentences are versions of one article and don't count. Lines are compared in a normal form (lower
case, digits alike, list marks and white space reduced).

Teasers differ from page to page. They stand below a shared heading that on most of the neighbours that have it is followed by an
unshared line without an end of sentence, or carry arrows; the run of such lines below the heading is deleted too.

Which pages are neighbours doesn't depend on how the rows are spread: the order is a range partitioning, each page gets its rank
within its host (a host that spans partitions gets an offset for each, so that no task sees a whole host), and segments of SEGMENT
ranks are differenced with the REACH pages before and after them. A page with few neighbours that aren't versions of it, as in a large
group of copies, is also held against the lines that differencing found on its host. Pages whose remaining text is empty, or is residue
(see residue), hold no article and are left out. Where the resolved URL is missing, the URL asked for places a page; null bodies have no
rows, and pages without any URL have no neighbours and keep their body. A line that a page repeats is aligned by its first place; all its places go.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import residue
from tidemark.llm.checkpoints import cut
from tidemark.llm.recode import read
from tidemark.llm.sitelines import site_of

REACH, SEGMENT, SUPPORT = 32, 512, 1
SAME_ARTICLE, PARAGRAPH, LEADS, LEAST_LETTERS = 0.15, 130, 0.5, 6
PAGES = ("cp1252", "cp1251", "mac-roman", "cp850", "cp437")
_TWO_HIGH = re.compile("[\x80-\u25ff]{2}")
_MARKS = re.compile(r"^(?:[•*›»→▸·\-–—]|\d{1,4}[.)])+\s*|\s*[→»›]+$")
_BLANKS = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_SENTENCES = re.compile(r"[.!?。！？]+[\"”»」』’]*\s*|\n")
_ENDS = re.compile(r"[.!?。！？…:：;；][\"”»」』’)）\]]*\s*(?:[(（\[][^)）\]]*[)）\]])?$")
_ARROWS = re.compile(r"^[›»→▸]|[→›»▸]$")


def url_path(url: Column) -> Column:
    """What follows the host, with a query but without a fragment, in lower case."""
    return F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?[^/?#]*([^#]*)", 1)


def normal(line: str) -> str:
    line = _MARKS.sub("", _BLANKS.sub(" ", line).strip())
    return _DIGITS.sub("0", line.lower()).strip()


def mended(line: str) -> str:
    """The line as it is compared: UTF-8 that was read in a single-byte page reads right again. What else this changes, it changes alike on all pages."""
    if " " not in line and "Â" not in line:
        line = line.replace("\xa0", " ")
    for _ in range(2):
        if not _TWO_HIGH.search(line):
            break
        new = next((x for page in PAGES if (x := read(line, page, "utf-8"))), None)
        if new is None:
            break
        line = new
    return line


def increasing(places: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(places)
    for k, p in enumerate(places):
        n = bisect_left(tails, p)
        before[k] = ends[n - 1] if n else -1
        if n == len(tails):
            tails.append(p)
            ends.append(k)
        else:
            tails[n], ends[n] = p, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


class Page:
    __slots__ = ("key", "keys", "lines", "others", "place", "sentences", "shared", "site")

    def __init__(self, key, site: str, body: str):
        self.key, self.site, self.lines = key, site, body.split("\n")
        plain = [mended(x) for x in self.lines]
        self.keys = [normal(x) for x in plain]
        self.place: dict[str, int] = {}
        for k, x in enumerate(self.keys):
            if x:
                self.place.setdefault(x, k)
        self.sentences = {hash(s) for x in plain if len(x) >= PARAGRAPH or (len(x) >= PARAGRAPH * 2 // 5 and "⺀" < x[2] < "\ufffe") for s in _SENTENCES.split(x.lower()) if len(s) > 9}
        self.shared: Counter = Counter()
        self.others = 0  # neighbours that are another article


def align(a: Page, b: Page) -> None:
    """Notes on both pages the lines of their longest common subsequence, unless they are versions of one article."""
    common = a.place.keys() & b.place.keys()
    if not common:
        a.others, b.others = a.others + 1, b.others + 1
        return
    both = len(a.sentences & b.sentences)
    if both > 1 or both > SAME_ARTICLE * min(len(a.sentences), len(b.sentences)):
        return
    a.others, b.others = a.others + 1, b.others + 1
    order = sorted(common, key=a.place.__getitem__)
    for k in increasing([b.place[x] for x in order]):
        a.shared[order[k]] += 1
        b.shared[order[k]] += 1


def marked(page: Page, leads: dict[str, list[int]]) -> list[int]:
    """Numbers of the lines that aren't part of the article."""
    out, below = [], False
    for k, x in enumerate(page.keys):
        if not x:
            continue
        line = page.lines[k].strip()
        if page.shared[x] >= SUPPORT:
            out.append(k)
            n, m = leads.get(x, (0, 0))
            below = m > 0 and n >= LEADS * m
        elif _ARROWS.search(line) and not _ENDS.search(line):
            out.append(k)
        elif below and not _ENDS.search(line) and len(x) < 200:
            out.append(k)
        else:
            below = False
    return out


def _leads(pages: list[Page]) -> dict[str, list[int]]:
    """For each shared line: on how many pages an unshared line without an end of sentence follows it, and on how many it stands."""
    out: dict[str, list[int]] = {}
    for p in pages:
        filled = [k for k, x in enumerate(p.keys) if x]
        for k, nxt in zip(filled, [*filled[1:], None]):
            if p.shared[p.keys[k]] >= SUPPORT:
                entry = out.setdefault(p.keys[k], [0, 0])
                entry[1] += 1
                if nxt is not None and p.shared[p.keys[nxt]] < SUPPORT and len(p.keys[nxt]) >= LEAST_LETTERS and not _ENDS.search(p.lines[nxt].strip()):
                    entry[0] += 1
    return out


def difference(pages: list[Page], first: int, last: int) -> Iterator[tuple[Page, list[int]]]:
    """The pages first..last - 1 of a host's run, each with the numbers of its lines that aren't part of the article."""
    for p in pages:
        p.shared = Counter()
    for k in range(len(pages)):
        for j in range(k + 1, min(k + 1 + REACH, len(pages))):
            align(pages[k], pages[j])
    leads = _leads(pages)
    for p in pages[first:last]:
        yield p, marked(p, leads)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[Page], int, int]]:
    """The segments, each with the pages before and after it; first and last number of its own pages."""
    pages: list[Page] = []
    own: list[int] = []
    at = None
    for batch in batches:
        for key, site, body, segment, core in zip(*(batch.column(c).to_pylist() for c in range(5))):
            if at is not None and at != (site, segment):
                if own:  # else the site ends where this segment would begin
                    yield pages, own[0], own[-1] + 1
                pages, own = [], []
            at = (site, segment)
            if core:
                own.append(len(pages))
            pages.append(Page(key, site, body))
    if own:
        yield pages, own[0], own[-1] + 1


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page its lines that aren't part of the article and, where fewer than half of REACH neighbours were other articles, the hashes of all its
    lines; for each segment the hashes of the lines that differencing found."""
    kind: list[pa.DataType] = []

    def seen() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind[:] = [batch.schema.field(0).type]
            yield batch

    for pages, first, last in _runs(seen()):
        found = list(difference(pages, first, last))
        shared = {x for p, _ in found for x, n in p.shared.items() if n >= SUPPORT}
        ids, lines, bodies = [p.key for p, _ in found], [out for _, out in found], ["\n".join(p.lines) for p, _ in found]
        hashes = [[_hash(x) if x else None for x in p.keys] if p.others < REACH // 2 else None for p, _ in found]
        ids, lines, bodies, hashes = [*ids, None], [*lines, None], [*bodies, None], [*hashes, [_hash(x) for x in shared]]
        sites = [pages[0].site] * len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind[0]), pa.array(sites, pa.string()), pa.array(lines, pa.list_(pa.int32())), pa.array(bodies, pa.string()), pa.array(hashes, pa.list_(pa.int64()))], ["_id", "site", "lines", "body", "hashes"])


def _articles(model):
    """The bodies without the lines found and without blank ones, null where no article is left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: residue.Model = model.value
        for batch in batches:
            rest = []
            for body, gone in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                gone = set(gone)
                rest.append("\n".join(x for k, x in enumerate(body.split("\n")) if k not in gone and x.strip()))
            suspects = set(m.suspects(rest))
            keep = [bool(t) and not (k in suspects and m.is_residue(t)) for k, t in enumerate(rest)]
            lines = [x if ok else None for x, ok in zip(batch.column(1).to_pylist(), keep)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.list_(pa.int32())), pa.array([t if ok else None for t, ok in zip(rest, keep)], pa.string())], ["_id", "lines", "article"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's place among the rows of its site in this partition, which come one after the other."""
    site, n = None, 0
    for batch in batches:
        places = []
        for s in batch.column(1).to_pylist():
            n = n + 1 if s == site else 0
            site = s
            places.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "place"])


def segments(rows: DataFrame) -> DataFrame:
    """(_id, site, body, segment, core, rank) of (_id, site, path, body): each page in its segment, and as a neighbour in those beside it."""
    kind = rows.schema["_id"].dataType.simpleString()
    ordered = rows.repartitionByRange("site", "path", "_id").sortWithinPartitions("site", "path", "_id").select("_id", "site", "body", F.spark_partition_id().alias("part"))
    placed = cut(ordered.mapInArrow(_numbered, f"_id {kind}, site string, body string, part int, place bigint"))
    ends = placed.groupBy("site", "part").agg(F.max("place").alias("last"))
    before = F.sum(F.col("last") + 1).over(Window.partitionBy("site").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # only sites that go on from the partition before: at most one for each partition
    offsets = ends.select("site", "part", before.alias("offset")).filter("offset is not null")
    ranked = placed.join(F.broadcast(offsets), ["site", "part"], "left").withColumn("rank", F.col("place") + F.coalesce("offset", F.lit(0)))
    own, within = F.floor(F.col("rank") / SEGMENT), F.col("rank") % SEGMENT
    cells = F.array_compact(F.array(F.struct(own.alias("segment"), F.lit(True).alias("core")), F.when((within < REACH) & (own > 0), F.struct((own - 1).alias("segment"), F.lit(False).alias("core"))), F.when(within >= SEGMENT - REACH, F.struct((own + 1).alias("segment"), F.lit(False).alias("core")))))
    spread = ranked.select("_id", "site", "body", "rank", F.explode(cells).alias("c")).select("_id", "site", "body", "c.segment", "c.core", "rank")
    return spread.repartition("site", "segment").sortWithinPartitions("site", "segment", "rank")


def main_text(df: DataFrame, id_col: str = "scrape_id", url_col: str = "resolved_url", body_col: str = "body", status_col: str = "status_code", ok_col: str = "ok", asked_col: str | None = None) -> DataFrame:
    """(id, lines, article): the numbers of the lines that aren't part of the article, and the body without them and without blank
    lines; both null for pages without an article. asked_col: the URL of pages that lack one in url_col; with it, pages without
    a site by either have a row too, with no lines and the body as it is."""
    model = df.sparkSession.sparkContext.broadcast(residue.train(df, id_col, body_col, status_col, ok_col))
    kind = df.schema[id_col].dataType.simpleString()
    url = F.col(url_col)
    if asked_col:
        url = F.when(site_of(url).isNotNull(), url).otherwise(F.col(asked_col))
    every = df.select(F.col(id_col).alias("_id"), site_of(url).alias("site"), F.col(body_col).alias("body"), url_path(url).alias("path")).filter("body is not null")
    marked = cut(segments(every.filter("site is not null")).mapInArrow(_mark, f"_id {kind}, site string, lines array<int>, body string, hashes array<bigint>"))
    pages = marked.filter("lines is not null")
    known = marked.filter("lines is null").select("site", F.explode("hashes").alias("hash")).distinct()
    # what the pages that had few others around them share with the rest of their host
    alone = cut(pages.filter("hashes is not null").withColumn("_row", F.monotonically_increasing_id()))
    also = alone.select("_row", "site", F.posexplode("hashes").alias("k", "hash")).join(known, ["site", "hash"]).groupBy("_row").agg(F.sort_array(F.collect_list("k")).alias("more"))
    held = alone.join(also, "_row", "left").withColumn("lines", F.array_sort(F.array_union("lines", F.coalesce("more", F.array().cast("array<int>")))))
    done = pages.filter("hashes is null").select("_id", "lines", "body").union(held.select("_id", "lines", "body")).mapInArrow(_articles(model), f"_id {kind}, lines array<int>, article string")
    if asked_col:
        done = done.union(every.filter("site is null").select("_id", F.array().cast("array<int>"), "body"))
    return done.withColumnRenamed("_id", id_col)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/scrape_meta.parquet").select("scrape_id", "input_url", "resolved_url", "body", "status_code", "ok"), asked_col="input_url")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("scrape_id", F.explode("lines").alias("line_no"))


def p3_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("scrape_id", "article")
