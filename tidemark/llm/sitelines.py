"""Problem 4: lines repeated excessively within one site.

Each line of each site is tested by the log-likelihood ratio of its frequency within the site against its frequency outside of the
site, and the false discovery rate over all lines of all sites is held by the Benjamini-Hochberg rule. A line that no other site
holds is taken to stand in half a record among all. A line that is significant on some site is furniture of a kind that several sites may
use, which raises its frequency outside; on the other sites it is tested, by the same rule, against that half record. Lines that are
significant and meet the counts (min_records, min_share) are repeated; a line that stands everywhere alike is significant nowhere. They are removed by an anti-join on
site and line, and the bodies are put together again by position. Both joins spread each site over SALTS keys, so that a hot site
is no single task.

Null bodies and null URLs belong to no site and stay as they are. Records count by row: rows that are repeated count each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.checkpoints import cut

MIN_RECORDS, MIN_SHARE, FALSE_DISCOVERIES = 4, 0.03, 0.05
BINS_PER_UNIT, MOST_BIN, SALTS = 8, 8000, 16


def site_of(url: Column) -> Column:
    """Host of a URL with or without scheme: lower case, no user, port or leading www."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def normal_form(line: Column) -> Column:
    """Lower case, white space as single blanks, trimmed, every run of ASCII digits alike."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), "[ \\t\\u00a0\\u3000]+", " ")), "[0-9]+", "0")


def line_keys(body: Column) -> Column:
    """A hash for each line of the body, null for blank ones."""
    def key(line: Column) -> Column:
        return F.when(line.rlike("[^\\s\\u00a0\\u3000\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f]"), F.xxhash64(normal_form(line)))

    return F.transform(F.split(body, "\n"), key)


def _llr(k: Column, n: Column, rate: Column) -> Column:
    """G of k of n against a known rate, 0 unless in excess."""
    miss = n - k
    g = 2 * (k * F.ln(k / (n * rate)) + F.when(miss > 0, miss * F.ln(miss / (n * (1 - rate)))).otherwise(0.0))
    return F.when((k > n * rate) & (rate < 1), F.greatest(g, F.lit(0.0))).otherwise(0.0)


def _least_g(bins: list[tuple[int, int]], tests: int, q: float) -> float:
    """The least G that is significant at false discovery rate q, from counts of tests by bin of G."""
    above, least = 0, math.inf
    for b, count in sorted(bins, reverse=True):
        above += count
        g = b / BINS_PER_UNIT
        if 0.5 * math.erfc(math.sqrt(g / 2)) * tests <= q * above:
            least = g
    return least


def _lines(df: DataFrame, id_col: str, url_col: str, body_col: str, text: bool) -> DataFrame:
    """(_row, _id, site, line_no, line_key, first[, line]) of each line of each body that belongs to a site; key: null for blank lines; first: whether the body has no
    such line before."""
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), site_of(F.col(url_col)).alias("site"), F.col(body_col).alias("_body")).filter("site is not null and _body is not null")
    rows = rows.withColumn("_keys", line_keys(F.col("_body")))
    at = F.sequence(F.lit(0), F.size("_keys") - 1)
    fields = lambda k: [k.alias("line_no"), F.get("_keys", k).alias("line_key"), *([F.get("_texts", k).alias("line")] if text else [])]
    if text:
        rows = rows.withColumn("_texts", F.split("_body", "\n"))
    cells = rows.select("_row", "_id", "site", F.explode(F.transform(at, lambda k: F.struct(*fields(k), (F.array_position("_keys", F.get("_keys", k)) == k + 1).alias("first")))).alias("x")).select("_row", "_id", "site", "x.*")
    return cut(cells if text else cells.filter("line_key is not null"))


def _scores(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    counts = cut(lines.filter("first").groupBy("site", "line_key").agg(F.count("*").alias("records")))
    sizes = cut(sizes)
    tests, records = float(counts.count()), float(sizes.agg(F.sum("site_records").alias("n")).first()["n"] or 0)
    again = counts.filter("records > 1")  # a line that stands once has no excess to test; it counts as a test below
    everywhere = counts.groupBy("line_key").agg(F.sum("records").alias("anywhere"))
    k, n = F.col("records").cast("double"), F.col("site_records").cast("double")
    elsewhere = F.col("anywhere") - F.col("records")
    rate = F.coalesce(F.try_divide(elsewhere, F.lit(records) - n), F.lit(0.0)) + F.lit(0.5 / max(records, 1.0))
    return again.join(sizes, "site").join(everywhere, "line_key").select("site", "line_key", "records", "site_records", elsewhere.alias("elsewhere"), _llr(k, n, rate).alias("excess"), _llr(k, n, F.lit(0.5 / max(records, 1.0))).alias("incidental"), F.lit(tests).alias("tests"))


def _sizes(df: DataFrame, url_col: str, body_col: str) -> DataFrame:
    return df.filter(F.col(body_col).isNotNull()).groupBy(site_of(F.col(url_col)).alias("site")).agg(F.count("*").alias("site_records")).filter("site is not null")


def _threshold(scores: DataFrame, q: float) -> float:
    bins = scores.groupBy(F.least(F.floor(F.col("excess") * BINS_PER_UNIT), F.lit(MOST_BIN)).alias("b")).agg(F.count("*").alias("c"), F.max("tests").alias("t")).collect()  # at most MOST_BIN + 1 rows
    return _least_g([(r["b"], r["c"]) for r in bins], int(max((r["t"] for r in bins), default=0)), q)


def _repeated(lines: DataFrame, sizes: DataFrame, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE, q: float = FALSE_DISCOVERIES) -> DataFrame:
    scores = cut(_scores(lines, sizes))
    elsewhere = scores.filter(F.col("excess") >= F.lit(_threshold(scores, q))).select("line_key").distinct().withColumn("known", F.lit(True))
    scores = cut(scores.join(elsewhere, "line_key", "left").withColumn("excess", F.when(F.col("known"), F.greatest("excess", "incidental")).otherwise(F.col("excess"))).drop("known", "incidental"))
    least = _threshold(scores, q)
    share = F.col("records") >= F.ceil(F.col("site_records") * F.lit(str(min_share)).cast("decimal(10,6)"))
    return scores.filter((F.col("excess") >= F.lit(least)) & (F.col("records") >= min_records) & share).drop("tests")


def repeated_lines(df: DataFrame, url_col: str = "resolved_url", body_col: str = "body", min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE, q: float = FALSE_DISCOVERIES) -> DataFrame:
    """(site, line_key, records, site_records, elsewhere, excess) of the repeated lines of each site."""
    return _repeated(_lines(df, url_col, url_col, body_col, False), _sizes(df, url_col, body_col), min_records, min_share, q)


def _salted(lines: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    salts = F.explode(F.array([F.lit(k) for k in range(SALTS)])).alias("salt")
    return lines.withColumn("salt", F.pmod(F.hash("_row"), F.lit(SALTS))), repeated.select("site", "line_key", salts)


def find_repeated(df: DataFrame, id_col: str = "scrape_id", url_col: str = "resolved_url", body_col: str = "body", **limits: float) -> DataFrame:
    """(id, line_no): each occurrence of a repeated line."""
    lines = _lines(df, id_col, url_col, body_col, False)
    ours, theirs = _salted(lines, cut(_repeated(lines, _sizes(df, url_col, body_col), **limits)))
    return ours.join(theirs, ["site", "line_key", "salt"], "left_semi").select(F.col("_id").alias(id_col), "line_no")


def remove_repeated(df: DataFrame, id_col: str = "scrape_id", url_col: str = "resolved_url", body_col: str = "body", **limits: float) -> DataFrame:
    """(id, body, removed): each body without its site's repeated lines, the others in their order; null bodies stay null."""
    lines = _lines(df, id_col, url_col, body_col, True)
    ours, theirs = _salted(lines, cut(_repeated(lines.filter("line_key is not null"), _sizes(df, url_col, body_col), **limits)))
    kept = ours.join(theirs, ["site", "line_key", "salt"], "left_anti")
    of_row = kept.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("_left"), F.count("*").alias("_n"))
    every = lines.groupBy("_row").agg(F.first("_id").alias("_id"), F.count("*").alias("_all"))
    whole = every.join(of_row, "_row", "left").select(F.col("_id").alias(id_col), F.coalesce("_left", F.lit("")).alias(body_col), (F.col("_all") - F.coalesce("_n", F.lit(0))).cast("int").alias("removed"))
    rest = df.filter(site_of(F.col(url_col)).isNull() | F.col(body_col).isNull()).select(F.col(id_col), F.col(body_col), F.lit(0).alias("removed"))
    return whole.unionByName(rest)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/scrape_meta.parquet").select("scrape_id", "resolved_url", "body")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeated(_pages(spark, sf_dir))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(_pages(spark, sf_dir))


def p4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many repeated lines each site has, and how many of them are common elsewhere too."""
    found = repeated_lines(_pages(spark, sf_dir), "resolved_url", "body")
    return found.groupBy("site").agg(F.count("*").alias("lines"), F.sum("records").alias("occurrences"), F.count_if(F.col("elsewhere") > 0).alias("also_elsewhere"))


_NORMAL = r"regexp_replace(trim(regexp_replace(lower(line), '[ \t\x{a0}\x{3000}]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g')"
_SQL = rf"""
with pages as (
  select scrape_id, body, nullif(regexp_replace(regexp_extract(lower(trim(resolved_url, ' ')), '^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:@]*)', 1), '^www\.', ''), '') as site
  from scrape_meta where body is not null),
lines as (select scrape_id, site, unnest(string_split(body, chr(10))) as line, unnest(range(len(string_split(body, chr(10))))) as line_no from pages where site is not null),
keyed as (select scrape_id, site, line_no, line, {_NORMAL} as k from lines where regexp_matches(line, '[^\s\x{{a0}}\x{{3000}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}]')),
sizes as (select site, count(*) as n from pages where site is not null group by site),
repeated as (
  select site, k, count(distinct scrape_id) as c, any_value(n) as n from keyed join sizes using (site) group by site, k
  having count(distinct scrape_id) >= 4 and count(distinct scrape_id) * 100 >= 3 * any_value(n))
"""
ORACLES = {
    "p4_clean": _SQL + """, marked as (select l.scrape_id, l.line_no, l.line, r.k is not null as gone from lines l left join keyed y using (scrape_id, line_no) left join repeated r on r.site = l.site and r.k = y.k),
left_ as (select scrape_id, string_agg(line, chr(10) order by line_no) filter (not gone) as b, count(*) filter (gone) as n from marked group by scrape_id)
select m.scrape_id, case when l.scrape_id is null then m.body else coalesce(l.b, '') end as body, cast(coalesce(l.n, 0) as integer) as removed from scrape_meta m left join left_ l using (scrape_id)""",
    "p4_found": _SQL + "select scrape_id, cast(line_no as integer) as line_no from keyed join repeated using (site, k)",
    "p4_lines": _SQL + ", marked as (select r.site, r.c, (select count(*) from keyed x where x.k = r.k and x.site <> r.site) > 0 as other from repeated r) select site, count(*) as lines, cast(sum(c) as bigint) as occurrences, count(*) filter (where other) as also_elsewhere from marked group by site",
}
