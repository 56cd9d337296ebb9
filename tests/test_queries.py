"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tidemark.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def plain(df: pd.DataFrame) -> list:
    show = lambda v: "null" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    ours, theirs = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and plain(ours) == plain(theirs)


def test_sniffing_of_pages_whose_title_has_line_ends(spark, tmp_path):
    rows = [(k, f"http://a.example/{k}", None, t, "body", "text/html", 200, True) for k, t in enumerate(["plain", "a\nb", "a\rb", "a\u0085b", "a\u2028b", "a\u2029b", None] * 3)]
    schema = "scrape_id bigint, input_url string, resolved_url string, title string, body string, content_type string, status_code int, ok boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/scrape_meta.parquet")
    con = duckdb.connect()
    con.execute(f"create view scrape_meta as select * from '{tmp_path}/scrape_meta.parquet/*.parquet'")
    assert plain(queries.QUERIES["html_sniff_type"](spark, str(tmp_path)).toPandas()) == plain(con.execute(queries.ORACLES["html_sniff_type"]).df())


def test_entry_and_names(spark, con):
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() > 0
