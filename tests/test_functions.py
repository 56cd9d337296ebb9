"""URL, text, language and HTML functions, against the standard library and hand-made cases."""

from urllib.parse import parse_qsl, urlencode, urlsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.config import TRACKING_KEYS, Config, masked
from tidemark.functions import html, lang, text, urls
from tidemark.plans import fixtures as fx


def values(spark, rows, column, schema="k int, x string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], schema)
    return [r["y"] for r in df.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


def test_repair_and_finalize(spark):
    got = dict(zip([k for k, _ in fx.URLS], values(spark, [u for _, u in fx.URLS], urls.finalized)))
    assert got[1] == "https://example.com/a?b=1"
    assert got[2] == "http://Example.com:80/x y?flag=&q=a+b~%2A"
    assert got[3] == "host://8080/x"
    assert got[7] == "https://example.com/news/" and got[9] == "https://example.com/a?x=1&"
    assert got[11] == "mailto://a@example.com" and got[12] == "https://" and got[13] == "https:///relative/path"
    assert got[14] == "https://user:pw@example.com:8443/p?a=&b=%25zz"
    assert got[16] == "https://cdn.example.com/y?k=%C3%A9+%C3%BC" and got[17] == "https://example.com/a?x=1+2" and got[18] is None


def test_canonical_adoption(spark):
    rows = spark.createDataFrame(fx.CANONICALS, "ord int, base string, canonical string")
    got = {r[0]: r[1] for r in rows.select("ord", urls.safe_canonical(F.col("base"), F.col("canonical"))).collect()}
    assert got == {1: "https://example.com/a", 2: "https://m.example.com/a", 3: None, 4: None, 5: None, 6: None, 7: "https://example.com/b/", 8: None}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from([*TRACKING_KEYS[:3], "a", "utm_x", "Q z", "é"]), st.text("ab &=+%~*é/", max_size=6)), max_size=4), min_size=1, max_size=30))
def test_tracking_equals_the_standard_library(spark, queries):
    given_urls = ["https://example.com/p?" + urlencode(q) for q in queries]
    def model(u):
        kept = [(k, v) for k, v in parse_qsl(urlsplit(u).query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in TRACKING_KEYS]
        return "https://example.com/p" + ("?" + urlencode(kept) if kept else "")
    assert values(spark, given_urls, urls.without_tracking) == [model(u) for u in given_urls]


def test_hosts_amp_and_quoting(spark):
    assert values(spark, ["https://u:p@Ex.com:80/a", "//x.y", "nothing", "http://[::1]:8/x", None], urls.host) == ["ex.com", "x.y", "", "[::1]", None]
    assert values(spark, ["a é'\"<%41>"], urls.quoted) == ["a%20%C3%A9'%22%3C%41%3E"]
    assert values(spark, ['<link rel=amphtml href=https://e.com/a>', '<LINK href="http://e.com/b" rel="x amphtml">', '<link rel="amphtml" href="/c">', ""], urls.amp_link) == ["https://e.com/a", "http://e.com/b", None, None]
    assert values(spark, ["https://e.com/2025/3/4/x", "/newsroom", "/a"], urls.looks_like_article) == [True, True, False]


def test_text_functions_equal_python(spark):
    samples = [" a 　", "\x1c\x85x ", "a \n\n\n\n b\r\n", "", None, "x" * 30 + "  y", "tab\t\t  z　w"]
    assert values(spark, samples, text.strip) == [None if s is None else s.strip() for s in samples]
    assert values(spark, samples, text.clean) == [None if s is None else html.clean(s) for s in samples]
    assert values(spark, samples, lambda c: text.clip(c, 31)) == [None if s is None else s if len(s) <= 31 else s[:31].rstrip() + "…" for s in samples]
    import html as stdlib
    risky = ["<a href=\"x\">&amp;'</a>", "plain", None]
    assert values(spark, risky, text.escape_html) == [None if s is None else stdlib.escape(s) for s in risky]


def test_title_and_composition(spark):
    df = spark.createDataFrame([("T", "T\nbody"), ("T", "xx T and more\nbody"), ("", "T\nb"), ("Title", "other\nTitle"), ("T", "T")], "t string, b string")
    assert [r[0] for r in df.select(text.without_title(F.col("t"), F.col("b"))).collect()] == ["body", "body", "T\nb", "other\nTitle", ""]
    assert df.select(text.composed(F.lit("T"), F.lit("b " * 20), 10).alias("x")).first()["x"] == "T\n\nb b b b"[:10].rstrip()


def test_languages(spark):
    rows = [t for _, t in fx.SAMPLES]
    got = dict(zip([k for k, _ in fx.SAMPLES], values(spark, rows, lang.classify)))
    assert got == {1: "zh", 2: "ja", 3: "en", 4: "other", 5: "other", 6: "other", 7: "other", 8: "other", 9: "zh", 10: "other", 11: "zh", 12: "zh", 13: "en", 14: "ja", 15: "other", 16: "zh"}
    like = dict(zip([k for k, _ in fx.SAMPLES], values(spark, rows, lang.chinese_like)))
    assert like[11] and not like[12] and not like[2] and not like[6] and not like[16]


PAGE = "<html><head><title> A &amp; B </title><script>no()</script></head><body><nav>menu</nav><div class='post big'>one<br>two</div><article>short</article><footer>f</footer></body></html>"


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (PAGE, ("A & B", "one\ntwo")), ("<p>a<p>b", ("", "a\nb")), ("<meta property='og:title' content='O'><main>m</main><main>mm</main>", ("O", "mm")), ("<body><nav>x</nav></body>", None), ("", None),
        ("<article>aa</article><article>bb</article>", ("", "aa")), ("<div id=content>c<aside>d</aside></div>", ("", "c")), ("<article>un<b>closed", ("", "un\nclosed")),
    ],
)
def test_extraction(page, expected):
    assert html.extract(page) == expected


def test_chain_decoding_and_metrics(spark):
    chain = [("bad", lambda p: 1 / 0), ("none", lambda p: None), ("html", html.extract)]
    assert html.first_extracted(PAGE, chain)[2] == "html" and html.first_extracted(None, chain) == (None, None, None)
    assert html.decode("中文".encode("gbk"), "text/html; charset=GBK") == "中文" and html.decode(b"\xff&lt;", "x; charset=nope; utf").endswith("<")
    assert html.decode('<meta charset="shift_jis">日本'.encode("shift_jis"), None).endswith("日本") and html.decode(None, None) is None
    assert html.normalize("ａ​&nbsp;b\r\n\n\n\nc") == "a b\n\nc"
    page = "<title>t</title><article>" + "é" * 200 + "</article>"
    df = spark.createDataFrame([(page,), ("",), (None,)], "h string")
    rows = [r[0] for r in df.select(html.metrics(F.col("h"), 131072, 400, 0.05)).collect()]
    assert (rows[0]["text_len"], rows[0]["has_article"], rows[0]["has_time"], rows[0]["score_hint"]) == (402, True, False, 6)
    assert rows[1]["text_len"] == 0 and rows[1]["text_ratio"] == 0.0
    assert df.select(html.metrics(F.col("h"), 30, 400, 0.05).alias("m")).first()["m"]["text_len"] == 7


def test_config():
    c = Config.from_env(env={"TIDEMARK_MAX_RESULTS": "5", "TIDEMARK_DRY_RUN": "Yes", "TIDEMARK_ACCEPTED_DOMAINS": "a.b, c", "TIDEMARK_MIN_TEXT_RATIO": "x"})
    assert (c.max_results, c.dry_run, c.accepted_domains, c.min_text_ratio, c.discovery_limit) == (5, True, ("a.b", "c"), 0.05, 30)
    assert masked("abcdefghijklmnop") == "abcdef...mnop" and masked("short") == "*****"
