"""Stages on small inputs: ordering, validation, scraping, summaries, translations, digests, streams."""

import email
import re

import pytest
from pyspark.errors import PySparkException

from tidemark import cli
from tidemark.config import Config
from tidemark.operators import deliver, discover, ordering, scrape, summarize, tagging, translate, validate
from tidemark.plans import fixtures as fx
from tidemark.plans import pipeline
from tidemark.schemas import PAGE
from tidemark.sources import fetch, sinks
from tidemark.sources.models import CallableModel
from tidemark.streaming import cycle

ARTICLE = "<html><head><title>T</title></head><body><article>" + "A sentence about the bridge that many read. " * 20 + "</article></body></html>"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGE)


def test_ordering(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (200_001, "c"), (5, None)], "ord bigint, k string")
    assert sorted(r["ord"] for r in ordering.first_of(df, "k").collect()) == [1, 2, 5, 200_001]
    assert sorted(r["ord"] for r in ordering.capped(df, df["k"], 1).collect()) == [1, 2, 5, 200_001]
    assert {r["ord"]: r["n"] for r in ordering.numbered(df).collect()} == {1: 0, 2: 1, 3: 2, 5: 3, 200_001: 4}
    assert {r["ord"]: (r["part"], r["place"]) for r in ordering.chunked(df, 2).collect()} == {1: (1, 1), 2: (1, 2), 3: (2, 1), 5: (2, 2), 200_001: (3, 1)}
    assert {r["part"] for r in ordering.chunked(df, 0).collect()} == {1}
    assert ordering.chunked(df.limit(0), 2).count() == 0


def test_discovery(spark):
    rows = spark.createDataFrame(fx.ANSWERS, "ord bigint, raw string")
    got = {r["url"] for r in discover.candidates(rows, "raw", Config(accepted_domains=())).collect()}
    assert got == {"https://example.com/news/1", "http://www.example.test/x", "https://sub.example.com/2025/03/02/y"}
    bad = spark.createDataFrame([("no json",)], "raw string")
    assert discover.candidates(bad, "raw", Config(), strict=False).count() == 0
    with pytest.raises(PySparkException):
        discover.candidates(bad, "raw", Config()).collect()


def test_validation_reasons_and_order(spark):
    canonical = '<link rel="canonical" href="https://e.com/real?utm_x=1">'
    rows = [
        (1, "ftp://e.com/a", None, 200, "text/html", ARTICLE, None), (2, "https://e.com/", None, 200, "text/html", ARTICLE, None), (3, "https://e.com/pdf", None, 200, "application/pdf", "%PDF", None), (4, "https://e.com/short", None, 200, "text/html", "<title>x</title>", None),
        (5, "https://e.com/plain", None, 200, "text/html", "word " * 100, None), (6, "https://e.com/thin", None, 200, "text/html", "<title>x</title>" + "<i>" * 9000 + "word " * 100, None), (7, "https://e.com/ok", None, 404, None, "<html>" + ARTICLE, None), (8, "https://e.com/ok?utm_a=1", None, 200, "text/html", ARTICLE, None),
        (9, "https://e.com/c", "https://e.com/c2", 200, "text/html", canonical + ARTICLE, None), (10, "https://e.com/d", None, None, None, None, "ReadTimeout"), (11, None, None, None, None, None, None), (12, "https://e.com/third", None, 200, "text/html", ARTICLE, None), (13, "https://f.com/x", None, 200, "text/html", ARTICLE, None),
    ]
    audit = {r["ord"]: r for r in validate.audited(pages(spark, rows), Config()).collect()}
    reasons = {k: r["reason"] for k, r in audit.items()}
    assert reasons == {1: "invalid_url_scheme", 2: "root_like_path", 3: "non_html_content", 4: "too_short_text", 5: "no_article_signals", 6: "too_low_text_ratio", 7: "accepted_content_ready", 8: "accepted_content_ready", 9: "accepted_content_ready", 10: "exception:ReadTimeout", 11: "invalid_url_scheme", 12: "accepted_content_ready", 13: "accepted_content_ready"}
    assert audit[9]["final_url"] == "https://e.com/real" and audit[3]["metrics"] is None and audit[7]["status_code"] == 404
    taken = validate.accepted(validate.audited(pages(spark, rows), Config()), Config(max_results=3))
    assert sorted(r["ord"] for r in taken.collect()) == [7, 9, 13]


def test_scraping_with_amp_retry(spark):
    stored = fetch.StoredFetcher((("https://e.com/amp", 200, "text/html", b"<article>from amp</article>"),))
    rows = [(1, "https://e.com/a", None, 200, "text/html", ARTICLE, None), (2, "https://e.com/b", None, 200, "text/html", '<link rel="amphtml" href="https://e.com/amp">', None), (3, "https://e.com/c", None, 200, "text/html", "<nav>x</nav>", None), (4, "https://e.com/d", None, 200, "image/png", None, None), (5, "https://e.com/e", None, None, None, None, "SSLError")]
    got = {r["ord"]: r for r in scrape.scraped(pages(spark, rows), Config(), stored).collect()}
    assert (got[1]["title"], got[1]["ok"], got[1]["chars"]) == ("T", True, len(got[1]["body"])) and got[1]["text"].startswith("T\n\nA sentence")
    assert got[2]["used_amp"] and got[2]["body"] == "from amp" and got[2]["input_url"] == "https://e.com/b" and got[2]["resolved_url"] == "https://e.com/amp"
    assert [got[k]["reason"] for k in (3, 4, 5)] == ["no_extractor_matched", "non_html_or_fetch_error", "exception:SSLError"]
    strict = {r["ord"]: r["reason"] for r in scrape.scraped(pages(spark, rows[:1]), Config(min_chars=10**6)).collect()}
    assert strict == {1: "too_short"}


def test_tagging_keeps_or_drops(spark):
    df = spark.createDataFrame([(1, "今天，好"), (2, "English"), (3, ""), (4, None)], "ord bigint, text string")
    assert {r["ord"]: r["lang"] for r in tagging.with_meta(df).collect()} == {1: "zh", 2: "en", 3: "unknown", 4: "unknown"}
    assert [r["ord"] for r in tagging.compact(df, True).collect()] == [1]
    assert {r["ord"]: (r["lang"], r["text"]) for r in tagging.aligned(df, True).collect()} == {1: ("zh", "今天，好"), 2: ("", ""), 3: ("", ""), 4: ("", "")}


def plain_summary(text, bullets=5):
    """A model of the extractive summary in plain Python."""
    text = text.strip()
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    title, rest = (lines[0], lines[1:]) if lines and len(lines[0]) <= 80 else (None, lines)
    body = "\n".join(rest)
    found = []
    for s in (x.strip() for x in re.findall(r"[^。！？!?\n]*[。！？!?\n]|[^。！？!?\n]+$", body)):
        if s and found and len(s) < 12:
            found[-1] = (found[-1] + s).strip()
        elif s:
            found.append(s)
    han = re.compile("[一-鿿]")
    chars = han.findall(body)
    scored = sorted(((-sum(chars.count(c) for c in han.findall(s)) * (0.6 if len(s) < 15 else 0.8 if len(s) > 120 else 1.0), k, s) for k, s in enumerate(found)))
    listed = "\n".join(f"• {s}" for _, _, s in scored[:bullets])
    return "" if not text else f"{title}\n{listed}" if title is not None else listed


def test_summaries_equal_a_plain_model(spark):
    texts = [t for _, t in fx.TEXTS] + ["甲。" * 30, "a!b?c\n" * 10, "标题\n" + "。".join("天地玄黄宇宙洪荒"[: k % 7 + 2] * 2 for k in range(20)) + "。"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").selectExpr("*", "1 as i", "2 as rank")
    got = {r["id"]: r["summary"] for r in summarize.extractive(df, "id", "text", Config()).collect()}
    assert got == {k: plain_summary(t or "") for k, t in enumerate(texts)}
    merged = {r[0]: r[1] for r in df.select("id", summarize.merged_sentences(df["text"])).collect()}
    rows = {}
    for r in summarize.sentences(df, "id", "text").orderBy("id", "i").collect():
        rows.setdefault(r["id"], []).append(r["sentence"])
    assert {k: v for k, v in merged.items() if v} == rows


def test_models_answer_or_fall_back(spark):
    df = spark.createDataFrame([(1, "今天天气很好，我们。"), (2, "fail"), (3, ""), (4, None), (5, "x" * 300)], "id bigint, text string")

    def shout(t):
        if t == "fail":
            raise ValueError
        return t.upper() if len(t) < 100 else " "

    got = {r["id"]: r for r in translate.translated(df, "id", "text", Config(), CallableModel(shout)).collect()}
    assert got[2]["ja"] == "【翻訳未実施】fail" and got[2]["engine"] == "model" and got[3]["reason"] == got[4]["reason"] == "empty" and got[5]["ja"] == "【翻訳未実施】" + "x" * 200 + "…"
    only = {r["id"]: r["engine"] for r in translate.translated(df, "id", "text", Config(), None, True).collect()}
    assert only == {1: "fallback", 2: "skip", 3: None, 4: None, 5: "skip"}
    summaries = {r["id"]: r["summary"] for r in summarize.summarized(df, "id", "text", Config(), CallableModel(shout)).collect()}
    assert summaries[2] == "fail\n" and summaries[3] == "" and summaries[1] == "今天天气很好，我们。"


def test_fetching(spark):
    stored = fetch.StoredFetcher((("https://e.com/a", 200, "Text/HTML; charset=gbk", "中".encode("gbk")),))
    rows = {r["ord"]: r for r in fetch.fetched(fetch.url_list(spark, ["https://e.com/a", "https://e.com/none"]), stored).collect()}
    assert rows[0]["html"] == "中" and rows[0]["content_type"].startswith("text/html") and rows[1]["error"] == "KeyError" and rows[1]["status_code"] is None


def test_mails(spark, tmp_path):
    config = Config(outbox=str(tmp_path), items_per_mail=20, save_preview=False)
    mails = deliver.rendered(spark.createDataFrame(fx.ITEMS, "ord bigint, item string"), "item", "2025-03-01", config)
    rows = mails.orderBy("part").collect()
    assert [r["subject"] for r in rows] == ["News digest 2025-03-01 (1/2)", "News digest 2025-03-01 (2/2)"]
    assert rows[0]["plain"].startswith("01. first & <b>\"q\" 'a'</b>\n02. \n03. \n04. two\nlines\n05. item 5") and rows[1]["plain"].startswith("01. item 21\n")
    assert "<li>first &amp; &lt;b&gt;&quot;q&quot; &#x27;a&#x27;&lt;/b&gt;</li><li></li>" in rows[0]["html"] and "two<br>lines " in rows[0]["html"]
    done = sinks.delivered(mails, [], config, "stamp")
    assert done["sent"] == [] and len(done["saved"]) == 2
    with open(done["saved"][0], "rb") as f:
        assert email.message_from_binary_file(f)["Subject"] == "News digest 2025-03-01 (1/2)"
    assert deliver.rendered(spark.createDataFrame([], "ord bigint, item string"), "item", "x", config).count() == 0

    class Down:
        def send(self, message):
            raise OSError

    assert len(sinks.delivered(mails, ["a@e.com"], config, "again", Down())["saved"]) == 2


def test_pipeline_and_stream(spark, tmp_path):
    rows = [(k, f"https://h{k % 3}.com/news/{k}", None, 200, "text/html", ARTICLE.replace("bridge", f"bridge {k}"), None) for k in range(6)]
    digest = pipeline.run(pages(spark, rows), Config(max_results=5), "2025-03-01")
    counts = pipeline.counters(digest).first().asDict()
    assert counts == {"scraped": 5, "pages": 5, "chinese": 0, "with_text": 5, "translated": 5}
    digest.release()
    folder, seen = str(tmp_path / "in"), []
    pages(spark, rows).write.parquet(folder)
    query = cycle.start(cycle.page_stream(spark, folder), Config(max_results=2), str(tmp_path / "cp"), lambda: "2025-03-01", lambda d, n: seen.append(d.mails.count()), str(tmp_path / "audit"))
    query.awaitTermination(120)
    assert seen == [1] and spark.read.json(str(tmp_path / "audit")).count() == 6
    assert cycle.tagged_urls(cycle.page_stream(spark, folder), Config()).isStreaming and cycle.once(spark.readStream.format("rate").load().selectExpr("timestamp as t", "'u' as url"), "t", "1 hour").isStreaming


def test_cli(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "in")
    pages(spark, [(1, "https://e.com/news/1", None, 200, "text/html", ARTICLE, None)]).write.parquet(folder)
    monkeypatch.setenv("TIDEMARK_OUTBOX", str(tmp_path / "out"))
    monkeypatch.setattr(cli, "local", lambda: spark)
    assert cli.main(["--pages", folder, "--once", "--audit", str(tmp_path / "audit")]) == 0
    assert len(list((tmp_path / "out").iterdir())) == 1
    stored = fetch.StoredFetcher((("https://e.com/news/2", 200, "text/html", ARTICLE.encode()),))
    model = CallableModel(lambda t: '[{"title": "x", "url": "https://e.com/news/2"}, {"url": "https://e.com/gone"}]' if t.endswith("rivers") else "no idea")
    monkeypatch.setenv("TIDEMARK_ACCEPTED_DOMAINS", "e.com")
    assert cli.main(["--interests", "rivers, lakes", "--once", "--audit", str(tmp_path / "audit2")], model, stored) == 0
    assert spark.read.json(str(tmp_path / "audit2")).select("reason").collect()[0][0] == "accepted_content_ready"
    assert discover.proposed(spark.createDataFrame([("a",)], "t string"), "t", Config(), None).count() == 0
    assert sinks.append_json(spark.range(1), "/proc/none/x") is False


def test_interest_and_recipient_lists(spark):
    df = spark.createDataFrame(fx.LISTS, "ord bigint, list string")
    assert {r[0]: r[1] for r in df.select("ord", discover.interests(df["list"])).collect()} == {1: ["ai", "新能源", "半导体", "芯片", "xy"], 2: [], 3: ["one"], 4: [], 5: None}
