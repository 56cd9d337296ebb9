"""Small inline inputs for operators whose cases the tables lack, as rows for Spark and as VALUES for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

URLS = [
    (1, "example.com/a?utm_source=x&b=1#top"), (2, "http://Example.com:80/x y?flag&UTM_Medium=1&q=a%20b~*"), (3, "host:8080/x"), (4, "https://example.com/"), (5, "ftp://example.com/x"), (6, "https://example.com"),
    (7, "https://example.com/news/amp"), (8, "https://example.com/amp/story?amp=1&x=2"), (9, "https://example.com/a?x=1&output=amp"), (10, "https://example.com/AMP/amp/"), (11, "mailto:a@example.com"), (12, ""), (13, "/relative/path"),
    (14, "https://user:pw@example.com:8443/p?a=&&b=%zz&fbclid=9"), (15, "https://example.com/2025/04/03/title"), (16, "//cdn.example.com/y?k=é ü"), (17, "https://example.com/a?x=1+2&si=7"), (18, None),
]
CANONICALS = [
    (1, "https://www.example.com/a", "https://example.com/a"), (2, "https://example.com/a", "https://m.example.com/a?utm_id=1"), (3, "https://example.com/a", "https://other.test/a"), (4, "https://example.com/a", "http://example.com/a"),
    (5, "https://example.com/a", "https://example.com/"), (6, "https://example.com/a", "/relative"), (7, "http://example.com/a", "https://example.com/b/amp"), (8, "http://example.com/a", None),
]
HEADS = [
    (1, "text/html; charset=utf-8", "<p>x</p>"), (2, None, "<!DOCTYPE HTML><title>t</title>"), (3, "application/json", "{}"), (4, "APPLICATION/XHTML+XML", ""), (5, None, " <HTML lang=x>"), (6, "application/pdf", None), (7, "", "plain"), (8, "text/plain", "<html>"),
]
SAMPLES = [
    (1, "今天天气很好，我们去公园。"), (2, "これは日本語の文章です。"), (3, "English text only."), (4, "汉字 with more Latin letters than that, so the share is low enough here"), (5, "Только русский текст"), (6, ""), (7, None), (8, "   "), (9, "★★★!!!\n正文在这里，很长的正文"), (10, "★★★!!!"),
    (11, "漢字漢字漢字漢字漢字"), (12, "漢字漢字漢字漢字漢"), (13, "a\r\nb https://example.com/x c"), (14, "ァ"), (15, "12345 67890"), (16, "汉字汉字 abcdefghijklmnopqrstuvwxyz"),
]
TEXTS = [
    (1, "标题\n第一句话很长很长很长很长。短。第二句话也很长很长很长啊！第三句？"), (2, "Only one line"), (3, ""), (4, None), (5, "x" * 81 + "\n今天今天今天今天今天今天今天今天。明天明天明天明天明天！"), (6, "甲乙丙丁戊己庚辛壬癸子丑寅卯。甲乙丙丁戊己庚辛壬癸子丑寅卯辰。" + "甲" * 121 + "。"), (7, "A!B?C\nD"), (8, "\n\n  \n"),
]
ANSWERS = [
    (1, '[{"title": "a", "url": "https://example.com/news/1", "source": "s", "date_iso": "2025-03-01"}, 5, {"url": " http://www.example.test/x "}]'), (2, 'Here:\n```json\n[{"title": "b", "url": "https://sub.example.com/2025/03/02/y"}, {"title": "no", "url": "ftp://example.com"}]\n```'), (3, "[]"),
]
LISTS = [(1, "ai , 新 能源;半导体、芯片\n x y "), (2, ""), (3, "one"), (4, ",;、"), (5, None)]
ADDRESSES = [(1, "a@example.com, b@example.com;c@example.com  nobody"), (2, ""), (3, None), (4, "x")]
ITEMS = [(1, "first & <b>\"q\" 'a'</b>"), (2, ""), (3, None), (4, "two\nlines "), *[(k, f"item {k}") for k in range(5, 24)]]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql(rows: list[tuple], names: str) -> str:
    """The rows as a parenthesised query."""
    def one(v: object) -> str:
        if v is None:
            return "cast(null as varchar)"
        if isinstance(v, int):
            return f"cast({v} as bigint)"
        return "'" + str(v).replace("'", "''") + "'"

    return "(select * from (values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") t({names}))"
