"""Problems 2 to 6, on small tables with the cases that real ones have."""

from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm import langid, pagediff, recode, residue, sitelines

EN = "The council opened the new bridge on Monday after a long debate, and many people came to see it in the rain. It is not clear who will pay for the work."
DE = "Der Rat eröffnete am Montag nach langer Debatte die neue Brücke, und viele Menschen kamen im Regen, um sie zu sehen. Unklar ist, wer die Arbeit bezahlt."
FR = "Le conseil a ouvert lundi le nouveau pont après un long débat, et beaucoup de gens sont venus le voir sous la pluie. On ne sait pas qui paiera."
JA = "市の評議会は月曜日に長い議論の末に新しい橋を公開した。雨の中で多くの人が見に来た。誰が払うのかはまだ分からない。"
ZH = "市议会周一经过长时间讨论后开放了新的桥梁，许多人冒雨前来观看。没有人说得清由谁付款。"


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French"), ("ja", "Japanese"), ("zh", "Chinese")], "code string, english_name string")


def test_languages_of_items_and_paragraphs(spark, codes):
    rows = [(k, t, x) for k, (t, x) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr"), (JA, "ja"), (ZH, "zh")] * 3)]
    rows += [(100, DE, "en"), (101, EN + "\n\n" + EN + "\n\n" + FR, "EN_gb"), (102, ZH, None), (103, JA, " Japanese "), (104, "", "en"), (105, None, "en"), (106, EN, "n/a"), (107, EN + "\n\n" + DE, "eng"), (108, "ok", "en"), (109, FR, "fra")]
    df = spark.createDataFrame(rows, "item_id bigint, text string, lang string").selectExpr("*", "1 as seg_no", "2 as main")
    found = {(r["item_id"], r["seg_no"]): r["lang"] for r in langid.wrong_or_foreign(langid.identify(df, codes)).collect()}
    assert found == {(100, -1): "de", (101, 2): "fr", (102, -1): "zh", (106, -1): "en"}
    both = {(r["item_id"], r["seg_no"]): r["confidence"] for r in langid.identify(df, codes).collect()}
    assert (107, -1) not in both and (107, 1) in both and (104, 0) not in both and all(0 <= c <= 1 for c in both.values())


def test_no_labelled_row_gives_no_rows(spark, codes):
    df = spark.createDataFrame([(1, EN, None)], "item_id bigint, text string, lang string")
    assert langid.identify(df, codes).count() == 0 and langid.identify(df.limit(0), codes).count() == 0


def test_wrong_labels_in_training_are_left_out():
    texts, labels = [EN, DE, FR] * 10 + [DE, DE], ["en", "de", "fr"] * 10 + ["en", "en"]
    p = langid.fit_noisy(texts, labels)
    assert [p.langs[k] for k in p.distances([EN, DE, FR])[0].argmin(axis=1)] == ["en", "de", "fr"]


def word(k):
    return "".join("bdfglmnprt"[int(c)] + "aeiou"[int(c) % 5] for c in str(k))


def pages(spark):
    foot = ["© 2024 The Post. All rights reserved.", "Print this page"]
    rows = []
    for k in range(40):
        own = [f"Story {word(k)} begins here with the mayor of {word(k * 7)} who said that the plan of {word(k * 13)} was sound and that the work on the {word(k)} bridge can start in the spring of the next year, for all."]
        own += [f"A second part about the river {word(k * 3)} tells what the farmers there thought of it, and that people of {word(k * 11)} wrote letters to the council in the week before the vote was taken in {word(k * 5)}."]
        own += [f"The third and last part, on the house of {word(k * 17)}, is about the rooms that the family of the {word(k * 19)} miller had to leave when the water came over the bank at {word(k * 23)}, which nobody there forgot."]
        teasers = ["Most read", f"Why the council of {word(k * 31)} closed the {word(k)} bridge"] if k % 2 else []
        rows.append((k, f"https://www.Post.example:443/news/{k}.html", "\n".join(["News | Sport | Home", "", *own, *teasers, *foot]), 200, True))
    rows += [(100, None, "text", 200, True), (101, "https://post.example/x", None, 500, False), (102, "https://post.example/news/zz", "404 Not Found\nPage not found\n" + "\n".join(foot), 404, False), (103, "https://post.example/news/40.html", "", 200, True)]
    return spark.createDataFrame(rows, "scrape_id bigint, resolved_url string, body string, status_code int, ok boolean").selectExpr("*", "1 as site", "2 as path", "3 as line_no")


def test_page_differencing(spark):
    out = {r["scrape_id"]: r for r in pagediff.main_text(pages(spark)).collect()}
    assert 100 not in out and 101 not in out
    for k in range(40):
        lines = [x for x in out[k]["article"].split("\n")]
        assert len(lines) == 3 and lines[0].startswith(f"Story {word(k)} ") and len(out[k]["lines"]) == (5 if k % 2 else 3)
    assert out[103]["article"] is None and out[102]["article"] is None
    assert pagediff.main_text(pages(spark).limit(0)).count() == 0


@pytest.mark.parametrize("partitions", [1, 4, 16, 64])
def test_neighbours_do_not_depend_on_partitions(spark, partitions, monkeypatch):
    monkeypatch.setattr(pagediff, "SEGMENT", 8)
    monkeypatch.setattr(pagediff, "REACH", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = pages(spark).select(F.col("scrape_id").alias("_id"), sitelines.site_of(F.col("resolved_url")).alias("site"), pagediff.url_path(F.col("resolved_url")).alias("path"), "body").filter("site is not null and body is not null")
        got = pagediff.segments(rows).groupBy("site", "segment").agg(F.sort_array(F.collect_list(F.struct("rank", "_id", "core"))).alias("x")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted((f"/news/{k}.html" if k < 40 else "/news/zz" if k == 102 else "/news/40.html", k) for k in [*range(40), 102, 103])
    for r in got:
        first, last = max(8 * r["segment"] - 3, 0), min(8 * r["segment"] + 11, 42)
        assert [(x["rank"], x["_id"], x["core"]) for x in r["x"]] == [(n, order[n][1], n // 8 == r["segment"]) for n in range(first, last)]
    assert sum(x["core"] for r in got for x in r["x"]) == 42


def test_a_page_among_versions_of_itself_is_held_against_its_host(spark):
    df = pages(spark)
    copies = df.filter("scrape_id = 7").select("scrape_id", F.explode(F.sequence(F.lit(1000), F.lit(1099))).alias("n"), "resolved_url", "body", "status_code", "ok").drop("scrape_id").withColumnRenamed("n", "scrape_id")
    out = {r["scrape_id"]: r["lines"] for r in pagediff.main_text(df.select(*copies.columns).union(copies)).collect()}
    # teasers below a lead are found only beside other articles
    wrong = {k: x for k, x in out.items() if k >= 1000 and not set(x or ()) >= {0, 5, 7, 8}}
    assert not wrong and len(out[7]) == 5


def test_pages_without_resolved_url_are_placed_by_the_url_asked_for(spark):
    df = pages(spark).selectExpr("scrape_id", "resolved_url as input_url", "case when scrape_id not in (7, 8) then resolved_url end as resolved_url", "body", "status_code", "ok")
    out = {r["scrape_id"]: r for r in pagediff.main_text(df, asked_col="input_url").collect()}
    assert len(out[7]["lines"]) == 5 and len(out[8]["lines"]) == 3 and 101 not in out
    assert out[100]["article"] == "text" and out[100]["lines"] == []


def test_versions_of_one_article_are_no_pair():
    body = "\n".join(f"A long paragraph number {k} with enough words in it to be an article, about the same bridge and the same mayor, and the letters of {k} people to the council of it." for k in range(5))
    a, b = pagediff.Page(1, "s", body), pagediff.Page(2, "s", body + "\nOne more line")
    pagediff.align(a, b)
    assert not a.shared and not b.shared


def test_increasing_is_longest():
    assert [pagediff.increasing(x) for x in ([], [3, 1, 2, 5, 4, 6], [2, 1])] == [[], [1, 2, 4, 5], [1]]


def test_repeated_lines_equal_sql(spark):
    df = pages(spark)
    got = sorted((r["scrape_id"], r["line_no"]) for r in sitelines.find_repeated(df).collect())
    con = duckdb.connect()
    con.register("scrape_meta", df.select("scrape_id", "resolved_url", "body").toPandas())
    assert got == sorted(con.execute(sitelines.ORACLES["p4_found"]).fetchall()) and got
    removed = sitelines.remove_repeated(df).collect()
    assert sorted(map(str, (tuple(r) for r in removed))) == sorted(map(str, con.execute(sitelines.ORACLES["p4_clean"]).fetchall()))
    clean = {r["scrape_id"]: r["body"] for r in removed}
    assert clean[101] is None and clean[100] == "text" and "Print this page" not in clean[3] and clean[0].split("\n")[1].startswith("Story ba ")
    assert sitelines.find_repeated(df.limit(0)).count() == 0


def test_lines_that_stand_everywhere_are_no_lines_of_a_site(spark):
    """The same footer on most pages of all sites is in excess on none of them; a line of one site is."""
    rows = [(100 * s + k, f"https://s{s}.example/{k}", "\n".join([f"own {word(s * 97 + k)}", *(["Advertisement"] if k % 10 else []), *(["Only here"] if s == 3 and k % 2 else [])])) for s in range(8) for k in range(40)]
    df = spark.createDataFrame(rows, "scrape_id bigint, resolved_url string, body string").repartition(5)
    found = sitelines.repeated_lines(df).collect()
    assert [(r["site"], r["records"], r["elsewhere"]) for r in found] == [("s3.example", 20, 0)]
    got = {(r["scrape_id"], r["line_no"]) for r in sitelines.find_repeated(df).collect()}
    assert got == {(300 + k, 2 if k % 10 else 1) for k in range(1, 40, 2)}


def test_removal_keeps_order_blank_lines_and_repeated_rows(spark):
    rows = [(k, "https://a.example/x", f"first {word(k)}\n\nsame\nlast {word(k * 3)}\nsame") for k in range(12)] * 2 + [(50, "https://a.example/y", "same"), (51, None, "same"), (52, "https://a.example/z", None), (53, "https://a.example/z", "")]
    df = spark.createDataFrame(rows, "scrape_id bigint, resolved_url string, body string").selectExpr("*", "1 as site", "2 as salt", "3 as _row")
    out = sorted((r["scrape_id"], r["body"], r["removed"]) for r in sitelines.remove_repeated(df).collect() if r["body"] is not None)
    assert out == sorted([(k, f"first {word(k)}\n\nlast {word(k * 3)}", 2) for k in range(12)] * 2 + [(50, "", 1), (51, "same", 0), (53, "", 0)])


def test_false_discovery_threshold():
    assert sitelines._least_g([(0, 1000)], 1000, 0.05) == float("inf")
    assert sitelines._least_g([(0, 1000), (400, 10)], 1010, 0.05) == 50


RESIDUE = ["{{ article.title }}", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Seite nicht gefunden", "ページが見つかりません", "The council opened ${street} bridge on Monday.", "null", "此处添加正文内容", "It rained XXXX on %(day)s in the town."]
NATURAL = [EN, DE, FR, JA, ZH, "The council opened the new bridge on Monday, and “404 Not Found” was what many people came to see.", *(" ".join([t] * 4) + " One chapter explains what {{ name }} means in a template and why it leaked into letters." for t in (EN, DE, FR, EN + DE))]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(k, t, 200, True) for k, t in enumerate([" ".join([x] * 6) for x in (EN + " " + NATURAL[5], DE, FR, JA, ZH)] * 8)]
    rows += [(100 + k, t, 404 if k % 2 else 200, True) for k, t in enumerate(RESIDUE)] + [(200 + k, t, 200, True) for k, t in enumerate(NATURAL)] + [(300, None, None, False), (301, "  ", 500, None)]
    df = spark.createDataFrame(rows, "scrape_id bigint, body string, status_code int, ok boolean").selectExpr("*", "1 as peak", "2 as _t")
    return df, {r["scrape_id"] for r in residue.find(df).collect()}


def test_residue_is_found(judged):
    missing = [RESIDUE[k] for k in range(len(RESIDUE)) if 100 + k not in judged[1]]
    assert not missing


def test_natural_text_and_talk_about_residue_stay(judged):
    wrong = [k for k in judged[1] if not 100 <= k < 200]
    assert not wrong


def test_residue_is_learned_from_every_row(spark):
    """The failed records that hold the notice are those a sample of 4,000 by hash lacks."""
    notice = "Gjennomstrømming stanset av vaktmester Ødegård"
    ids = spark.range(12000).withColumn("h", F.xxhash64("id")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("h"))))
    failed = ids.select(F.col("id").alias("scrape_id"), F.when(F.col("rank") <= 40, F.lit(notice)).otherwise(F.lit("502 Bad Gateway")).alias("body"), F.lit(502).alias("status_code"), F.lit(False).alias("ok"))
    rows = [(20000 + k, " ".join([x] * 6), 200, True) for k, x in enumerate([EN, DE, FR, JA, ZH] * 8)]
    model = residue.train(failed.union(spark.createDataFrame(rows, failed.schema)), "scrape_id", "body", "status_code", "ok")
    peaks = model.peaks([notice, EN])
    assert peaks[0] >= residue.LEAST > peaks[1]


def test_residue_models_dont_depend_on_partitions(spark, judged):
    one, many = (residue.train(judged[0].repartition(n), "scrape_id", "body", "status_code", "ok") for n in (1, 7))
    assert (one.gram == many.gram).all() and (one.shape == many.shape).all()


def test_lines_that_natural_records_hold_as_often_are_no_notices(spark):
    rows = [(f"{EN} {k}\nSubscribe to the Meadow Letter" + "\nStörung im Umspannwerk" * (k == 0),) for k in range(1000)]
    natural = spark.createDataFrame(rows, "t string")
    texts = spark.createDataFrame([("Störung im Umspannwerk\nSubscribe to the Meadow Letter",)] * 20, "t string")
    held = residue._lines(natural).groupBy("key").agg(F.count("*").alias("held"))
    counts = residue.count_notices(texts, held, 1000)
    assert counts.gram.sum() == residue.Counts().add(["Störung im Umspannwerk"], 20).gram.sum() > 0


def test_residue_of_an_empty_table(judged):
    assert residue.find(judged[0].limit(0)).count() == 0


def garbled():
    rows = [(k, "http://a.example/x", t[:60], "\n".join([t] * 3)) for k, t in enumerate([EN, DE, FR, JA, ZH] * 10)]
    broken = [(100, DE.encode().decode("cp1252", "replace"), DE), (101, "Größe " + FR.encode().decode("latin-1"), None), (102, JA.encode("cp932").decode("latin-1"), JA), (103, ZH.encode("gb18030").decode("latin-1"), ZH), (104, DE.encode().decode("mac-roman"), DE), (105, "The br�cke was open.", None)]
    broken += [(106, FR.encode().decode("latin-1").encode().decode("latin-1"), FR)]
    quoted = [(200, "The feed printed “Ã©” where an accent belonged."), (201, "屏幕上一度显示“锟斤拷”字样，" + ZH), (202, DE), (203, None), (204, "")]
    return rows + [(k, "http://a.example/y", None, b) for k, b, *_ in broken + quoted], broken


def test_damage_is_found_and_undone(spark):
    rows, broken = garbled()
    df = spark.createDataFrame(rows, "scrape_id bigint, resolved_url string, title string, body string").selectExpr("*", "1 as source", "2 as odds")
    assert {r["scrape_id"] for r in recode.damage(df).collect()} == {k for k, *_ in broken}
    fixed = {r["scrape_id"]: (r["restored"], r["complete"]) for r in recode.restore(df).collect()}
    assert all(fixed[k] == (t, True) for k, _, t in broken if t) and not fixed[105][1] and fixed[101][0].endswith(FR)
    assert recode.damage(df.limit(0)).count() == 0 and recode.restore(df.limit(0)).count() == 0


RU = "Местные фермеры открыли новый мост в понедельник после долгих споров, и соседи просили больше времени."


def test_each_line_has_its_own_cipher(spark):
    body = "\n".join([DE.encode().decode("cp1252", "replace"), DE, RU.encode("koi8-r").decode("cp1251"), DE.encode().decode("mac-roman")])
    rows = [(k, "http://r.example/x", None, x) for k, x in enumerate([RU, DE, FR] * 10)] + [(100, "http://r.example/x", None, body)]
    df = spark.createDataFrame(rows, "scrape_id bigint, resolved_url string, title string, body string")
    found = {(r["scrape_id"], r["line_no"]): r["cipher"] for r in recode.damage(df).collect()}
    assert found == {(100, 0): "cp1252>utf-8", (100, 2): "cp1251>?", (100, 3): "mac-roman>utf-8"}
    assert [r["restored"] for r in recode.restore(df).collect()] == ["\n".join([DE, DE, RU, DE])]


def test_letters_of_an_unknown_page_are_learned():
    """A page that has most letters where KOI8-R has them, and some where another page has them: no page of the library is like it."""
    page = lambda t: b"".join(c.encode("cp866" if c in "ов" else "koi8-r") for c in t).decode("cp1251")
    nouns = "мост совет город фермер сосед рынок школа река дорога музей театр вокзал завод поле берег парк".split()
    texts = [f"В понедельник жители узнали, что {nouns[k % 16]} и {nouns[k * 7 % 16]} вчера открыли, а {nouns[k * 5 % 16]} снова закрыли после долгих споров номер {k}." for k in range(160)]
    pair, single = np.zeros(1 << recode.BITS), np.zeros(1 << 16)
    recode.Bigrams.count(texts, pair, single)
    model, letters = recode.Bigrams(pair, single), Counter()
    assert "cp1251>koi8-r" in recode.readings(page(texts[1]), model, True)
    for _ in range(2):  # rounds of EM over the lines of one source
        state = recode.State(None, [{"cipher": "cp1251>?", "symbol": a, "letter": b, "n": n} for (a, b), n in letters.items()], {})
        letters = Counter()
        for t in texts[:32]:
            for symbol, of in recode.forward_backward(page(t), "cp1251>?", state, model)[1]:
                for letter, p in of:
                    letters[symbol, letter] += p
    state = recode.State(None, [{"cipher": "cp1251>?", "symbol": a, "letter": b, "n": n} for (a, b), n in letters.items()], {})
    table = {ord(c): max(state.letters("cp1251>?", c), key=lambda x: x[1])[0] for c in set("".join(map(page, texts))) if recode._inverse("cp1251").get(c, 0) > 127}
    assert [page(t).translate(table) for t in texts] == texts


def test_symbols_align_with_letters():
    for text, shown, written in (("Größe „ja“", "cp1252", "utf-8"), ("日本語です。", "mac-roman", "cp932"), ("中文文本", "gb18030", "utf-8"), ("Русский", "cp1251", "koi8-r")):
        line = "".join(chr(b) if bytes([b]).decode(shown, "replace") == "\ufffd" else bytes([b]).decode(shown) for b in text.encode(written)) if shown != "gb18030" else text.encode(written).decode(shown, "replace")
        if "\ufffd" not in line:
            pieces = recode.symbols(line, f"{shown}>{written}")
            assert "".join(a for a, _ in pieces) == line and "".join(b for _, b in pieces) == text == recode.apply(line, f"{shown}>{written}")
    twice = "éàü".encode().decode("latin-1").encode().decode("latin-1")
    assert [x for x in recode.symbols(twice, "cp1252>utf-8+cp1252>utf-8") if x[0]] == [(twice[4 * k : 4 * k + 4], c) for k, c in enumerate("éàü")]


@pytest.mark.parametrize("shown, written", [("cp1251", "koi8-r"), ("koi8-r", "cp1251")])
def test_a_swap_of_many_rows_does_not_vouch_for_itself(spark, shown, written):
    nouns = "мост совет город фермер сосед рынок школа река дорога музей театр вокзал завод поле берег парк".split()
    verbs = "открыли закрыли построили обсудили увидели проверили отложили одобрили продали осмотрели".split()
    texts = [f"В понедельник жители узнали, что {nouns[k % 16]} и {nouns[k * 7 % 16]} вчера {verbs[k % 10]}, а {nouns[k * 5 % 16]} снова {verbs[k * 3 % 10]} после долгих споров номер {k}." for k in range(100)]
    bad = {k for k in range(100) if k % 10 in (1, 4, 8)}
    rows = [(k, f"http://{k % 3}.example/x", None, t.encode(written).decode(shown) if k in bad else t) for k, t in enumerate(texts)] + [(100 + k, None, None, t) for k, t in enumerate([EN, DE, FR, JA, ZH] * 10)]
    df = spark.createDataFrame(rows, "scrape_id bigint, resolved_url string, title string, body string")
    assert {(r["scrape_id"], r["cipher"]) for r in recode.damage(df).collect()} == {(k, f"{shown}>?") for k in bad}
    assert {r["scrape_id"]: r["restored"] for r in recode.restore(df).collect()} == {k: texts[k] for k in bad}


def test_clean_lines_that_repeat_stay(spark):
    """A reading that would fit a line better can't gain from the copies of the line."""
    rows = [(k, "http://a.example/x", "Ещё от редакции", f"{RU} {k}\nЩёки и ещё щётка.\nEste sítio guarda dados no seu dispositivo.") for k in range(60)]
    df = spark.createDataFrame(rows, "scrape_id bigint, resolved_url string, title string, body string")
    assert recode.damage(df).count() == 0


def test_bounded_sample(spark):
    from tidemark.llm.sampling import bounded_sample

    df = spark.range(10000)
    a, b = bounded_sample(df, F.col("id"), 100), bounded_sample(df.repartition(7), F.col("id"), 100)
    assert len(a) == 100 and a.id.tolist() == b.id.tolist() and isinstance(a, pd.DataFrame)
