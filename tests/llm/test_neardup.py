"""Problem 1, against brute force."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import neardup


def brute(rows, words, threshold, min_letters=0):
    sets = {}
    for key, text in rows:
        w = re.findall(r"[一-鿿ぁ-ヿ]|[^\W_一-鿿ぁ-ヿ]+", (text or "").lower())
        if len(re.findall(r"[^\W_]", text or "")) >= min_letters and len(w) >= words:
            sets[key] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus():
    random.seed(7)
    words = [f"w{k}" for k in range(400)]
    rows, key = [], 0
    for _ in range(60):
        base = [random.choice(words) for _ in range(120)]
        for edits in (0, 0, 2, 4):
            text = list(base)
            for _ in range(edits):
                text[random.randrange(len(text))] = random.choice(words)
            rows.append((key, " ".join(text)))
            key += 1
    rows += [(key, None), (key + 1, ""), (key + 2, "a b c"), (key + 3, "汉字" * 60), (key + 4, "汉字" * 60 + "新"), (key + 5, "汉字" * 60)]
    return rows


@pytest.fixture(scope="module")
def made(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id bigint, text string").selectExpr("*", "1 as bucket", "2 as rep")
    return rows, df, neardup.similar(df, 0.7)


def test_pairs_equal_brute_force(made):
    rows, _, (pairs, members) = made
    found = {(r["a"], r["b"]) for r in neardup.expand(pairs, members).collect()}
    assert found == brute(rows, 5, 0.7)


def test_classes_and_links(made):
    rows, _, (pairs, members) = made
    got = {r["id"]: (r["class_id"], r["links"]) for r in neardup.classes(pairs, members).collect()}
    parent = {k: k for k in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows, 5, 0.7):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {k: c for k, (c, _) in got.items()} == {k: root(k) for k in got}
    assert got[0][1] == got[1][1] and len(got) == 243


def test_every_page_has_a_class(spark, tmp_path):
    long = " ".join(f"word{k}" for k in range(100))
    rows = [(1, long), (2, long + " more"), (3, "short text"), (4, None), (5, "short text"), (6, " "), (7, " "), (8, None), (9, "other text")]
    spark.createDataFrame(rows, "scrape_id bigint, body string").write.parquet(f"{tmp_path}/scrape_meta.parquet")
    got = {r["scrape_id"]: (r["class_id"], r["links"]) for r in neardup.p1_classes(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 5: (3, 0), **{k: (k, 0) for k in (4, 6, 7, 8, 9)}}


def test_hot_bucket_is_cut_into_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "PROBE", 1)
    keyed = spark.createDataFrame([(1, k) for k in range(30)] + [(2, 99)] + [(3, k) for k in range(3)], "bucket bigint, id bigint")
    got = [(r["a"], r["b"]) for r in neardup._pairs(keyed).collect()]
    assert sorted(got) == sorted([(a, b) for a in range(30) for b in range(a + 1, 30)] + [(0, 1), (0, 2), (1, 2)])


def test_no_task_holds_a_hot_bucket(spark):
    """Of one bucket with all ids, no cell holds more than a few blocks, and the cells hold each pair once."""
    n = 20_000
    keyed = spark.range(n).selectExpr("1L as bucket", "id")
    pairs = neardup._pairs(keyed)
    counts = pairs.groupBy((pairs["a"] % 100).alias("k")).count().collect()
    assert sum(r["count"] for r in counts) == n * (n - 1) // 2


def test_banding_misses_few_pairs():
    """At 0.55, the least similarity of a true pair, about 1 in 54 pairs share no band; at 0.6 about 1 in 280."""
    rng = np.random.default_rng(3)
    for similarity, most in ((0.55, 0.025), (0.6, 0.007)):
        a = rng.integers(0, 256, (20000, neardup.ROWS), dtype=np.uint8)
        b = np.where(rng.random(a.shape) < similarity, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
        assert (~(neardup.bands(a) == neardup.bands(b)).any(axis=1)).mean() < most


def test_copies_are_expanded_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "PROBE", 1)
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, text) for k in range(25)] + [(100, text + " more")]
    pairs, members = neardup.similar(spark.createDataFrame(rows, "id bigint, text string"), 0.8)
    got = sorted((r["a"], r["b"]) for r in neardup.expand(pairs, members).collect())
    ids = [*range(25), 100]
    assert got == [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]]


def test_posterior_bound_keeps_true_pairs():
    rng = np.random.default_rng(0)
    for n, least in neardup.least_matches(0.5):
        assert 0 < least < n / 2
        assert (rng.binomial(n, 0.5, 20000) < least).mean() < 0.02
    matches = np.cumsum(rng.random((20000, neardup.ROWS)) < 0.55 + 0.45 / 256, axis=1)  # over all batches, at the least similarity of a true pair
    assert np.any([matches[:, n - 1] < least for n, least in neardup.least_matches(0.5)], axis=0).mean() < 0.005


def test_empty_and_string_ids(spark):
    empty = spark.createDataFrame([], "id string, text string")
    pairs, members = neardup.similar(empty, 0.8)
    assert pairs.count() == 0 and members.count() == 0 and neardup.classes(pairs, members).count() == 0
    text = " ".join(f"w{k}" for k in range(50))
    pairs, members = neardup.similar(spark.createDataFrame([("x", text), ("y", text + " more")], "id string, text string"), 0.8)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [("x", "y")]


def test_signatures_estimate_similarity():
    a, b = " ".join(f"w{k}" for k in range(300)), " ".join(f"w{k}" for k in range(60, 360))
    hashes, counts = neardup.shingles([a, b, ""], 5)
    sig = neardup.signatures(hashes, counts)
    true = len(set(hashes[: counts[0]]) & set(hashes[counts[0] :])) / len(set(hashes))
    assert counts[2] == 0 and abs((sig[0] == sig[1]).mean() - true) < 0.12
