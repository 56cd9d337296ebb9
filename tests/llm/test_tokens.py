"""Problems 7 to 9: encoding, containers, pieces."""

import base64
import random

import numpy as np
import pytest

from tidemark.llm import packing, pieces, tokenizer
from tidemark.llm import textcodes as tc

TRICKY = [
    "it's we'll I'm 'tis ''s x's's don't '", "  a\n\n b \t", "<|endoftext|> hi", " ", "\n", "a 's b", "x'", "'re've'll'd", "we'rex 'l 'v", "　a　b", "٣४५ 12a½Ⅷ", "😀😀 a", "s'\n's", " 's", "y'l l", "中文，日本語。한국어", "a\r\n\r\nb", "\x00​", "a" * 5000, "中" * 3000,
]


@pytest.fixture(scope="module")
def coder():
    return tokenizer.coder(tokenizer.vocabulary())


@pytest.fixture(scope="module")
def reference(coder):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_ids_equal_the_public_library(coder, reference):
    random.seed(5)
    texts = TRICKY + ["".join(random.choice(" '\n\tstrelvmda1é中。!\"- ") for _ in range(random.randint(0, 60))) for _ in range(4000)]
    ids, ends = coder.encode(texts)
    start = 0
    for text, end in zip(texts, ends.tolist()):
        assert ids[start:end].tolist() == reference.encode_ordinary(text), text
        start = end


def test_plain_merging_equals_the_library(coder):
    for piece in ("hello", " wonderful", "中文字", "ééé", "zqxj"):
        assert tokenizer.merge(piece.encode(), coder.ranks) == list(coder.merge(piece.encode()))


def test_chunks_and_cache_do_not_matter(coder, monkeypatch):
    whole = coder.encode(TRICKY)
    monkeypatch.setattr(tc, "CHUNK_CHARS", 7)
    monkeypatch.setattr(tokenizer, "CACHE_ENTRIES", 3)
    small = [coder._chunk([t]) for t in TRICKY]
    assert np.concatenate([x for x, _ in small]).tolist() == whole[0].tolist()


def test_encode_column_handles_nulls_repeats_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", None)], "doc_id bigint, text string, ids string")
    rows = sorted((r["doc_id"], list(r["ids"])) for r in tokenizer.encode_column(df).collect())
    assert rows == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert tokenizer.decode([64, 275]) == "a b"
    assert tokenizer.encode_column(df.limit(0)).collect() == []
    counts = {(r["doc_id"], r["n_tokens"]) for r in tokenizer.token_counts(df).collect()}
    assert counts == {(1, 2), (2, 0), (3, 0)}


def test_offsets_and_round_trip(spark, coder):
    texts = [*TRICKY, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as ids")
    spans = {r["doc_id"]: r for r in tokenizer.encode_spans(df).collect()}
    for k, t in enumerate(texts):
        r = spans[k]
        assert len(r["slice_starts"]) == len(r["slice_ids"])
        for n, (start, first) in enumerate(zip(r["slice_starts"], r["slice_ids"])):
            more = n + 1 < len(r["slice_ids"])
            assert coder.text(r["ids"][first : r["slice_ids"][n + 1] if more else None]) == t[start : r["slice_starts"][n + 1] if more else None]
    back = {r["doc_id"]: r["text"] for r in tokenizer.decode_column(tokenizer.encode_column(df)).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}


def test_cuts_of_a_long_text_with_bad_places_are_linear():
    import time

    rank = np.full(2_000_001, 4, np.uint8)
    rank[::7] = 8
    for k in range(900, len(rank), 1100):
        rank[k - 300 : k + 300] = 8
    began = time.perf_counter()
    ends = pieces.cuts(len(rank) - 1, rank, 1024, 64)
    starts = [0, *(e - 64 for e in ends[:-1])]
    assert all(0 < e - s <= 1024 for s, e in zip(starts, ends)) and ends[-1] == 2_000_000 and time.perf_counter() - began < 5


def test_plan_fits_and_fills():
    random.seed(2)
    sizes = [min(50, int(random.expovariate(0.1)) + 1) for _ in range(5000)]
    histogram = {n: sizes.count(n) for n in set(sizes)}
    slots, containers = packing.plan(histogram, 50)
    fill = [0] * containers
    taken = dict.fromkeys(histogram, 0)
    for length, first, last, container in slots:
        for r in range(first, last + 1):
            fill[container + r - first] += length
            taken[length] += 1
    assert max(fill) <= 50 and min(fill) > 0 and taken == histogram
    assert containers <= sum(sizes) / 50 * 1.01 + 1


def test_pack_places_every_item_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SORTED", 20)
    monkeypatch.setattr(packing, "BROADCAST", 3)
    rows = [(k, 7) for k in range(300)] + [(1000, 0), (1001, None), (1002, 25), (1003, 10), (1003, 10), (1004, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").selectExpr("*", "1 as container_id", "2 as _n")
    out = packing.pack(df, 10).toPandas()
    assert sorted(out.groupby("doc_id").n_tokens.sum().to_dict().items()) == sorted({k: 7 for k in range(300)}.items() | {1000: 0, 1001: 0, 1002: 25, 1003: 20, 1004: 3}.items())
    assert out.groupby("container_id").n_tokens.sum().max() <= 10
    assert out[out.doc_id == 1002].sort_values("piece_no").token_start.tolist() == [0, 10, 20]
    assert (out[(out.n_tokens > 0)].groupby("doc_id").size()[lambda s: s > 1].index == [1002, 1003]).all()
    assert packing.pack(df.limit(0), 10).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 0)], "doc_id bigint, n_tokens bigint"), 10).count() == 1


def test_cuts_keep_limit_and_overlap():
    random.seed(1)
    for n in (101, 150, 999, 1000, 5000):
        for fill in (8, None):
            rank = np.array([0, *((fill or random.randint(1, 8)) for _ in range(n - 1)), 0], np.uint8)
            ends = pieces.cuts(n, rank, 100, 16)
            starts = [0, *(e - 16 for e in ends[:-1])]
            assert ends[-1] == n and all(0 < e - s <= 100 for s, e in zip(starts, ends)) and ends == sorted(set(ends))
            assert len(ends) <= -(-(n - 16) // 84) + (0 if fill else n // 168 + 2)


def test_pieces_end_at_boundaries_and_cover_the_text(spark, coder):
    text = "\n\n".join(" ".join(f"word{k} and more." for k in range(j, j + 12)) for j in range(40))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "x" * 4000), (5, "汉字" * 800)], "doc_id bigint, text string").selectExpr("*", "1 as piece")
    out = pieces.split(df, 200, 20).toPandas().sort_values(["doc_id", "piece_no"])
    assert set(out.doc_id) == {1, 4, 5}
    for key, part in out.groupby("doc_id"):
        ids, _ = coder.encode([df.filter(f"doc_id = {key}").first()["text"]])
        ends = (part.token_start + part.n_tokens).tolist()
        assert part.n_tokens.max() <= 200 and ends[-1] == len(ids) and part.token_start.tolist() == [0, *(e - 20 for e in ends[:-1])]
    first = out[out.doc_id == 1]
    assert set(first.boundary[:-1]) <= {"blank line", "sentence"} and "".join(first.piece).startswith("word0 and")
    with pytest.raises(ValueError):
        pieces.split(df, 10, 10)


def test_boundary_strengths():
    text = "One. Two, three\nfour\n\nfive \"six.\" seven"
    rank = pieces.strengths(tc.codes(text))
    name = lambda part: pieces.NAMES[int(rank[text.index(part)])]
    assert [name(x) for x in (" Two", " three", "four", "five", " seven", "hree")] == ["sentence", "clause", "line", "blank line", "sentence", "character"]


def test_vocabulary_is_a_parameter(tmp_path):
    path = tmp_path / "tiny"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([k])) + b" %d" % k for k in range(256)))
    assert tokenizer.Coder(tokenizer.vocabulary(str(path))).encode(["ab"])[0].tolist() == [97, 98]
