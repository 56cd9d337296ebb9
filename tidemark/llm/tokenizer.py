"""Problem 7: encoding of the whole corpus with a public byte-level BPE tokenizer.

Pre-tokenisation runs without regular expressions: code points become classes, the few rules with memory (a
contraction claims the next one or two letters) become per-character transition functions, and composing those
associatively gives the state before every character. Any three characters' composition is a constant function, so two
doublings complete the scan. The slices between boundaries are hashed; a cache maps a slice's hash to its merged ids,
and pair merging runs once per slice that the cache doesn't hold.

Null and empty texts give an empty list. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textcodes as tc

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_BITS = 20
CACHE_ENTRIES = 300_000
_CODERS: dict = {}


def vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file (under 1 MB) as it goes to the executors."""
    with open(path, "rb") as f:
        return f.read()


def _contraction(cps: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """For each character 1 or 2 where it is an apostrophe that opens 's 't 'm 'd or 're 've 'll, else 0."""
    n = len(cps)
    found = np.zeros(n, np.uint8)
    at = np.flatnonzero(cps[: n - 1] == 39)
    if not len(at):
        return found
    # an apostrophe inside a run of other signs, or after a blank that belongs to its token, opens nothing
    free = (at == 0) | ((cls[at - 1] != tc.OTHER) & (cps[at - 1] != 32))
    at = at[free]
    a, b = cps[at + 1], cps[np.minimum(at + 2, n - 1)]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    found[at[one]] = 1
    found[at[two & ~one]] = 2
    return found


def _claimed(opens: np.ndarray) -> np.ndarray:
    """Letters still claimed by a contraction, before each character: the composition of all transitions before it.

    A transition maps a count r in 0..2 to the next one: at an opening to its length, elsewhere to max(r - 1, 0).
    """
    f = [np.where(opens > 0, opens, max(r - 1, 0)).astype(np.uint8) for r in range(3)]
    for step in (1, 2):
        g = [x.copy() for x in f]
        for r in range(3):
            g[r][step:] = np.choose(f[r][:-step], [x[step:] for x in f])
        f = g
    before = np.zeros(len(opens), np.uint8)
    before[1:] = f[0][:-1]
    return before


def boundaries(cps: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, in code points whose texts are followed by a BREAK each; a BREAK is a start as well."""
    n = len(cps)
    start = np.ones(n, bool)
    start[1:] = cls[1:] != cls[:-1]
    space = cls == tc.SPACE
    last = np.zeros(n, bool)  # the last of white space that is followed by a sign of the same text
    last[:-1] = space[:-1] & ~space[1:] & (cls[1:] != tc.BREAK)
    start |= last
    blank = last & (cps == 32)
    start[1:] &= ~blank[:-1]
    start |= cls == tc.BREAK
    opens = _contraction(cps, cls)
    if opens.any():
        left = _claimed(opens)
        start &= left == 0
        ended = np.zeros(n, bool)
        ended[1:] = (left[:-1] == 1) & (left[1:] == 0)
        start |= ended
    return np.flatnonzero(start)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain pair merging: the pair of the lowest rank first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        rank, k = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


class Coder:
    """Encodes batches of texts; keeps the merged ids of the slices it has seen."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.lengths = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for piece, rank in self.ranks.items():
            self.lengths[rank] = len(piece)
        try:
            import tiktoken

            core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})._core_bpe
            self.merge = core.encode_single_piece
        except (ImportError, AttributeError):
            self.merge = lambda piece: merge(piece, self.ranks)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << CACHE_BITS, np.uint64)
        self.slot = np.zeros(1 << CACHE_BITS, np.int32)
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.int32)
        self.entries = self.used = 0

    def _learn(self, pieces: list[bytes]) -> int:
        """Merges new slices; the number of the first new entry."""
        lists = [self.merge(p) for p in pieces]
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))
        while self.entries + len(lists) > len(self.first):
            self.first, self.count = np.concatenate([self.first, self.first]), np.concatenate([self.count, self.count])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        at = self.entries
        self.count[at : at + len(lists)] = sizes
        self.first[at : at + len(lists)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.entries, self.used = at + len(lists), self.used + len(flat)
        return at

    def _entries(self, whole: str, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The cache's entry of each slice."""
        if self.entries > CACHE_ENTRIES:
            self._clear()
        h = tc.slice_hashes(cps, starts, ends)
        h[h == 0] = 1
        where = (h >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        entry = self.slot[where].astype(np.int64)
        new = np.flatnonzero(self.keys[where] != h)
        if len(new):
            unique, which, back = np.unique(h[new], return_index=True, return_inverse=True)
            of = new[which]
            pieces = [whole[s:e].encode("utf-8", "surrogatepass") for s, e in zip(starts[of].tolist(), ends[of].tolist())]
            numbers = self._learn(pieces) + np.arange(len(unique))
            entry[new] = numbers[back]
            self.keys[where[of]], self.slot[where[of]] = unique, numbers
        return entry

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's ids end."""
        flat, ends, total = [], [], 0
        for a, b in tc.chunks(texts):
            ids, counts = self._chunk(texts[a:b])
            flat.append(ids)
            ends.append(total + np.cumsum(counts))
            total += len(ids)
        return (np.concatenate(flat), np.concatenate(ends)) if flat else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def count_of(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        return np.concatenate([self._chunk(texts[a:b], False)[1] for a, b in tc.chunks(texts)] or [np.zeros(0, np.int64)])

    def _slices(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(entries of the cache, starts, first slice of each text, places of the texts) of all slices, in code points."""
        whole, begins, ends = tc.joined(texts)
        cps = tc.codes(whole)
        cls = tc.class_table()[cps]
        cls[ends] = tc.BREAK
        at = boundaries(cps, cls)
        stop = np.append(at[1:], len(cps))
        real = cls[at] != tc.BREAK
        owner = np.searchsorted(at, ends) - np.arange(len(ends))  # slices up to the end of each text
        return self._entries(whole, cps, at[real], stop[real]), at[real], owner, begins

    def _chunk(self, texts: list[str], wanted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        entry, _, owner, _ = self._slices(texts)
        sizes = self.count[entry].astype(np.int64)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])[owner]
        counts = np.diff(upto, prepend=0)
        return self.ids[tc.ragged(self.first[entry], sizes)] if wanted else np.zeros(0, np.int32), counts

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each text's ids end; where each slice starts in its text and how many of its text's ids come before it, where each text's slices end)."""
        entry, starts, owner, begins = self._slices(texts)
        sizes = self.count[entry].astype(np.int64)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        of = np.repeat(np.arange(len(texts)), np.diff(owner, prepend=0))
        first = np.concatenate([np.zeros(1, np.int64), upto[owner]])[:-1]
        return self.ids[tc.ragged(self.first[entry], sizes)], upto[owner], (starts - begins[of]).astype(np.int32), (upto[:-1] - first[of]).astype(np.int32), owner

    def text(self, ids: list[int]) -> str:
        if not hasattr(self, "pieces"):
            self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def coder(raw: bytes) -> Coder:
    """One coder in each Python worker."""
    if _CODERS.get("raw") != raw:
        _CODERS.update(raw=raw, coder=Coder(raw))
    return _CODERS["coder"]


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every text, without a shuffle. Repeated ids stay as they are; null or empty text: []."""
    raw = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, texts = batch.column(0), _texts(batch.column(1))
            for a, b in tc.chunks(texts, 8 * tc.CHUNK_CHARS):
                ids, ends = coder(raw.value).encode(texts[a:b])
                offsets = np.concatenate([np.zeros(1, np.int32), ends.astype(np.int32)])
                yield pa.RecordBatch.from_arrays([key[a:b], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens BIGINT): only the lengths, 0 for null and empty texts."""
    raw = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder(raw.value).count_of(_texts(batch.column(1))), pa.int64())], ["_id", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, n_tokens bigint").withColumnRenamed("_id", id_col)


def encode_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, ids, slice_starts, slice_ids): with the ids where each slice starts in the text, in characters, and how many ids come before it. A part of a
    text is decoded by the ids of its slices alone, and a token is found in the text by its slice."""
    raw = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, texts = batch.column(0), _texts(batch.column(1))
            for a, b in tc.chunks(texts):
                ids, ends, starts, before, owner = coder(raw.value).spans(texts[a:b])
                lists = lambda upto, values: pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1), upto]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([key[a:b], lists(ends, ids), lists(owner, starts), lists(owner, before)], ["_id", "ids", "slice_starts", "slice_ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, ids array<int>, slice_starts array<int>, slice_ids array<int>").withColumnRenamed("_id", id_col)


def decode_column(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(id, text): the text of each list of ids; null or empty lists give an empty text. Bytes that are no UTF-8, at a cut inside a character, show as U+FFFD."""
    raw = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder(raw.value).text(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["_id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    return coder(vocabulary(path)).text(ids)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
