"""Problem 9: cutting oversized texts at natural boundaries.

Balanced targets: the least number of pieces that the limit and the overlap allow, targets of equal length, each moved
to the strongest boundary within reach (the nearest of equals); where the limit leaves a cut none, the rest of the text gets
one piece more. Consecutive pieces share exactly `overlap` tokens: a piece starts so many tokens before the last cut.

Boundaries, from strong to weak: blank line, line end, sentence end, clause end, white space, script or sign change;
a text without any of these within reach is cut between tokens, at the end of a character where one ends within reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textcodes as tc
from tidemark.llm.packing import limits
from tidemark.llm.tokenizer import VOCABULARY, coder, vocabulary

SENTENCE, CLAUSE, CLOSING = ".!?…。！？．｡", ",;:，；：、､､—–", "\"'”’»）)]」』】›"
FIELDS = "piece_no int, token_start int, n_tokens int, char_start int, char_end int, boundary string, piece string"
WEAKEST, INSIDE = 4, 8  # the weakest boundary that counts as natural; a place inside a character
NAMES = ("end of text", "blank line", "line", "sentence", "clause", "white space", "word", "character", "token")


def strengths(cps: np.ndarray) -> np.ndarray:
    """For each place between characters (place k is before character k) the rank in NAMES of its boundary."""
    n = len(cps)
    cls = tc.class_table()[cps]
    rank = np.full(n + 1, 7, np.uint8)
    inner = rank[1:n]
    kind = tc.ideograph_table()[cps]
    inner[(cls[:-1] != cls[1:]) | (kind[:-1] != kind[1:])] = 6
    inner[(cls[:-1] == tc.SPACE) & (cls[1:] != tc.SPACE)] = 5  # a cut leaves white space with the piece that ends
    inner[(cls[1:] == tc.SPACE) & (cls[:-1] != tc.SPACE)] = 5
    is_in = lambda chars: np.isin(cps, [ord(c) for c in chars])
    closing = is_in(CLOSING)
    for rank_no, signs in ((4, CLAUSE), (3, SENTENCE)):
        mark = is_in(signs)
        for _ in range(2):  # closing quotes and brackets belong to what they close
            mark[1:] |= mark[:-1] & closing[1:]
        wide = mark & (cps >= 0x2E80)
        blank = np.zeros(n, bool)
        blank[1:] = mark[:-1] & (cls[1:] == tc.SPACE)
        inner[(wide | blank)[:-1] & ~(closing[1:] & mark[1:])] = rank_no
        inner[mark[:-1] & (cls[1:] == tc.SPACE)] = rank_no
    ending = is_in("\n\r\u2028\u2029")
    at = np.flatnonzero(ending[:-1] & ~ending[1:])  # the last of a run of line ends
    inner[at] = 2
    earlier = at - 1 - ((cps[at] == 10) & (at > 0) & (cps[np.maximum(at - 1, 0)] == 13))
    inner[at[(earlier >= 0) & ending[np.maximum(earlier, 0)]]] = 1
    rank[0] = rank[n] = 0
    return rank


def cuts(n: int, rank: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces in tokens. rank[k]: how strong the boundary before token k is (low is strong), 8 if inside a character.

    A cut fails where the limit leaves it no natural boundary although one is near its target, or no end of a character. It is then placed
    earlier, at the strongest boundary of the second half of its piece, the rest gets one piece more and new balanced targets; up to half as many
    pieces again. Each place is looked at a bounded number of times, so that long texts cost in proportion.
    """
    step, at, ends = limit - overlap, 0, []
    left = max(1, -(-(n - overlap) // step))
    spare = left // 2 + 1
    while left > 1:
        target, reach = at + round((n - at) / left), max(1, (n - at) // left // 4)
        high = min(max(0, at - overlap) + limit, n - 1, target + reach)
        low = min(max(at + 1, n - (left - 1) * step, target - reach), high)
        window = rank[low : high + 1]
        near = rank[max(target - reach, at + 1) : target + reach + 1].min()
        if spare and window.min() > max(WEAKEST, near) and (near <= WEAKEST or window.min() == INSIDE):
            earlier = rank[max(at + 1, at + step // 2) : high + 1]
            if len(earlier) and earlier.min() < window.min():
                low, window, left, spare = max(at + 1, at + step // 2), earlier, left + 1, spare - 1
                target = min(target, high)
        best = np.flatnonzero(window == window.min()) + low
        at = int(best[np.argmin(np.abs(best - target))])
        ends.append(at)
        left -= 1
    return [*ends, n]


def _pieces(text: str, ids: np.ndarray, lengths: np.ndarray, limit: int, overlap: int) -> list[tuple]:
    cps = tc.codes(text)
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    char_at = np.concatenate([np.zeros(1, np.int64), np.cumsum(width)])
    token_at = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths[ids])])
    place = np.searchsorted(char_at, token_at)
    whole = char_at[place] == token_at
    rank = np.where(whole, strengths(cps)[place], 8).astype(np.uint8)
    # white space opens the next token in this vocabulary: such an end counts as the boundary that follows the blank
    after = np.minimum(place + 1, len(cps))
    opens = whole & (place < len(cps)) & (cps[np.minimum(place, len(cps) - 1)] == 32)
    rank = np.where(opens, np.minimum(rank, strengths(cps)[after]), rank)
    rank[0] = rank[-1] = 0
    rows, start = [], 0
    for k, end in enumerate(cuts(len(ids), rank, limit, overlap)):
        first = max(0, start - overlap) if k else 0
        c0 = int(place[first] if whole[first] else place[first] - 1)
        c1 = int(place[end])
        rows.append((k, first, end - first, c0, c1, NAMES[int(rank[end])], text[c0:c1]))
        start = end
    return rows


def split(df: DataFrame, limit: int, overlap: int, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, piece_no, token_start, n_tokens, char_start, char_end, boundary, piece) of each text of more than `limit` tokens.

    `boundary` names the place where the piece ends. A piece that starts inside a character shows the whole character.
    Null, empty and short texts give no rows; repeated ids are cut separately. No shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    raw = df.sparkSession.sparkContext.broadcast(vocabulary(path))
    names = ["_id", *(f.split()[0] for f in FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = coder(raw.value)
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            # a token holds a byte at least: a text of at most `limit` bytes needs no encoding
            long = [k for k, t in enumerate(texts) if t and 4 * len(t) > limit]
            for a, b in tc.chunks([texts[k] for k in long], 4 * tc.CHUNK_CHARS):
                part = long[a:b]
                ids, ends = c.encode([texts[k] for k in part])
                out, at = [], 0
                for k, end in zip(part, ends.tolist()):
                    if end - at > limit:
                        out += [(keys[k], *row) for row in _pieces(texts[k], ids[at:end], c.lengths, limit, overlap)]
                    at = end
                if out:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names), schema=schema, preserve_index=False)

    kind = df.schema[id_col].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(f"_id {kind}, {FIELDS}"))
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, {FIELDS}").withColumnRenamed("_id", id_col)


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit, overlap = limits(spark, sf_dir, "piece")
    return split(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), limit, overlap)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_pieces(spark, sf_dir).filter(F.col("piece_no") == 0).select("doc_id")
