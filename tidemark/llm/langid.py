"""Problem 2: the language of each document and of each paragraph, by rank-order profiles.

A profile lists the most frequent n-grams (one to three letters) of a language by rank. A paragraph's own ranking is
compared to each profile by the out-of-place distance: the sum of the differences of ranks, an n-gram that the profile
lacks counting as MOST. The least distance names the language; the confidence is 1 - least / second, which is
0 where two languages fit alike. A paragraph (often a heading with a name) that fits another language than its item's by
less than FOREIGN_MARGIN is taken for the item's.

Profiles are fitted on a bounded sample of labelled rows (TRAIN_ROWS, those with the least hashes of their ids). Labels may
be wrong: after each round the rows whose text fits another profile better are left out and the profiles fitted again.

Paragraphs are the pieces between blank lines ("\\n\\n"). Those with fewer than MIN_LETTERS letters have no language; null and
blank texts give no rows. The main language is that of more than half of the paragraphs; where there is none, an
item has rows for its paragraphs only.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textcodes as tc
from tidemark.llm.sampling import bounded_sample

TRAIN_ROWS, ROUNDS = 6000, 3
PROFILE, MOST, MIN_LETTERS = 1200, 1200, 20
FOREIGN_MARGIN = 0.18
SLOT_BITS, ROW_BITS, COUNT_BITS = 16, 17, 27

# fixed values: three-letter codes (both forms of ISO 639-2), English names and stand-ins of labels
THREE_LETTERS = {
    "eng": "en", "jpn": "ja", "zho": "zh", "chi": "zh", "cmn": "zh", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "kor": "ko", "rus": "ru",
    "ita": "it", "nld": "nl", "dut": "nl", "pol": "pl", "tur": "tr", "ara": "ar", "swe": "sv", "ukr": "uk", "vie": "vi", "tha": "th", "hin": "hi", "ind": "id",
}
STAND_INS = ("", "?", "-", "--", "n/a", "na", "none", "null", "nil", "nan", "und", "unk", "unknown", "undefined", "undetermined", "other", "others", "misc", "mis", "mul", "multi", "zxx", "xx", "x", "auto", "tbd", "not known")


def label_code(label: Column, names: dict[str, str]) -> Column:
    """The two-letter code that a label spells, null for null, blank and stand-ins. names: English name in lower case -> code."""
    plain = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), "^[\\s\\u00a0\\u3000]+|[\\s\\u00a0\\u3000]+$", ""))
    base = F.regexp_extract(plain, "^([^_\\-(;,\\s]*)", 1)
    pairs = F.create_map(*[F.lit(x) for kv in (THREE_LETTERS | names).items() for x in kv])
    return F.when(plain.isin(*STAND_INS) | base.isin(*STAND_INS), None).otherwise(F.coalesce(pairs[plain], pairs[base], base))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number << 40 | 40-bit hash of an n-gram) of every n-gram of all texts, sorted, distinct; how often each occurs; letters of each text."""
    lowered = [t.lower() for t in texts]
    whole, _, ends = tc.joined(lowered)
    cps = tc.codes(whole)
    letter = tc.class_table()[cps] == tc.LETTER
    letters = np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(letter)])[ends + 1], prepend=0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    at = np.flatnonzero(keep)
    c = np.where(letter[at], cps[at], 32).astype(np.uint64)
    owner = np.searchsorted(ends, at).astype(np.uint64)
    # a word is seen with a blank before and after it: the blank that ends the word before stands for both
    keys = []
    for n in (1, 2, 3):
        if len(c) < n:
            continue
        g = c[: len(c) - n + 1].copy()
        inside = np.ones(len(g), bool)
        for k in range(1, n):
            g |= c[k : len(g) + k] << np.uint64(21 * k)
        inside &= owner[: len(g)] == owner[n - 1 :]
        inside &= (c[: len(g)] != 32) if n == 1 else True
        keys.append((owner[: len(g)][inside] << np.uint64(40)) | (tc.mix(g[inside] + np.uint64(n)) >> np.uint64(24)))
    keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    keys.sort()
    if not len(keys):
        return keys, np.zeros(0, np.int64), letters
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys))), letters


class Profiles:
    """langs; for each known n-gram its rank in each language's profile. An n-gram whose slot is taken goes to the next table, by other bits of its hash."""

    def __init__(self, langs: list[str], hashes: np.ndarray, ranks: np.ndarray):
        self.langs, self.ranks = langs, np.vstack([np.full((1, len(langs)), MOST, np.int32), ranks.astype(np.int32)])
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        left, rows = hashes, np.arange(1, len(hashes) + 1)
        while len(left):
            keys, row = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
            slot, first = np.unique(self._slots(left, len(self.tables)), return_index=True)
            keys[slot], row[slot] = left[first], rows[first]
            self.tables.append((keys, row))
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, rows = left[rest], rows[rest]

    @staticmethod
    def _slots(h: np.ndarray, number: int) -> np.ndarray:
        return ((tc.mix(h + np.uint64(number)) if number else h) >> np.uint64(40 - SLOT_BITS)).astype(np.int64) & ((1 << SLOT_BITS) - 1)

    def row_of(self, h: np.ndarray) -> np.ndarray:
        """Row in ranks of each n-gram, 0 for those that no profile knows."""
        found = np.zeros(len(h), np.int64)
        for number, (keys, row) in enumerate(self.tables):
            slot = self._slots(h, number)
            found = np.where(keys[slot] == h, row[slot], found)
        return found

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Out-of-place distance of each text to each language; letters of each text."""
        keys, counts, letters = _grams(texts)
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        if len(keys):
            owner, h = keys >> np.uint64(40), keys & np.uint64((1 << 40) - 1)
            row = self.row_of(h)
            # by text, then falling count; known n-grams before unknown ones of the same count
            last = (1 << ROW_BITS) - 1
            order = (owner << np.uint64(ROW_BITS + COUNT_BITS)) | ((np.uint64((1 << COUNT_BITS) - 1) - counts.astype(np.uint64)) << np.uint64(ROW_BITS)) | np.where(row > 0, row, last).astype(np.uint64)
            order.sort()
            owner = (order >> np.uint64(ROW_BITS + COUNT_BITS)).astype(np.int64)
            starts = np.searchsorted(owner, np.arange(len(texts)))
            rank = np.arange(len(order)) - starts[owner]
            row = (order & np.uint64(last)).astype(np.int64)
            known = (row < last) & (rank < MOST)
            row, rank, owner = row[known], rank[known], owner[known]
            away = np.abs(self.ranks[row] - rank[:, None].astype(np.int32))
            away[self.ranks[row] >= MOST] = MOST
            full, first = np.unique(owner, return_index=True)
            if len(full):
                total[full] = np.add.reduceat(np.minimum(away, MOST), first, axis=0, dtype=np.int64)
            # an n-gram that no profile knows is as far from each language
            sizes = np.minimum(np.diff(np.append(starts, len(order))), MOST)
            total += ((sizes - np.bincount(owner, minlength=len(texts))) * MOST)[:, None]
        return total, letters

    def confidence(self, total: np.ndarray) -> np.ndarray:
        two = np.sort(total, axis=1)[:, :2] if len(self.langs) > 1 else np.hstack([total, total + 1])
        return 1 - two[:, 0] / np.maximum(two[:, 1], 1)


def fit(texts: list[str], labels: list[str]) -> Profiles:
    """Profiles of the labels' languages."""
    langs = sorted(set(labels))
    by_lang = [Counter() for _ in langs]
    number = {x: k for k, x in enumerate(langs)}
    for a, b in tc.chunks(texts):
        keys, counts, _ = _grams(texts[a:b])
        of = np.array([number[x] for x in labels[a:b]], np.int64)[(keys >> np.uint64(40)).astype(np.int64)]
        h = keys & np.uint64((1 << 40) - 1)
        for k in range(len(langs)):
            unique, back = np.unique(h[of == k], return_inverse=True)
            by_lang[k].update(dict(zip(unique.tolist(), np.bincount(back, counts[of == k]).astype(int).tolist())))
    rank_of: dict[int, dict[int, int]] = defaultdict(dict)
    for k, counter in enumerate(by_lang):
        for r, (h, _) in enumerate(sorted(counter.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]):
            rank_of[h][k] = r
    chosen = sorted(rank_of, key=lambda h: (min(rank_of[h].values()), h))
    ranks = np.array([[rank_of[h].get(k, MOST) for k in range(len(langs))] for h in chosen], np.int32).reshape(len(chosen), len(langs))
    return Profiles(langs, np.array(chosen, np.uint64), ranks)


def fit_noisy(texts: list[str], labels: list[str], rounds: int = ROUNDS) -> Profiles:
    """Fits on paragraphs with their text's label; each later round leaves out those that fit another profile better."""
    parts = [(p, x) for t, x in zip(texts, labels) for p in t.split("\n\n") if p.strip()]
    pieces, marks = [p for p, _ in parts], [x for _, x in parts]
    profiles = fit(pieces, marks)
    for _ in range(rounds - 1):
        best = np.concatenate([profiles.distances(pieces[a:b])[0].argmin(axis=1) for a, b in tc.chunks(pieces)])
        kept = [k for k, b in enumerate(best) if profiles.langs[b] == marks[k]]
        profiles = fit([pieces[k] for k in kept], [marks[k] for k in kept])
    return profiles


def train(df: DataFrame, codes: list[str], names: dict[str, str], id_col: str, text_col: str, label_col: str, most: int = TRAIN_ROWS) -> Profiles | None:
    """Profiles of the codes' languages; None without a labelled row."""
    code = label_code(F.col(label_col), names)
    rows = df.select(F.col(text_col).alias("t"), code.alias("c"), F.col(id_col).alias("i")).filter(F.col("c").isin(*codes) & (F.length("t") >= MIN_LETTERS))
    sample = bounded_sample(rows, F.col("i"), most)
    if sample.empty:
        return None
    return fit_noisy(sample["t"].tolist(), sample["c"].tolist())


def _identify(profiles) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Profiles = profiles.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in tc.chunks(texts):
                parts, item, number = [], [], []
                for k, t in enumerate(texts[a:b]):
                    for n, part in enumerate(t.split("\n\n")):
                        parts.append(part)
                        item.append(k)
                        number.append(n)
                total, letters = p.distances(parts)
                counted = letters >= MIN_LETTERS
                item, number, total = np.array(item)[counted], np.array(number)[counted], total[counted]
                lang, sure = total.argmin(axis=1), p.confidence(total)
                votes = np.zeros((b - a, len(p.langs)))
                np.add.at(votes, (item, lang), 1)
                weight = np.zeros((b - a, len(p.langs)))
                np.add.at(weight, (item, lang), sure)
                n = votes.sum(axis=1)
                main = np.where(2 * votes.max(axis=1) > n, votes.argmax(axis=1), -1)
                near = 1 - total.min(axis=1) / np.maximum(total[np.arange(len(item)), main[item]], 1)
                lang = np.where((main[item] >= 0) & (near < FOREIGN_MARGIN), main[item], lang)
                has = np.flatnonzero(main >= 0)
                ids = np.concatenate([has, item])
                segments = np.concatenate([np.full(len(has), -1), number])
                langs = np.concatenate([main[has], lang])
                certain = np.concatenate([weight[has, main[has]] / n[has], sure])
                name = pa.array(p.langs, pa.string())
                mains = pa.array(main[ids], mask=main[ids] < 0, type=pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(ids)), batch.column(2)[a:b].take(pa.array(ids)), pa.array(segments.astype(np.int32)), name.take(pa.array(langs)), pa.array(np.round(certain, 6)), name.take(mains)], ["_id", "_label", "seg_no", "lang", "confidence", "main"])

    return run


def identify(df: DataFrame, languages: DataFrame, id_col: str = "item_id", text_col: str = "text", label_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, seg_no, lang, confidence, main, label): for each item with a main language a row with seg_no -1, and a row for each
    counted paragraph; no rows where no row is labelled. `label` is the code that the given label spells, null for none. languages: (code, english_name), a small fixed table."""
    table = languages.select("code", "english_name").collect()
    codes, names = [r["code"] for r in table], {(r["english_name"] or r["code"]).lower(): r["code"] for r in table}
    fitted = train(df, codes, names, id_col, text_col, label_col, train_rows)
    profiles = df.sparkSession.sparkContext.broadcast(fitted)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), label_code(F.col(label_col), names).alias("_label"))
    rows = rows.filter(F.lit(fitted is not None))
    found = rows.mapInArrow(_identify(profiles), f"_id {kind}, _label string, seg_no int, lang string, confidence double, main string")
    return found.select(F.col("_id").alias(id_col), "seg_no", "lang", "confidence", "main", F.col("_label").alias("label"))


def wrong_or_foreign(identified: DataFrame, id_col: str = "item_id") -> DataFrame:
    """(id, seg_no, lang, confidence): items whose label is missing or names another language, and foreign paragraphs."""
    mislabelled = (F.col("seg_no") == -1) & (F.col("label").isNull() | (F.col("label") != F.col("lang")))
    foreign = (F.col("seg_no") >= 0) & (F.col("lang") != F.col("main"))
    return identified.filter(mislabelled | foreign).select(id_col, "seg_no", "lang", "confidence")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lang_items.parquet").select("item_id", "text", "lang")
    return identify(items, spark.read.parquet(f"{sf_dir}/lang_codes.parquet"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_or_foreign(_items(spark, sf_dir)).select("item_id", "seg_no", "lang")


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("item_id", "seg_no", "lang", "confidence")
