"""Problem 1: near-duplicate records, by sequential Bayesian verification of banded signatures.

1. One pass over the texts gives each a MinHash signature (one byte per row) of its word shingles. Records with the same
   set of shingles are one class from here on; the least id stands for it.
2. Bands of signature rows are buckets. Large buckets are cut into blocks by a hash of the id, and pairs are made per pair of blocks,
   each by a task of bounded size: a bucket with a third of all records is many small tasks, and no pair is lost. Which buckets are
   large is estimated from a 64th of the ids; the estimate decides how finely a bucket is cut, never what is compared.
3. Candidates are compared batch by batch of signature rows. After each batch the posterior probability that the
   similarity reaches the threshold follows from the matches so far; a pair goes as soon as it falls below the chosen
   miss probability.
4. Survivors are verified on the shingle sets themselves.

A word is a run of letters and digits of the lower-cased text, and each Han or kana character a word of its own. Texts
that are null, blank, have fewer letters and digits than `min_letters` or fewer words than a shingle have no partner.
Repeated ids count as one record.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textcodes as tc
from tidemark.llm.checkpoints import cut, release

ROWS, BAND_ROWS, BANDS, BATCH_ROWS = 192, 5, 96, 32
BLOCK, PROBE = 256, 64  # ids of a block; one id of so many is counted to find large buckets
MISS = 0.001


def shingles(texts: list[str], words: int, min_letters: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 32-bit shingle hashes of all texts, one text after the other, and how many each has."""
    lowered = [t.lower() for t in texts]
    whole, _, ends = tc.joined(lowered)
    cps = tc.codes(whole)
    cls, alone = tc.class_table()[cps], tc.ideograph_table()[cps]
    inside = (cls == tc.LETTER) | (cls == tc.DIGIT)
    inside[ends] = False
    before = np.concatenate([np.zeros(1, bool), inside[:-1] & ~alone[:-1]])
    first = inside & (alone | ~before)
    starts = np.flatnonzero(first)
    after = np.concatenate([~inside[1:] | first[1:], np.ones(1, bool)])
    stops = np.flatnonzero(inside & after) + 1
    owner = np.searchsorted(ends, starts)
    if min_letters:
        letters = np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(inside)])[ends], prepend=0)
        keep = letters[owner] >= min_letters
        starts, stops, owner = starts[keep], stops[keep], owner[keep]
    if len(starts) < words:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    h = tc.slice_hashes(cps, starts, stops)
    n = len(h) - words + 1
    run = np.zeros(n, np.uint64)
    for k in range(words):
        run = run * np.uint64(0x9FB21C651E98DF25) + h[k : k + n]
    run = tc.mix(run)[owner[:n] == owner[words - 1 :]]
    of = owner[:n][owner[:n] == owner[words - 1 :]]
    # text number above, 40 bits of the hash below: one sort makes all sets
    keys = np.unique((of.astype(np.uint64) << np.uint64(40)) | (run >> np.uint64(24)))
    return (keys >> np.uint64(8)).astype(np.uint32), np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=len(texts))


def signatures(hashes: np.ndarray, counts: np.ndarray, rows: int = ROWS, seed: int = 1) -> np.ndarray:
    """A byte per row and text: the low bits of the mixed MinHash value. Texts without shingles have zeros."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 31, rows, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, rows, dtype=np.int64).astype(np.uint32)
    out = np.zeros((len(counts), rows), np.uint8)
    full = np.flatnonzero(counts)
    if len(full):
        offsets = (np.cumsum(counts) - counts)[full]
        work = np.empty_like(hashes)
        for k in range(rows):
            np.multiply(hashes, factors[k], out=work)
            np.add(work, shifts[k], out=work)
            least = np.minimum.reduceat(work, offsets)
            least ^= least >> np.uint32(15)
            out[full, k] = (least * np.uint32(0x2C1B3C6D)) >> np.uint32(24)
    return out


def bands(sig: np.ndarray, seed: int = 2) -> np.ndarray:
    """A key for each text and band, of BAND_ROWS rows drawn for the band."""
    rng = np.random.default_rng(seed)
    keys = np.empty((len(sig), BANDS), np.int64)
    for b in range(BANDS):
        key = np.full(len(sig), b, np.int64)
        for r in rng.choice(sig.shape[1], BAND_ROWS, replace=False):
            key = (key << 8) | sig[:, r]
        keys[:, b] = key
    return keys


def least_matches(threshold: float, miss: float = MISS, rows: int = ROWS, batch: int = BATCH_ROWS) -> list[tuple[int, int]]:
    """(rows compared, matches needed) after each batch: fewer matches mean P(similarity >= threshold) < miss.

    With a uniform prior on the similarity, the posterior after m matches of n is Beta(m + 1, n - m + 1), whose tail is
    a sum of binomials. A row of two different minima matches by chance 1 time of 256.
    """
    chance = threshold + (1 - threshold) / 256
    needed = []
    for n in range(batch, rows + 1, batch):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * chance**m * (1 - chance) ** (n + 1 - m)
        needed.append((n, m))
    return needed


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _sign(words: int, min_letters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in tc.chunks(texts):
                hashes, counts = shingles(texts[a:b], words, min_letters)
                full = np.flatnonzero(counts)
                if not len(full):
                    continue
                sig = signatures(hashes, counts)[full]
                offsets = (np.cumsum(counts) - counts)[full]
                whole = np.add.reduceat(tc.mix(hashes.astype(np.uint64)), offsets) ^ counts[full].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(full)), pa.array(whole.view(np.int64)), pa.array(counts[full].astype(np.int32)), pa.array([r.tobytes() for r in sig], pa.binary())], ["id", "same", "size", "sig"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 8192):
            part = batch.slice(a, 8192)
            keys = bands(_matrix(part.column(1), ROWS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))], ["bucket", "id"])


def _compare(needed: list[tuple[int, int]], done: int):
    """Compares signature rows from `done` on, up to the last of `needed`; column m has the matches so far. A pair goes as soon as it has too few."""
    width = needed[-1][0] - done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column(3), width), _matrix(batch.column(4), width)
            left, matches, at = np.arange(batch.num_rows), batch.column(2).to_numpy().astype(np.int64), 0
            for n, least in needed:
                matches = matches + (x[left, at : n - done] == y[left, at : n - done]).sum(axis=1)
                keep = matches >= least
                left, matches, at = left[keep], matches[keep], n - done
            chosen = pa.array(left)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(matches.astype(np.int32))], ["a", "b", "m"])

    return run


def _sets(words: int, min_letters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in tc.chunks(texts):
                hashes, counts = shingles(texts[a:b], words, min_letters)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([hashes[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist())], pa.binary())], ["id", "grams"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = np.zeros(batch.num_rows)
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                sims[k] = common / (len(both) - common)
            keep = pa.array(np.flatnonzero(sims >= threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(sims).take(keep)], ["a", "b", "similarity"])

    return run


def _pairs(keyed: DataFrame) -> DataFrame:
    """(a, b), a < b, of ids in the same bucket, by pairs of blocks of about BLOCK ids each; once for each bucket they share."""
    probed = keyed.filter(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(PROBE)) == 0).groupBy("bucket").agg((F.count("*") * PROBE).alias("n"))
    large = cut(probed.filter(F.col("n") >= 4 * BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    shared = keyed.join(large, "bucket", "left").select("bucket", "id", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))
    placed = shared.select("bucket", "id", mine.alias("mine"), F.explode(cells).alias("c")).select("bucket", "c.i", "c.j", "id", "mine")
    # repartition by the whole cell: else the cells of a hot bucket would stay together
    groups = placed.repartition("bucket", "i", "j").groupBy("bucket", "i", "j").agg(F.collect_list(F.when(F.col("mine") == F.col("i"), F.col("id"))).alias("x"), F.collect_list(F.when(F.col("mine") == F.col("j"), F.col("id"))).alias("y"))
    pairs = groups.filter((F.col("i") != F.col("j")) | (F.size("x") > 1)).select(F.explode("x").alias("p"), "y", (F.col("i") == F.col("j")).alias("own")).select("p", F.explode("y").alias("q"), "own")
    return pairs.filter((F.col("p") < F.col("q")) | (~F.col("own") & (F.col("p") > F.col("q")))).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def similar(df: DataFrame, threshold: float, words: int = 5, id_col: str = "id", text_col: str = "text", min_letters: int = 0, miss: float = MISS) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): (a, b, similarity) between class representatives, and (id, rep) of every text that has shingles."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    kind = df.schema[id_col].dataType.simpleString()
    signed = cut(source.mapInArrow(_sign(words, min_letters), f"id {kind}, same bigint, size int, sig binary"))
    reps = cut(signed.groupBy("same", "size").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")))
    slim = cut(signed.select("id", "same", "size"))
    release(signed)  # from here on only representatives need their signatures
    members = slim.join(reps.select("rep", "same", "size"), ["same", "size"]).select("id", "rep").distinct()
    keyed = reps.select(F.col("rep").alias("id"), "sig").mapInArrow(_spread, f"bucket bigint, id {kind}")
    candidates = _pairs(keyed).distinct()
    needed = least_matches(threshold, miss)

    def compared(pairs: DataFrame, first: int, steps: list[tuple[int, int]]) -> DataFrame:
        part = reps.select("rep", F.substring("sig", first + 1, steps[-1][0] - first).alias("sig"))
        both = pairs.join(part.toDF("a", "sig_a"), "a").join(part.toDF("b", "sig_b"), "b").select("a", "b", "m", "sig_a", "sig_b")
        return both.mapInArrow(_compare(steps, first), f"a {kind}, b {kind}, m int")

    # most candidates go after the first batch: only that much of the signatures goes along with all of them
    survivors = cut(compared(compared(candidates.withColumn("m", F.lit(0)), 0, needed[:1]), needed[0][0], needed[1:]).select("a", "b"))
    wanted = survivors.select(F.col("a").alias("id")).union(survivors.select("b")).distinct()
    grams = source.join(wanted, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(words, min_letters), f"id {kind}, grams binary")
    full = survivors.join(grams.toDF("a", "grams_a"), "a").join(grams.toDF("b", "grams_b"), "b").select("a", "b", "grams_a", "grams_b")
    return full.mapInArrow(_verify(threshold), f"a {kind}, b {kind}, similarity double"), members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of all records, copies included. Copies of one text are paired by blocks, as buckets are."""
    linked = pairs.join(members.toDF("x", "a"), "a").join(members.toDF("y", "b"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return linked.union(_pairs(members.select(F.col("rep").alias("bucket"), "id")))


def classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, links BIGINT): the connected class of every member, named by its least id, and the number of texts, other
    than its own, that its text is linked to. Labels fall to the least neighbour's and jump to their label's label; the tables of a
    round go when the next is written."""
    links = cut(pairs.select("a", "b").union(pairs.select("b", "a")))
    label = cut(links.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("c"), F.lit(True).alias("fell")))
    while True:
        near = links.join(label.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").groupBy("a").agg(F.min("cb").alias("m"))
        step = cut(label.join(near.withColumnRenamed("a", "id"), "id").select("id", "c", F.least("c", "m").alias("m")))
        after = cut(step.join(step.select(F.col("id").alias("m"), F.col("m").alias("mm")), "m").select("id", F.least("m", "mm").alias("c"), (F.least("m", "mm") < F.col("c")).alias("fell")))
        release(label, step)
        label = after
        if after.filter("fell").isEmpty():
            break
    degree = links.groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "rep")
    joined = members.join(label.select(F.col("id").alias("rep"), "c"), "rep", "left").join(degree, "rep", "left")
    return joined.select("id", F.coalesce("c", "rep").alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def with_rest(classed: DataFrame, df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, class_id, links) of every id of df: those that `classed` lacks have no links, and are one class where their texts are
    equal; without text each is its own."""
    every = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    rest = every.join(classed.select("id"), "id", "left_anti").select("id", F.when(F.trim("text") != "", F.sha2("text", 256)).alias("same"))
    rest = cut(rest.groupBy("id").agg(F.min("same").alias("same")))
    least = rest.filter("same is not null").groupBy("same").agg(F.min("id").alias("c"))
    alone = rest.join(least, "same", "left").select("id", F.coalesce("c", "id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    return classed.union(alone)


def _similar_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = spark.read.parquet(f"{sf_dir}/scrape_meta.parquet").select("scrape_id", "body")
    return similar(pages, threshold=0.5, words=4, id_col="scrape_id", text_col="body", min_letters=300)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand(*_similar_pages(spark, sf_dir)).select(F.col("a").alias("scrape_id_a"), F.col("b").alias("scrape_id_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/scrape_meta.parquet").select("scrape_id", "body")
    return with_rest(cut(classes(*_similar_pages(spark, sf_dir))), pages, "scrape_id", "body").withColumnRenamed("id", "scrape_id")
