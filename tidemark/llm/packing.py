"""Problem 8: filling fixed-capacity containers by planning over the histogram of lengths.

The plan is made over counts, not documents: lengths from the longest down are put, in groups, into the open kind of
container whose free space fits best; a kind that is used up only in part is split. The histogram has at most
`capacity` rows and the plan is bounded by the number of lengths, so both fit on the driver at any corpus size.
Documents then take the planned slots by their rank within their length. The rank is made in two levels (salt within
length, then row within salt), with as many salts as a length needs for sorts of about SORTED items, so that a length that a third of all
documents share is no single task. The plan is broadcast only if it has at most BROADCAST slots, and joined by length otherwise.

Items longer than the capacity fill whole containers of their own and leave a remainder that is packed like any other
item. Items without tokens take no space and are spread over the containers. Repeated ids are separate items.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.checkpoints import cut
from tidemark.llm.tokenizer import VOCABULARY, token_counts

SORTED, BROADCAST = 100_000, 200_000  # items of one length that are sorted together; slots of the plan that are sent to every executor


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Slots for `histogram[length]` items of each length of 1..capacity: (length, first rank, last rank, first container)
    rows, of which rank r takes container first + r - rank, and the number of containers.

    Best fit over counts: kinds of containers with the same free space are one stack of container ranges. A range that
    takes items of one length moves, as far as it is filled, to the stack of the space that is left.
    """
    stacks: dict[int, list[tuple[int, int]]] = defaultdict(list)
    open_spaces: set[int] = set()
    slots: list[tuple[int, int, int, int]] = []
    containers = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            space = min((s for s in open_spaces if s >= length), default=None)
            if space is None:
                each = capacity // length  # a new kind: as many of this length as one takes
                full, rest = divmod(left, each)
                for k in range(each) if full else ():
                    slots.append((length, rank + k * full, rank + (k + 1) * full - 1, containers))
                if full and capacity - each * length:
                    stacks[capacity - each * length].append((containers, full))
                    open_spaces.add(capacity - each * length)
                containers, rank = containers + full, rank + each * full
                for k in range(rest):
                    slots.append((length, rank + k, rank + k, containers))
                if rest:
                    stacks[capacity - rest * length].append((containers, 1))
                    open_spaces.add(capacity - rest * length)
                    containers += 1
                left = 0
                continue
            first, size = stacks[space].pop()
            if not stacks[space]:
                open_spaces.discard(space)
            take = min(size, left)
            slots.append((length, rank, rank + take - 1, first))
            if take < size:
                stacks[space].append((first + take, size - take))
                open_spaces.add(space)
            if space > length:
                stacks[space - length].append((first, take))
                open_spaces.add(space - length)
            rank, left = rank + take, left - take
    return slots, containers


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(id, piece_no, token_start, n_tokens, container_id BIGINT) of (id, size); one row for each item, of longer ones one
    for each piece. A null size counts as 0. An empty input gives no rows."""
    spark = sizes.sparkSession
    n = F.coalesce(F.col(size_col), F.lit(0)).cast("bigint")
    base = cut(sizes.select(F.col(id_col).alias("_id"), n.alias("_n")))
    cap = F.lit(capacity).cast("bigint")
    whole = F.greatest(F.ceil(F.col("_n") / cap), F.lit(1))
    pieces = base.select("_id", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), whole - 1), lambda k: F.struct(k.cast("int").alias("piece_no"), (k * cap).alias("token_start"), F.least(F.col("_n") - k * cap, cap).alias("_size")))).alias("p")).select("_id", "p.*")
    table = lambda data, names: spark.createDataFrame(pd.DataFrame(data, columns=names, dtype="int64"), ", ".join(f"{c} bigint" for c in names))
    histogram = {r["_size"]: r["count"] for r in pieces.groupBy("_size").count().collect()}  # at most capacity + 1 rows
    salts = F.broadcast(table([(size, -(-count // SORTED)) for size, count in histogram.items()], ["_size", "_salts"]))  # as many
    salted = pieces.join(salts, "_size").withColumn("_salt", F.pmod(F.xxhash64("_id", "piece_no"), "_salts")).drop("_salts")
    empty = histogram.pop(0, 0)
    slots, containers = plan(histogram, capacity)
    if empty:
        slots.append((0, 0, empty - 1, 0))  # items without tokens go round all containers
    before = F.sum("count").over(Window.partitionBy("_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = salted.groupBy("_size", "_salt").count().select("_size", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    planned = table(slots, ["_size", "_first", "_last", "_container"])
    if len(slots) <= BROADCAST:
        planned = F.broadcast(planned)
    within = F.row_number().over(Window.partitionBy("_size", "_salt").orderBy("_id", "piece_no"))
    ranked = salted.withColumn("_row", within.cast("bigint")).join(offsets, ["_size", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    placed = ranked.join(planned, (ranked["_size"] == planned["_size"]) & F.col("_rank").between(F.col("_first"), F.col("_last"))).drop(planned["_size"])
    container = F.when(F.col("_size") == 0, F.pmod("_rank", F.lit(max(containers, 1)).cast("bigint"))).otherwise(F.col("_container") + F.col("_rank") - F.col("_first"))
    return placed.select(F.col("_id").alias(id_col), "piece_no", "token_start", F.col("_size").alias("n_tokens"), container.alias("container_id"))


def limits(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    """(max_tokens, overlap_tokens) of the fixed table size_limits."""
    row = spark.read.parquet(f"{sf_dir}/size_limits.parquet").filter(F.col("limit_name") == name).first()
    return row["max_tokens"], row["overlap_tokens"]


def p8_pack(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(token_counts(documents, path=path), limits(spark, sf_dir, "container")[0])


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: their number, the least possible number and the share of space used."""
    capacity = limits(spark, sf_dir, "container")[0]
    used = p8_pack(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"))
    total = used.agg(F.count_if(F.col("tokens") > 0).alias("containers"), F.sum("tokens").alias("tokens"))
    return total.select("containers", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.round(F.try_divide(F.col("tokens"), F.col("containers") * capacity), 6).alias("fill"))
