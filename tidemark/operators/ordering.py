"""Operators on ordered input. Every record carries `ord`; order is kept by it and not by partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 64


def first_of(df: DataFrame, *keys: str, ord_col: str = "ord") -> DataFrame:
    """The first row of each key in input order. Rows with equal order are told apart by nothing, one of them stays."""
    w = Window.partitionBy(*keys).orderBy(ord_col)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def capped(df: DataFrame, key: Column, cap: int, ord_col: str = "ord") -> DataFrame:
    """At most `cap` rows of each key, the first ones."""
    w = Window.partitionBy("_key").orderBy(ord_col)
    return df.withColumn("_key", key).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= cap).drop("_key", "_k")


def limited(df: DataFrame, n: int, ord_col: str = "ord") -> DataFrame:
    return df.orderBy(ord_col).limit(n)


def numbered(df: DataFrame, name: str = "n", ord_col: str = "ord") -> DataFrame:
    """The place of each row in input order, from 0. Ranks within BLOCKS ranges of about as many rows each, however `ord` is spread, and sums
    over their counts: no task sees all rows."""
    shares = F.array(*[F.lit(k / BLOCKS) for k in range(1, BLOCKS)])
    bounds = F.broadcast(df.agg(F.percentile_approx(ord_col, shares, 10 * BLOCKS).alias("_bounds")))  # one row
    blocks = df.join(bounds).withColumn("_b", F.size(F.filter(F.coalesce("_bounds", F.array().cast("array<bigint>")), lambda x: x < F.col(ord_col)))).drop("_bounds")
    counts = blocks.groupBy("_b").agg(F.count("*").alias("_c"))  # BLOCKS rows at most
    before = F.broadcast(counts.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_before")))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(ord_col)) - 1
    return blocks.withColumn("_w", within).join(before, "_b").withColumn(name, F.col("_before") + F.col("_w")).drop("_b", "_w", "_before")


def chunked(df: DataFrame, size: int, ord_col: str = "ord") -> DataFrame:
    """Adds part (from 1) and place (from 1) for parts of `size` rows; one part for a size of 0 or less."""
    rows = numbered(df, "_n", ord_col)
    part = F.floor(F.col("_n") / size) + 1 if size > 0 else F.lit(1)
    place = F.pmod(F.col("_n"), F.lit(size)) + 1 if size > 0 else F.col("_n") + 1
    return rows.withColumn("part", part.cast("int")).withColumn("place", place.cast("int")).drop("_n")
