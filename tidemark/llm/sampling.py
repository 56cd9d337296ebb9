"""Bounded samples to fit models on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, key: Column, most: int) -> pd.DataFrame:
    """At most `most` rows, those with the least hashes of `key`. A share of the hashes that holds about twice as many rows is
    taken first, so that no partition sends more than its part of them to the driver."""
    n = rows.count()
    hashed = rows.withColumn("_hash", F.xxhash64(key))
    if n > 2 * most:
        hashed = hashed.filter(F.shiftrightunsigned("_hash", 11).cast("double") < 2.0**53 * (2 * most / n))
    return hashed.orderBy("_hash").limit(most).drop("_hash").toPandas()
