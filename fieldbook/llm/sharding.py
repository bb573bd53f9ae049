"""Sharding by jump consistent hashing.

A row's key and the number of shards alone decide its shard; with one shard more, a row stays or goes to the new
shard. There is no table of the ring, so nothing is broadcast or looked up. Null keys count as one key of their own
(the smallest 64-bit integer). Slots number the rows of a shard from 0 in key order; rows with equal keys are
ordered by their text. An empty table gives an empty result; other columns are carried along unless asked otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fieldbook.llm.common import cut_points, rank_within

NULL_KEY = -(1 << 63)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bucket of each unsigned 64-bit key, by the published jump consistent hash (Lamping and Veach, 2014)."""
    key = keys.astype(np.uint64).copy()
    bucket = np.full(len(key), -1, dtype=np.int64)
    nxt = np.zeros(len(key), dtype=np.int64)
    open_ = nxt < shards
    while open_.any():
        bucket = np.where(open_, nxt, bucket)
        key = np.where(open_, key * np.uint64(2862933555777941757) + np.uint64(1), key)
        step = (bucket + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1.0))
        nxt = np.where(open_, np.minimum(step, 2.0**62).astype(np.int64), nxt)
        open_ = nxt < shards
    return bucket


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a long key."""

    @pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return bucket(F.coalesce(key, F.lit(NULL_KEY)))


def assign(rows: DataFrame, key: str, shards: int, grown: int | None = None, rows_per_block: int = 50_000, then: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` and, if ``grown`` is given, ``grown_shard``."""
    cuts = cut_points(rows, key, rows_per_block)
    out = rows.withColumn("shard", shard_of(F.col(key), shards))
    if grown:
        out = out.withColumn("grown_shard", shard_of(F.col(key), grown))
    return rank_within(out, ["shard"], [key, *then], "slot", cuts)


def write_shards(rows: DataFrame, key: str, shards: int, path: str) -> None:
    """Write one folder for each shard, in parts that follow the data's size."""
    assign(rows, key, shards).write.partitionBy("shard").parquet(path)
