"""Sharding by sampled splitters: size-weighted quantiles of the key bound the shards, overfull ranges are divided again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from jobloom.llm.common import cut, null_to_low, table

#: Bytes that a record takes beside its text.
OVERHEAD = 16


#: Bytes of texts that a range holds at most, about: its rows are numbered in one task.
RANGE_BYTES = 1 << 30
#: Rows drawn from a range that is divided.
DRAWS = 64


def _draw(rows: DataFrame, weight: Column, seed: int) -> list[tuple[int, int]]:
    """(key, tie) of rows drawn with probability size / weight: their expected number is the rows' bytes / weight."""
    u = F.shiftrightunsigned(F.xxhash64("tie", F.lit(seed)), 11) / F.lit(float(1 << 53))
    return sorted((r.key, r.tie) for r in rows.where(u * weight < F.col("size")).select("key", "tie").collect())


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """Which range a row's (key, tie) falls in: the number of splitters at or below it."""
    keys = np.array([k for k, _ in splitters], dtype=np.int64)
    ties = np.array([t for _, t in splitters], dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def of(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for i in np.flatnonzero(lo < hi):
            lo[i] += np.searchsorted(ties[lo[i] : hi[i]], t[i], "right")
        return pd.Series(lo.astype(np.int32))

    return of("key", "tie")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", ranges: int = 16, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row in one of `shards` runs of the key order with near-equal bytes.

    The key is the id, null first; rows of one id are told apart by their place in the input, so that an id with
    any share of the rows can be divided. Rows are drawn with probability by size; every fourth is a splitter, so that ranges
    hold a `ranges`-th of a shard, or `range_bytes` if that is less. The ranges are measured exactly, and overfull ones
    divided by a new draw among their rows. So are those in which a shard would end, until they hold one row: a shard ends at the
    splitter nearest to its part of all bytes, and shards differ by about one row's size. The driver holds the splitters,
    four for each range. Null and empty texts weigh OVERHEAD bytes. slot counts from 0 without gaps within
    each shard; repeated rows are told apart. A text of any length is one row, and only its size and checksum are kept; other columns are ignored.
    An empty table gives an empty result; with fewer rows than shards some are empty.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.col(f"`{id_col}`")
    rows = cut(docs.select(key.cast("long").alias("doc_id"), null_to_low(key).alias("key"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("tie")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    aim = max(min(total / (shards * ranges), range_bytes), 1.0)
    splitters, seed = _draw(rows, F.lit(aim / 4), 0)[3::4] if total else [], 0
    while True:
        ranged = rows.withColumn("range", _range_of(splitters))
        # A row for each range.
        sizes = sorted(tuple(r) for r in ranged.groupBy("range").agg(F.sum("size"), F.count("*")).collect())
        weights, at, k = {}, 0, 1
        for i, size, n in sizes:
            ends = False
            while k < shards and k * total < (at + size) * shards:
                ends, k = ends or k * total > at * shards, k + 1
            if n > 1 and (ends or size > 2 * aim):
                weights[i] = 0.0 if n <= DRAWS else size / DRAWS if ends else aim / 4
            at += size
        if not weights:
            break
        seed += 1
        # A row for each range that is divided.
        chosen = docs.sparkSession.createDataFrame(list(weights.items()), "range int, weight double")
        splitters = sorted({*splitters, *_draw(ranged.join(F.broadcast(chosen), "range"), F.col("weight"), seed)})
    offsets, at, own, rank = [], 0, 0, 0
    for i, size, n in sizes:
        # The shard of which the range's middle is a part.
        mine = min((2 * at + size) * shards // (2 * total), shards - 1)
        own, rank = (own, rank) if mine == own else (mine, 0)
        offsets.append((i, own, rank))
        at, rank = at + size, rank + n
    offsets = docs.sparkSession.createDataFrame(offsets, "range int, shard int, before long")
    place = F.row_number().over(Window.partitionBy("range").orderBy("key", "tie"))
    placed = ranged.withColumn("place", place).join(F.broadcast(offsets), "range")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
