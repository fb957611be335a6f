"""Windows over event time with a watermark: sliding ones and sessions, in append mode, and runs of a stream to its end."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.sources.store import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def streaming_conf(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings `spark.sql.streaming.*` (`stateStore__providerClass`, ...) for the queries that start within; put back after."""
    names = {f"spark.sql.streaming.{k.replace('__', '.')}": v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def sliding_counts(events: DataFrame, keys: list[str], window: str = "1 day", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(start, end, keys..., n): rows of `events` (ts, keys) in every window of length `window` that begins each `slide`.

    In a stream a window is given once the watermark, the latest `ts` less `late`, has passed its end; rows that are later than
    that are left out. A batch gives all windows. Rows without `ts` are in none.
    """
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("_w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, keys..., n): runs of a key's rows in which each comes less than `gap` after the one before; `end` is the last row's `ts` and `gap`.

    Late rows up to the watermark may join two runs; a stream gives a run once the watermark has passed its end.
    """
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("_w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "n")


def appended(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """What a stream appends until its input is read, as a table; state and progress are in `folder`, where a later run goes on."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
