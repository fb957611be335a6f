"""What the training-data operators share: reading tables, cutting lineage, streaming sorted groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. On one machine, where it is unset, a temporary one is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="jobloom-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and go on from there: for wide or many rows, which checkpoints don't compress."""
    path = f"{stage_dir(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by `written`."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        for top in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def private(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while f"__{name}".lower() in taken:
        name += "_"
    return f"__{name}"


def null_to_low(c: Column) -> Column:
    """Ids as sort keys: null comes before every number."""
    return F.coalesce(c.cast("long"), F.lit(-(2**63)))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `max_bytes` or a single row: long texts stay bounded in memory."""
    for batch in batches:
        step = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of consecutive equal keys from sorted batches.

    Tables yielded hold one or more whole groups; only a group that crosses a batch's end is carried over.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        differs = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            differs[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(differs)
        if held:
            same = all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
            if not same:
                yield pa.Table.from_batches(held)
                held = []
        if not len(starts):
            held.append(batch)
            continue
        last = int(starts[-1])
        yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def bounds_of(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(columns[0])
    differs = np.zeros(n, dtype=bool)
    for v in columns:
        differs[1:] |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(differs), [n]]).astype(np.int64)


def stage_dir(spark: SparkSession) -> str:
    """A new folder for written tables below the shared folder."""
    return f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
