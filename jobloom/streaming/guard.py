"""A stream that ends where a source fails again and again, and goes on from there once that is mended."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.sources.store import BucketedTable


class StreakReached(RuntimeError):
    """Sources that failed so often in a row."""

    def __init__(self, sources: list):
        super().__init__(f"too many failures in a row: {', '.join(map(str, sources))}")
        self.sources = sources


def runs_of(rows: DataFrame, source: str, order: list[str], bad: str) -> DataFrame:
    """(source, rows, lead, trail, longest): of each source's rows in order their number, and the failures at the start, at the end, and in the longest run."""
    by = Window.partitionBy(source)
    numbered = rows.select(source, F.coalesce(F.col(bad), F.lit(False)).alias("_bad"), *order).select(source, "_bad", F.row_number().over(by.orderBy(*order)).alias("_a"), F.row_number().over(Window.partitionBy(source, "_bad").orderBy(*order)).alias("_b"))
    runs = numbered.groupBy(source, "_bad", (F.col("_a") - F.col("_b")).alias("_run")).agg(F.count("*").alias("n"), F.min("_a").alias("first"), F.max("_a").alias("last"))
    failed = F.when(F.col("_bad"), F.col("n")).otherwise(0)
    return runs.groupBy(source).agg(F.sum("n").alias("rows"), F.min_by(failed, "first").alias("lead"), F.max_by(failed, "last").alias("trail"), F.max(failed).alias("longest"))


class FailureGuard:
    """A `foreachBatch` sink for rows (source, order..., bad): hands each batch to `write`, and keeps every source's failures in a row.

    A source whose last failures, over batches, come to `limit` in a row ends the query with `StreakReached` before the batch is written: the
    batch is read again when the query goes on. `skip` leaves sources out, as one does with those that ended it. The
    streaks are a table under `path`, a version a batch, so that a replayed batch counts once; `write(batch, id)` may see a
    batch twice, as with every `foreachBatch` sink.
    """

    def __init__(self, spark: SparkSession, path: str, write: Callable[[DataFrame, int], None], source: str = "source_id", order: Collection[str] = ("at",), bad: str = "bad", limit: int = 5, skip: Collection = ()):
        if not isinstance(limit, int) or isinstance(limit, bool) or limit < 1:
            raise ValueError(f"the limit is a whole number of at least 1, not {limit!r}")
        self.spark, self.write, self.source, self.order, self.bad, self.limit, self.skip = spark, write, source, list(order), bad, limit, list(skip)
        self.table = BucketedTable(spark, path, [source], buckets=1)

    def streaks(self) -> DataFrame:
        """(source, streak): failures in a row up to the last batch."""
        return self.table.read()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.table.version is None:
            self.table.create(batch.select(self.source, F.lit(0).cast("long").alias("streak")).limit(0))
        if batch_id + 1 <= self.table.version:
            return
        rows = batch.where(~F.col(self.source).isin(self.skip)) if self.skip else batch
        # A row for each source.
        now = runs_of(rows, self.source, self.order, self.bad).join(self.streaks(), self.source, "left").withColumn("streak", F.coalesce("streak", F.lit(0)))
        whole = F.col("lead") == F.col("rows")
        now = now.select(self.source, F.greatest("longest", F.col("streak") + F.col("lead")).alias("most"), F.when(whole, F.col("streak") + F.col("rows")).otherwise(F.col("trail")).cast("long").alias("streak")).persist()
        try:
            over = sorted(r[0] for r in now.where(F.col("most") >= self.limit).select(self.source).collect())
            if over:
                raise StreakReached(over)
            self.write(rows, batch_id)
            self.table.merge(now.select(self.source, "streak"), lambda old, new: old.join(new, self.source, "left_anti").union(new), batch_id + 1)
        finally:
            now.unpersist()
