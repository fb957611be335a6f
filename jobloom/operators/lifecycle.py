"""Postings as a state machine with an audit trail: merge, sweep, misses, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.sources.model import ALIVE

STALE_AT, CLOSED_AT = 1, 3
KEY = ["source_id", "external_id"]


def upsert(stored: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """(key..., outcome, status, miss_count, salary_min, salary_max): the table after a batch (key, salaries, expires_on) is merged.

    New keys are created, known ones updated: misses reset, status by the end date; others stay.
    """
    b = batch.select(*KEY, *[F.col(c).alias(f"n_{c}") for c in ("salary_min", "salary_max", "expires_on")], F.lit(True).alias("b"))
    s = stored.select(*KEY, "status", "miss_count", "salary_min", "salary_max", F.lit(True).alias("s"))
    fresh = F.when(F.col("n_expires_on") < as_of, "EXPIRED").otherwise("OPEN")
    pick = lambda c: F.when(F.col("b"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    return s.join(b, KEY, "full_outer").select(*KEY, F.when(F.col("b").isNull(), "kept").when(F.col("s").isNull(), "created").otherwise("updated").alias("outcome"), F.when(F.col("b"), fresh).otherwise(F.col("status")).alias("status"), F.when(F.col("b"), F.lit(0)).otherwise(F.col("miss_count")).alias("miss_count"), pick("salary_min"), pick("salary_max"))


def upsert_rows(stored: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """`stored` (KEY, status, miss_count, expires_on and any others) after `batch` (KEY and some of its columns) is merged, all columns kept.

    Columns that the batch has take its values, also null ones; new keys have null in the others. Misses are reset, status
    goes by the end date. Of several rows of a key in the batch the one of least values counts.
    """
    given = [c for c in batch.columns if c not in KEY]
    least = batch.groupBy(*KEY).agg(F.min(F.struct(*given)).alias("_b")) if given else batch.select(*KEY).distinct().withColumn("_b", F.struct(F.lit(1)))
    both = stored.withColumn("_s", F.lit(True)).join(least, KEY, "full_outer")
    hit = F.col("_b").isNotNull()
    made = {c: F.when(hit, F.col(f"_b.{c}")).otherwise(F.col(c)) for c in given}
    made |= {"status": F.when(hit, derived_status(made.get("expires_on", F.col("expires_on")), as_of)).otherwise(F.col("status")), "miss_count": F.when(hit, F.lit(0)).otherwise(F.col("miss_count")).cast(stored.schema["miss_count"].dataType)}
    return both.select(*[made.get(c, F.col(c)).cast(stored.schema[c].dataType).alias(c) for c in stored.columns])


def audit(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """(key..., field, old_value, new_value): a row for every value that changed, null-safe, from one join."""
    n = new.select(*KEY, *[F.col(c).alias(f"n_{c}") for c in columns])
    each = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"n_{c}")), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("old_value"), F.col(f"n_{c}").cast("string").alias("new_value"))) for c in columns]))
    return old.join(n, KEY).select(*KEY, F.inline(each))


def reap_missing(stored: DataFrame, seen: DataFrame, full_sweep: bool = True) -> DataFrame:
    """`stored` with misses counted: an alive posting that a full sweep of its source didn't see is STALE, at CLOSED_AT misses CLOSED.

    Sources of which nothing was seen aren't reaped; seen postings' misses are reset, their status left alone.
    """
    if not full_sweep:
        return stored
    swept = seen.select("source_id").distinct().withColumn("swept", F.lit(True))
    found = seen.select(*KEY).distinct().withColumn("found", F.lit(True))
    rows = stored.join(swept, "source_id", "left").join(found, KEY, "left")
    missed = F.col("status").isin(ALIVE) & F.col("swept").isNotNull() & F.col("found").isNull()
    count = F.when(F.col("found"), 0).when(missed, F.col("miss_count") + 1).otherwise(F.col("miss_count"))
    status = F.when(missed & (count >= CLOSED_AT), "CLOSED").when(missed & (count >= STALE_AT), "STALE").otherwise(F.col("status"))
    return rows.withColumns({"status": status, "miss_count": count.cast("int")}).drop("swept", "found")


def deadline_sweep(stored: DataFrame, as_of: Column) -> DataFrame:
    """(posting_id, old_status, new_status) of alive postings past their end."""
    return stored.where(F.col("status").isin(ALIVE) & (F.col("expires_on") < as_of)).select("posting_id", F.col("status").alias("old_status"), F.lit("EXPIRED").alias("new_status"))


def probe_outcome(code: Column, marker: Column, blocks: Column, valid_through: Column, status: Column, as_of: Column) -> Column:
    """What a probe's answer makes of a status: gone, marked or over is EXPIRED; proof of life revives; other answers change nothing."""
    revived = F.when(status == "STALE", "OPEN").otherwise(status)
    return F.when(code.isin(404, 410), "EXPIRED").when(code == 304, revived).when(code != 200, status).when(marker, "EXPIRED").when(blocks == 0, "EXPIRED").when(valid_through < as_of, "EXPIRED").otherwise(revived)


def longest_streak(rows: DataFrame, key: str, order: list[str], bad: Column) -> DataFrame:
    """(key, streak): the longest run of consecutive bad rows; runs are keyed by the difference of two row numbers."""
    w = Window.partitionBy(key).orderBy(*order)
    runs = rows.withColumn("bad", bad).withColumn("a", F.row_number().over(w)).withColumn("b", F.row_number().over(Window.partitionBy(key, "bad").orderBy(*order)))
    runs = runs.groupBy(key, "bad", (F.col("a") - F.col("b")).alias("run")).agg(F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("bad"), F.col("n"))), F.lit(0)).cast("long").alias("streak"))


def high_water(runs: DataFrame) -> DataFrame:
    """(source_id, since): the last good run's end less an hour of overlap."""
    return runs.where(F.col("status").isin("SUCCESS", "PARTIAL")).groupBy("source_id").agg((F.max("finished_at") - F.expr("interval 1 hour")).alias("since"))


def within_quota(rows: DataFrame, query: str, order: list[str], total: int, n_queries: int) -> DataFrame:
    """Each query's first rows: an even share of the total, rounded up."""
    w = Window.partitionBy(query).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= -(-total // n_queries)).drop("_rn")


def derived_status(expires_on: Column, as_of: Column) -> Column:
    """A new posting's status: EXPIRED past its end, else OPEN."""
    return F.when(expires_on < as_of, "EXPIRED").otherwise("OPEN")


def parse_status(status: Column, out_of_range: Column) -> Column:
    """Pay out of range makes a whole row a partial one; failures stay."""
    return F.when((status == "OK") & out_of_range, "PARTIAL").otherwise(status)


def alive_status(status: Column) -> Column:
    """What proof of life makes of a status."""
    return F.when(status == "STALE", "OPEN").otherwise(status)


def probe_kind(configured: Column, source_kind: Column) -> Column:
    """How a posting is looked at: as its source is configured, else by the source's kind."""
    return F.coalesce(configured, F.when(source_kind == "API", "api").otherwise("page"))


def trigger(scheduled: Column, full: Column) -> Column:
    """Why a run began."""
    return F.when(scheduled, "SCHEDULE").when(full, "FULL").otherwise("MANUAL")


def source_runs(events: DataFrame) -> DataFrame:
    """(source_id, seen, jobs, errors, status, since) of a run's events (source_id, kind: seen, job, error or null, at): FAILED with errors and no job, PARTIAL with errors, else SUCCESS.

    since is where the next run may go on: the end less an hour of overlap; null after a failure.
    """
    n = lambda kind: F.count_if(F.col("kind") == kind)
    runs = events.groupBy("source_id").agg(n("seen").alias("seen"), n("job").alias("jobs"), n("error").alias("errors"), F.max("at").alias("finished_at"))
    status = F.when((F.col("jobs") == 0) & (F.col("errors") > 0), "FAILED").when(F.col("errors") > 0, "PARTIAL").otherwise("SUCCESS")
    runs = runs.withColumn("status", status)
    return runs.select("source_id", "seen", "jobs", "errors", "status", F.when(F.col("status") != "FAILED", F.col("finished_at") - F.expr("interval 1 hour")).alias("since"))
