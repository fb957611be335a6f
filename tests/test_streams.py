"""Streams with late rows, restarts and failures, against batches."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from jobloom.streaming import windows as W
from jobloom.streaming.guard import FailureGuard, StreakReached, runs_of
from jobloom.streaming.misses import run_stream

EVENTS = "user_id long, ts timestamp"
DAY = dt.datetime(2026, 1, 1)


def at(hours: float) -> dt.datetime:
    return DAY + dt.timedelta(hours=hours)


def feed(spark, folder, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


#: Batches, each of which moves the watermark to an hour before its latest row; the last row of the second is late but within it, that of the third beyond.
BATCHES = [[(1, at(1)), (1, at(1.2)), (2, at(2))], [(1, at(5)), (2, at(1.1))], [(1, at(9)), (1, at(1.9))], [(3, at(30)), (None, at(30)), (3, None)]]
KEPT = [r for b in BATCHES for r in b if r != (1, at(1.9))]


@pytest.mark.parametrize("made", [lambda e: W.sliding_counts(e, ["user_id"], "2 hours", "1 hour"), lambda e: W.sessions(e, ["user_id"], "30 minutes")], ids=["sliding", "sessions"])
def test_late_rows(spark, tmp_path, made):
    """Rows within the watermark count, those beyond it don't: the stream, restarted after each batch, gives what a batch over the kept rows gives."""
    for rows in BATCHES:
        feed(spark, tmp_path / "in", rows)
        got = W.appended(made(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))), str(tmp_path / "run"))
    key = lambda r: (r.start, r.user_id is not None, r.user_id or 0)
    want = made(spark.createDataFrame(KEPT, EVENTS)).where(F.col("end") <= F.lit(at(29)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert len({key(r) for r in got.collect()}) == got.count() > 4


def test_a_late_row_joins_two_sessions(spark, tmp_path):
    for rows in ([(1, at(1)), (1, at(1.8))], [(1, at(1.4))], [(2, at(9))]):
        feed(spark, tmp_path / "in", rows)
        got = W.appended(W.sessions(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), ["user_id"]), str(tmp_path / "run"))
    assert [(r.start, r.user_id, r.n) for r in got.collect()] == [(at(1), 1, 3)]


ROWS = "source_id long, at long, bad boolean"


def test_runs_of_failures(spark):
    rows = [(1, k, b) for k, b in enumerate([True, True, False, True, True, True, False, True])] + [(2, k, True) for k in range(4)] + [(3, 0, False), (3, 1, None)]
    got = {r.source_id: (r.rows, r.lead, r.trail, r.longest) for r in runs_of(spark.createDataFrame(rows, ROWS), "source_id", ["at"], "bad").collect()}
    assert got == {1: (8, 2, 1, 3), 2: (4, 4, 4, 4), 3: (2, 0, 0, 0)}


def test_a_stream_ends_after_failures_in_a_row_and_goes_on(spark, tmp_path):
    """Source 2 fails three times in the first batch and twice in the second: the query ends there, and goes on once the source is left out."""
    batches = [[(1, k, k % 2 == 0) for k in range(9)] + [(2, 0, False), *((2, k, True) for k in (1, 2, 3))], [(2, 4, True), (2, 5, True), (1, 9, False)], [(1, 10, True), (3, 0, True)]]
    for rows in batches:
        feed(spark, tmp_path / "in", rows, ROWS)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(**kw):
        guard = FailureGuard(spark, str(tmp_path / "streaks"), lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}"), **kw)
        run_stream(stream, guard, str(tmp_path / "progress"))
        return {r.source_id: r.streak for r in guard.streaks().collect()}

    for _ in range(2):  # started again it ends at the same place
        with pytest.raises((StreakReached, StreamingQueryException), match="in a row: 2"):
            run()
        assert spark.read.parquet(str(tmp_path / "out")).count() == len(batches[0])
    assert run(skip=[2]) == {1: 1, 2: 3, 3: 1}
    out = sorted((r.source_id, r.at) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out == sorted((s, k) for rows in batches for s, k, _ in rows if (s, k) not in {(2, 4), (2, 5)})


@pytest.mark.parametrize("limit", [0, -1, 2.5, True, None])
def test_limits(spark, tmp_path, limit):
    with pytest.raises(ValueError, match="at least 1"):
        FailureGuard(spark, str(tmp_path), lambda *_: None, limit=limit)
