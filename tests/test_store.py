"""Tables merged in place and keyed state over sweeps, with crashes, restarts and replays."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from jobloom.operators import lifecycle as L
from jobloom.sources.store import BucketedTable, Folder
from jobloom.streaming import misses as S

POSTING = "source_id long, external_id string, status string, miss_count int, salary_min long, expires_on date, title string"
AS_OF = "2026-06-15"


def as_of():
    return F.lit(AS_OF).cast("date")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.fixture()
def stored(spark):
    return spark.createDataFrame([(s, f"job-{k}", "STALE", 2, k, None, f"t{k}") for s in range(4) for k in range(50)], POSTING)


def upsert(s, b):
    return L.upsert_rows(s, b, as_of())


def test_a_batch_touches_its_buckets_only(spark, stored, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), L.KEY, 8, "source_id")
    t.create(stored)
    assert t.version == 0 and rows_of(t.read()) == rows_of(stored)
    batch = spark.createDataFrame([(1, "job-3", 900), (1, "job-7", None), (1, "new", 5), (1, "new", 9)], "source_id long, external_id string, salary_min long")
    touched = t.merge(batch, upsert)
    assert 0 < len(touched) <= 3
    folder = Folder(spark, str(tmp_path / "t"))
    assert sorted(b for b in folder.names("data") if folder.exists(f"data/{b}/_v=1")) == sorted(f"_b={b}" for b in touched)
    got = {(r.source_id, r.external_id): r for r in t.read().collect()}
    assert len(got) == 201
    assert got[1, "job-3"][2:] == ("OPEN", 0, 900, None, "t3") and got[1, "job-7"].salary_min is None
    assert got[1, "new"][2:] == ("OPEN", 0, 5, None, None)
    assert got[2, "job-3"][2:] == ("STALE", 2, 3, None, "t3")
    assert rows_of(t.read(0)) == rows_of(stored)  # the version before is still there
    assert rows_of(t.changes(["salary_min", "status"])) == sorted([(1, "job-3", "salary_min", "3", "900"), (1, "job-3", "status", "STALE", "OPEN"), (1, "job-7", "salary_min", "7", None), (1, "job-7", "status", "STALE", "OPEN")])
    assert t.vacuum() == len(touched) - (1 if (1, "new") not in got else 0) or t.vacuum() == 0
    assert len(rows_of(t.read())) == 201


def test_merges_equal_a_whole_rewrite(spark, stored, tmp_path):
    """Five random batches, of which some touch sources that are new, some none."""
    rng, t, want = random.Random(1), BucketedTable(spark, str(tmp_path / "t"), L.KEY, 4), stored
    t.create(stored)
    for _ in range(4):
        rows = [(rng.randrange(6), f"job-{rng.randrange(80)}", rng.choice([None, 1, 2])) for _ in range(rng.choice([0, 3, 30]))]
        batch = spark.createDataFrame(rows, "source_id long, external_id string, salary_min long")
        t.merge(batch, upsert)
        want = spark.createDataFrame(upsert(want, batch).collect(), POSTING)
        assert rows_of(t.read()) == rows_of(want)


def test_a_crash_before_the_commit_leaves_the_old_version(spark, stored, tmp_path, monkeypatch):
    t = BucketedTable(spark, str(tmp_path / "t"), L.KEY, 8, "source_id")
    t.create(stored)
    batch = spark.createDataFrame([(0, "job-1", 7), (3, "job-2", 8)], "source_id long, external_id string, salary_min long")

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(t.folder, "write", fails)
        with pytest.raises(OSError):
            t.merge(batch, upsert)
    again = BucketedTable(spark, str(tmp_path / "t"), L.KEY, 8, "source_id")
    assert again.version == 0 and rows_of(again.read()) == rows_of(stored)
    # Another batch takes the same version; what the failed one left is not read.
    again.merge(batch.where("source_id = 0"), upsert)
    got = {(r.source_id, r.external_id): r.salary_min for r in again.read().collect()}
    assert again.version == 1 and (got[0, "job-1"], got[3, "job-2"]) == (7, 2)
    assert again.merge(batch, upsert, version=1) == [] and again.version == 1
    with pytest.raises(FileExistsError):
        again.folder.write("versions/1", "{}")


def test_an_emptied_bucket_is_empty(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), ["k"], 4)
    t.create(spark.range(10).select(F.col("id").alias("k")))
    t.merge(spark.range(10).select(F.col("id").alias("k")), lambda s, b: s.join(b.where("k < 9"), "k", "left_anti"))
    assert [r.k for r in t.read().collect()] == [9]
    t.merge(spark.createDataFrame([(9,)], "k long"), lambda s, b: s.join(b, "k", "left_anti"))
    assert t.read().collect() == [] and t.read().columns == ["k"]


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocksdb(spark):
    conf = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    yield
    for name in conf:
        spark.conf.unset(name)


def plain_misses(state: dict, sweeps: list[tuple[int, int, list[str]]]) -> dict:
    """state: (source, id) -> (status, misses), after sweeps (source, sweep, ids)."""
    state = dict(state)
    for source, _, ids in sweeps:
        for x in ids:
            state[source, x] = (state.get((source, x), ("OPEN", 0))[0], 0)
        for (s, x), (status, n) in list(state.items()):
            if s == source and x not in ids and status in ("OPEN", "STALE"):
                state[s, x] = ("CLOSED" if n + 1 >= 3 else "STALE", n + 1)
    return state


def test_keyed_state_equals_replay(spark, tmp_path, rocksdb):
    """Five sweeps of three sources in five batches, the query restarted between them: state and changes are those of a replay."""
    rng = random.Random(8)
    initial = {(s, f"j{k}"): rng.choice([("OPEN", 0), ("STALE", 1), ("STALE", 2), ("CLOSED", 3), ("EXPIRED", 0)]) for s in range(3) for k in range(12)}
    sweeps = [(s, n, sorted({f"j{rng.randrange(16)}" for _ in range(9)})) for n in range(5) for s in range(3) if (s, n) != (2, 3)]
    begin = spark.createDataFrame([(*k, *v) for k, v in initial.items()], "source_id long, external_id string, status string, miss_count int")
    for n in range(5):
        rows = [(s, x, m) for s, m, ids in sweeps if m == n for x in [*ids, None]]
        rng.shuffle(rows)
        spark.createDataFrame(rows, S.SWEEPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes = S.streamed_misses(spark.readStream.schema(S.SWEEPS).parquet(str(tmp_path / "in")), begin, parts=3)
        changes.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        got = {(r.source_id, r.external_id): (r.status, r.miss_count) for r in S.after_changes(begin, spark.read.schema(S.CHANGES).parquet(str(tmp_path / "out"))).collect()}
        assert got == plain_misses(initial, [x for x in sweeps if x[1] <= n])
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "known").load()
    assert state.count() == len(got)  # a key each, whatever the number of sweeps


def test_sweeps_in_one_batch_and_late_sightings(spark, tmp_path, rocksdb):
    rows = [(1, "a", 1), (1, "b", 1), (1, None, 1), (1, "a", 2), (1, None, 2), (1, "a", 3), (1, None, 3), (1, None, 4), (None, "x", 1), (1, "y", None)]
    spark.createDataFrame(rows, S.SWEEPS).coalesce(1).write.parquet(str(tmp_path / "in"))
    changes = S.streamed_misses(spark.readStream.schema(S.SWEEPS).parquet(str(tmp_path / "in")), parts=2, ttl_days=None)
    changes.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = rows_of(spark.read.parquet(str(tmp_path / "out")))
    assert got == sorted([(1, "a", 1, None, "OPEN", 0), (1, "b", 1, None, "OPEN", 0), (1, "b", 2, "OPEN", "STALE", 1), (1, "b", 3, "STALE", "STALE", 2), (1, "b", 4, "STALE", "CLOSED", 3), (1, "a", 4, "OPEN", "STALE", 1)], key=lambda r: tuple((x is not None, str(x)) for x in r))
