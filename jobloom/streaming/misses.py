"""The miss counter over a stream of sweeps: as merges into a stored table, or as keyed state that gives the changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from jobloom.operators.lifecycle import CLOSED_AT, KEY, STALE_AT, reap_missing
from jobloom.sources.model import ALIVE
from jobloom.sources.store import BucketedTable


class MissCounter:
    """A `foreachBatch` sink. Every batch is a full sweep (source_id, external_id seen) of its sources; the state is a `BucketedTable`.

    Each batch is a version of the table, and reads and writes the buckets of its sources only. A batch that is replayed after
    a failure starts from the version before it again, one that is committed changes nothing, and a new counter over the same
    folder goes on from there; `initial` counts only where there is none.
    """

    def __init__(self, spark: SparkSession, path: str, initial: DataFrame, buckets: int = 16):
        self.table = BucketedTable(spark, path, KEY, buckets, "source_id")
        if self.version is None:
            self.table.create(initial)

    @property
    def version(self) -> int | None:
        """The last batch that is in the state; -1 for none, null where there is no state yet."""
        now = self.table.version
        return None if now is None else now - 1

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.table.merge(batch, reap_missing, batch_id + 1, whole=True)

    def state(self) -> DataFrame:
        return self.table.read()


#: Columns of a stream of sweeps: a posting that a sweep saw; without an external id: the sweep of the source is whole.
SWEEPS = "source_id long, external_id string, sweep long"
CHANGES = "source_id long, external_id string, sweep long, old_status string, status string, miss_count int"


class Misses(StatefulProcessor):
    """The postings of a source and part as map state: external id -> status, misses, sweep last seen.

    Rows of a batch go by sweep, sightings before the end of their sweep. A sighting resets misses and leaves the status alone; an unknown
    posting begins OPEN. The end of a sweep counts a miss for every alive posting that it didn't see. An entry that no
    sweep touches for `ttl_ms` goes, which is how closed postings leave the state; seen again after that one is new.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "external_id string", "status string, misses int, sweep long", self.ttl_ms)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        for r in initialState.itertuples(index=False):
            self.known.updateValue((r.external_id,), (r.status, int(r.miss_count), -1))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))[["external_id", "sweep"]]
        ends = sorted(int(x) for x in events.sweep[events.external_id.isna()].unique())
        seen = events[events.external_id.notna()].drop_duplicates().sort_values(["sweep", "external_id"])
        # The end of a sweep concerns all postings of the part; without one only those that were seen.
        state = {k[0]: v for k, v in self.known.iterator()} if ends else {x: self.known.getValue((x,)) for x in seen.external_id.unique() if self.known.containsKey((x,))}
        state = {k: (v[0], int(v[1]), int(v[2])) for k, v in state.items()}
        before, changes = dict(state), []

        def change(x: str, sweep: int, status: str, misses: int, last: int) -> None:
            old = state.get(x)
            if old is None or old[:2] != (status, misses):
                changes.append((int(key[0]), x, sweep, old and old[0], status, misses))
            state[x] = (status, misses, last)

        steps = sorted([(int(s), 0, x) for x, s in zip(seen.external_id, seen.sweep)] + [(s, 1, "") for s in ends])
        for sweep, end, x in steps:
            if not end:
                status, _, last = state.get(x, ("OPEN", 0, -1))
                change(x, sweep, status, 0, max(last, sweep))
                continue
            for x, (status, misses, last) in list(state.items()):
                if status in ALIVE and last < sweep:
                    change(x, sweep, "CLOSED" if misses + 1 >= CLOSED_AT else "STALE" if misses + 1 >= STALE_AT else status, misses + 1, last)
        for x, v in state.items():
            if before.get(x) != v:
                self.known.updateValue((x,), v)
        yield pd.DataFrame(changes, columns=["source_id", "external_id", "sweep", "old_status", "status", "miss_count"])

    def close(self) -> None:
        pass


def streamed_misses(sweeps: DataFrame, initial: DataFrame | None = None, parts: int = 16, ttl_days: int | None = 90) -> DataFrame:
    """CHANGES of a stream of SWEEPS, from keyed state in RocksDB: nothing of the postings' table is read or written again.

    A source's postings are dealt to `parts` groups by their id, so that one source may hold any share; the end of a sweep goes to all
    of them. Sightings come no later than the end of their sweep; one that does come later resets the misses then. `initial`
    (KEY, status, miss_count) is what is known before the first batch. `parts` stays as it is for the life of a checkpoint.
    Set `spark.sql.streaming.stateStore.providerClass` to RocksDB's; with a TTL, which goes by processing time, also
    `spark.sql.streaming.noDataMicroBatches.enabled` to false where the query is to end once the input is read.
    """
    part = F.pmod(F.xxhash64("external_id"), F.lit(parts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    dealt = sweeps.where("source_id is not null and sweep is not null").select("source_id", "external_id", "sweep", F.explode(F.when(F.col("external_id").isNull(), every).otherwise(F.array(part))).alias("part"))
    known = None if initial is None else initial.select("source_id", part.alias("part"), "external_id", "status", "miss_count").groupBy("source_id", "part")
    return dealt.groupBy("source_id", "part").transformWithStateInPandas(Misses(ttl_days and ttl_days * 86_400_000), CHANGES, "Append", "ProcessingTime" if ttl_days else "None", known)


def after_changes(initial: DataFrame, changes: DataFrame) -> DataFrame:
    """(KEY, status, miss_count) of `initial` after all `changes`: each posting's last one."""
    last = changes.groupBy(*KEY).agg(F.max_by(F.struct("status", "miss_count"), F.struct("sweep", "miss_count")).alias("_c"))
    both = initial.select(*KEY, "status", "miss_count").join(last, KEY, "full_outer")
    return both.select(*KEY, F.coalesce("_c.status", "status").alias("status"), F.coalesce("_c.miss_count", "miss_count").alias("miss_count"))


def run_stream(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs what there is to its end."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """A stream's rows without those whose keys came before, as far back as the watermark; state older than that is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n) by event time, late rows up to the watermark; the same plan serves batches and streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
