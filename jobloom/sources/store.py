"""Tables that are merged in place: rows in hashed buckets, of which a merge reads and writes only those that its batch touches."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.operators import lifecycle as L


def shared_folder(spark: SparkSession) -> str:
    """A new folder below `spark.checkpoint.dir`, which driver and executors share. On one machine, where that is unset, a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="jobloom-")
    return f"{top.rstrip('/')}/jobloom-{uuid.uuid4().hex}"


class Folder:
    """Files below a path of whatever file system Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file or none: it is written beside its place, then renamed."""
        beside = self._at(f".{uuid.uuid4().hex}")
        stream = self.fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self._at(name).getParent())
        if self.exists(name) or not self.fs.rename(beside, self._at(name)):
            self.fs.delete(beside, False)
            raise FileExistsError(f"{self.path}/{name} is there already")

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class BucketedTable:
    """A keyed table in Parquet: `data/_b=<bucket>/_v=<version>`, and a file `versions/<version>` that names each bucket's folder.

    A bucket is the hash of the keys modulo `buckets`, within a value of the column `within` if that is given: then a batch of one
    source touches that source's buckets only. `merge` writes the touched buckets under the next version and then the version's file,
    which is the commit: before it readers see the old version, and what a failed merge has left is never read. One
    writer at a time; a version that is there already is not merged again. The driver holds a line a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16, within: str | None = None):
        self.spark, self.path, self.keys, self.buckets, self.within = spark, path.rstrip("/"), keys, buckets, within
        self.folder = Folder(spark, self.path)

    def bucket(self) -> Column:
        """The bucket of a row; null keys hash like any value."""
        own = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")
        return F.concat(F.coalesce(F.hex(F.col(self.within).cast("string")), F.lit("null")), F.lit("-"), own) if self.within else own

    @property
    def version(self) -> int | None:
        """The last committed version; null before the first."""
        return max((int(x) for x in self.folder.names("versions") if x.isdigit()), default=None)

    def _state(self, version: int) -> dict:
        return json.loads(self.folder.read(f"versions/{version}"))

    def _read(self, state: dict, buckets: Iterable[str]) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        paths = [f"{self.path}/data/_b={b}/_v={state['buckets'][b]}" for b in buckets if b in state["buckets"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The whole table, as it is or as it was at a version."""
        state = self._state(self.version if version is None else version)
        return self._read(state, sorted(state["buckets"]))

    def _commit(self, rows: DataFrame, version: int, touched: list[str], before: dict) -> None:
        out = rows.withColumns({"_b": self.bucket(), "_v": F.lit(version)}).repartition("_b")
        out.write.partitionBy("_b", "_v").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/data")
        buckets = {b: v for b, v in before.items() if b not in touched}
        buckets |= {b: version for b in touched if self.folder.exists(f"data/_b={b}/_v={version}")}
        self.folder.write(f"versions/{version}", json.dumps({"schema": rows.schema.jsonValue(), "buckets": buckets}))

    def _touched(self, rows: DataFrame) -> list[str]:
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]

    def create(self, rows: DataFrame, version: int = 0) -> None:
        """The first version; `rows` have distinct keys."""
        self._commit(rows, version, self._touched(rows), {})

    def merge(self, batch: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None, whole: bool = False) -> list[str]:
        """The next version: `rule(stored, batch)` over the buckets that `batch` touches, with the table's columns. Gives these buckets.

        With `whole` a batch touches every bucket of its `within` values, for rules on keys that the batch lacks. `version` may be
        the id of a streamed batch: one that is committed already is left alone.
        """
        now = self.version
        version = now + 1 if version is None else version
        if version <= now:
            return []
        state, touched = self._state(now), self._touched(batch)
        if whole:
            groups = {b.rpartition("-")[0] for b in touched}
            touched = sorted({*touched, *(b for b in state["buckets"] if b.rpartition("-")[0] in groups)})
        stored = self._read(state, touched)
        self._commit(rule(stored, batch).select(stored.columns), version, touched, state["buckets"])
        return touched

    def changes(self, columns: list[str], version: int | None = None) -> DataFrame:
        """Audit rows (keys..., field, old_value, new_value) of a version against the one before: only buckets that differ are read."""
        version = self.version if version is None else version
        earlier = max((int(x) for x in self.folder.names("versions") if x.isdigit() and int(x) < version), default=None)
        new, old = self._state(version), self._state(earlier) if earlier is not None else {"schema": self._state(version)["schema"], "buckets": {}}
        differ = sorted(b for b in {*new["buckets"], *old["buckets"]} if new["buckets"].get(b) != old["buckets"].get(b))
        return L.audit(self._read(old, differ), self._read(new, differ), columns)

    def vacuum(self) -> int:
        """Deletes folders that the last version doesn't name, older versions and what failed merges left; gives their number."""
        now, gone = self.version, 0
        state = self._state(now)["buckets"]
        for b in self.folder.names("data"):
            for v in self.folder.names(f"data/{b}") if b.startswith("_b=") else []:
                if v.startswith("_v=") and state.get(b[3:]) != int(v[3:]):
                    self.folder.delete(f"data/{b}/{v}")
                    gone += 1
        for x in self.folder.names("versions"):
            if x.isdigit() and int(x) < now:
                self.folder.delete(f"versions/{x}")
        return gone
