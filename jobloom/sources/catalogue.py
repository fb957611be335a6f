"""Sources: their catalogue, what a workspace takes of them, how each kind is read, where raw records are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.sources import records

SOURCE = "code string, name string, home_url string, kind string, entry_url string, job_url_pattern string, priority int, note string"
TARGET = "code string, is_active boolean, queries array<string>, url_include_pattern string"
API, SITEMAP, MANUAL = "API", "SITEMAP_JSONLD", "MANUAL"
#: kind -> what makes declared postings of a table of that kind's raw rows. Manual sources have none: their robots.txt forbids reading them.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    API: lambda raw: raw.select(F.col("record.jobUrl").alias("url"), records.record_to_posting(F.col("record")).alias("posting")),
    SITEMAP: lambda raw: records.collect(raw).where("kind = 'job'").select("url", "posting"),
}


def adapter(code: str, kind: str, by_code: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> Callable[[DataFrame], DataFrame]:
    """How a source is read: by its own code if that has a way of its own, else by its kind."""
    if kind == MANUAL:
        raise ValueError(f"{code} is entered by hand and isn't collected")
    if code in (by_code or {}):
        return by_code[code]
    if kind not in ADAPTERS:
        raise ValueError(f"{code}: no adapter for kind {kind}; there are {', '.join(ADAPTERS)}")
    return ADAPTERS[kind]


def seeds(catalogue: DataFrame, targets: DataFrame) -> DataFrame:
    """The catalogue (SOURCE) with what a workspace takes of each source (TARGET): config as JSON and is_active.

    Both sides must be complete: a target without a source and a source without a target are errors, named in one message.
    """
    both = catalogue.join(targets.withColumn("t", F.lit(True)), "code", "full_outer")
    # A row for each source that is wrong: the catalogue's size bounds them.
    wrong = both.where(F.col("name").isNull() | F.col("t").isNull()).select("code", F.col("t").isNull().alias("missing")).orderBy("code").collect()
    if wrong:
        said = [f"{r.code} ({'no target' if r.missing else 'not in the catalogue'})" for r in wrong]
        raise ValueError("sources: " + ", ".join(said))
    config = F.to_json(F.struct(F.when(F.size("queries") > 0, F.col("queries")).alias("queries"), F.col("url_include_pattern").alias("urlIncludePattern")))
    return both.select(*[c.split()[0] for c in SOURCE.split(", ")], F.nullif(config, F.lit("{}")).alias("config"), "is_active")


def upsert_dimension(stored: DataFrame, seed: DataFrame, key: str, create_only: bool = False) -> DataFrame:
    """A dimension after seeding: seeded rows replace stored ones of their key, or only add to them; others stay. Seeding twice changes nothing."""
    first, second = (stored, seed) if create_only else (seed, stored)
    return first.unionByName(second.join(first.select(key), key, "left_anti").select(*first.columns))


def blob_key(source: Column, external_id: Column, at: Column) -> Column:
    """Where a raw record is kept: source/yyyy-MM/id.json.gz, the id made safe and cut."""
    safe = F.left(F.regexp_replace(external_id, "[^A-Za-z0-9._-]", "_"), F.lit(100))
    return F.concat(source, F.lit("/"), F.date_format(at, "yyyy-MM"), F.lit("/"), safe, F.lit(".json.gz"))


def write_raw(raw: DataFrame, path: str) -> None:
    """Keep raw records (source, external_id, at, payload) as compressed JSON, a folder for each source and month; a month can be deleted at once."""
    raw.withColumn("month", F.date_format("at", "yyyy-MM")).write.mode("append").partitionBy("source", "month").option("compression", "gzip").json(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw records; filters on source and month prune folders. Of several with one id the last counts."""
    raw = spark.read.schema("external_id string, at timestamp, payload string, source string, month string").json(path)
    return raw.groupBy("source", "external_id").agg(F.max_by(F.struct("at", "payload", "month"), F.struct("at", "payload")).alias("x")).select("source", "external_id", "x.*")
