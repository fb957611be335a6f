"""Queries that run a stream over the given tables to its end, and merges into stored tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.operators import lifecycle as L
from jobloom.plans.lifecycle import NEW, batch
from jobloom.plans.registry import query
from jobloom.plans.stats import P
from jobloom.sources import crawl
from jobloom.sources import model as M
from jobloom.sources import postings_json as J
from jobloom.sources.store import BucketedTable, shared_folder
from jobloom.streaming.guard import FailureGuard
from jobloom.streaming.misses import SWEEPS, after_changes, run_stream, streamed_misses
from jobloom.streaming.windows import ROCKSDB, appended, sessions, sliding_counts, streaming_conf

AS_OF = "2000-06-15"


def events_stream(spark, sf):
    # A stream reads folders; a pattern may name a table that is one file.
    return spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/event[s].parquet")


def timed(events):
    """Watermarks go by instants."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def without_zone(windows):
    return windows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def merged(spark, sf):
    """The postings as a stored table, after a batch was merged into it."""
    p = M.postings(spark, sf)
    t = BucketedTable(spark, shared_folder(spark), L.KEY, 8, "source_id")
    t.create(p)
    t.merge(batch(p), lambda s, b: L.upsert_rows(s, b, F.lit(AS_OF).cast("date")))
    return t


@query("s16_merge_in_place", f"""{P}, {NEW} SELECT coalesce(n.source_id, p.source_id) AS source_id, coalesce(n.external_id, p.external_id) AS external_id, p.posting_id, p.level,
 CASE WHEN n.source_id IS NULL THEN status WHEN n.expires_on < DATE '{AS_OF}' THEN 'EXPIRED' ELSE 'OPEN' END AS status, CASE WHEN n.source_id IS NULL THEN miss_count ELSE 0 END AS miss_count,
 CASE WHEN n.source_id IS NULL THEN p.salary_min ELSE n.salary_min END AS salary_min, CASE WHEN n.source_id IS NULL THEN p.salary_max ELSE n.salary_max END AS salary_max, CASE WHEN n.source_id IS NULL THEN p.expires_on ELSE n.expires_on END AS expires_on
FROM posting p FULL JOIN new n ON p.source_id = n.source_id AND p.external_id = n.external_id""")
def s16(spark, sf):
    return merged(spark, sf).read().select(*L.KEY, "posting_id", "level", "status", "miss_count", "salary_min", "salary_max", "expires_on")


@query("s16_changes_of_a_merge", f"""{P}, {NEW}, j AS (SELECT p.source_id, p.external_id, p.status AS a, CASE WHEN n.expires_on < DATE '{AS_OF}' THEN 'EXPIRED' ELSE 'OPEN' END AS b, p.salary_min AS x, n.salary_min AS y FROM posting p JOIN new n ON p.source_id = n.source_id AND p.external_id = n.external_id)
SELECT source_id, external_id, 'salary_min' AS field, CAST(x AS VARCHAR) AS old_value, CAST(y AS VARCHAR) AS new_value FROM j WHERE x IS DISTINCT FROM y UNION ALL SELECT source_id, external_id, 'status', a, b FROM j WHERE a <> b""")
def s16_changes(spark, sf):
    return merged(spark, sf).changes(["salary_min", "status"])


@query("w02_keyed_misses", """WITH s AS (SELECT DISTINCT user_id % 5 AS source_id, 'u' || user_id AS external_id, CAST(ts AS DATE) AS day FROM events),
r AS (SELECT source_id, day, row_number() OVER (PARTITION BY source_id ORDER BY day) AS n, count(*) OVER (PARTITION BY source_id) AS all_n FROM (SELECT DISTINCT source_id, day FROM s)),
k AS (SELECT source_id, external_id, n, all_n, n - lag(n) OVER (PARTITION BY source_id, external_id ORDER BY n) - 1 AS gap FROM s JOIN r USING (source_id, day)),
g AS (SELECT source_id, external_id, coalesce(max(gap), 0) AS inside, any_value(all_n) - max(n) AS after FROM k GROUP BY ALL)
SELECT source_id, external_id, CASE WHEN greatest(inside, after) >= 3 THEN 'CLOSED' WHEN greatest(inside, after) >= 1 THEN 'STALE' ELSE 'OPEN' END AS status, CAST(CASE WHEN inside >= 3 THEN 0 ELSE least(after, 3) END AS INTEGER) AS miss_count FROM g""")
def w02_keyed(spark, sf):
    """Every user is a posting of one of five sources, seen on the days of its events; a day on which a source has any is a whole sweep."""
    e = M.table(spark, sf, "events").select((F.col("user_id") % 5).alias("source_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("external_id"), F.unix_date(F.col("ts").cast("date")).cast("long").alias("sweep")).distinct()
    folder = shared_folder(spark)
    e.union(e.select("source_id", F.lit(None).cast("string"), "sweep").distinct()).write.parquet(f"{folder}/in")
    with streaming_conf(spark, stateStore__providerClass=ROCKSDB):
        changes = appended(streamed_misses(spark.readStream.schema(SWEEPS).parquet(f"{folder}/in"), parts=4, ttl_days=None), folder)
    none = spark.createDataFrame([], "source_id long, external_id string, status string, miss_count int")
    return after_changes(none, changes)


_MARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS mark FROM events)"


@query("w08_sliding_stream", f"""SELECT start, start + INTERVAL 1 DAY AS "end", event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k FOR k IN range(4)]) AS start FROM events) GROUP BY ALL HAVING start + INTERVAL 1 DAY <= {_MARK}""")
def w08_sliding(spark, sf):
    return without_zone(appended(sliding_counts(timed(events_stream(spark, sf)), ["event_type"])))


@query("w08_session_stream", f"""WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {_MARK}""")
def w08_sessions(spark, sf):
    return without_zone(appended(sessions(timed(events_stream(spark, sf)), ["user_id"], "6 hours")))


@query("w04_guarded_stream", """WITH r AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT user_id AS source_id, CAST(coalesce(min(back) FILTER (NOT bad) - 1, count(*)) AS BIGINT) AS streak, count(*) AS written FROM r GROUP BY 1""")
def w04_guarded(spark, sf):
    """Every user's events are written by a guarded stream, an error is a failure; how many failures in a row each ends with."""
    folder = shared_folder(spark)
    rows = events_stream(spark, sf).select(F.col("user_id").alias("source_id"), "ts", "event_id", (F.col("event_type") == "error").alias("bad"))
    guard = FailureGuard(spark, f"{folder}/streaks", lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/rows/batch={i}"), order=("ts", "event_id"), limit=1000)
    run_stream(rows, guard, f"{folder}/progress")
    written = spark.read.parquet(f"{folder}/rows").groupBy("source_id").agg(F.count("*").alias("written"))
    return guard.streaks().join(written, "source_id")


@query("s05_postings_format", """WITH p AS (SELECT page_id, 's' || page_id % 3 AS source, 'https://p.example/' || CASE WHEN page_id % 13 = 12 THEN 'about/' ELSE '' END || page_id AS url, page_id % 13 = 12 AS out FROM pages),
n AS (SELECT *, sum(CAST(NOT out AS INT)) OVER (PARTITION BY source ORDER BY page_id) AS k FROM p)
SELECT source, url, 'skipped' AS kind, CAST(NULL AS VARCHAR) AS title, 'excluded' AS message FROM n WHERE out UNION ALL SELECT source, url, 'seen', NULL, NULL FROM n WHERE NOT out
UNION ALL SELECT source, url, CASE WHEN page_id % 11 = 0 THEN 'error' WHEN page_id % 3 = 0 THEN 'skipped' ELSE 'job' END, CASE WHEN page_id % 11 > 0 AND page_id % 3 > 0 THEN 'Job ' || page_id END, CASE WHEN page_id % 11 = 0 THEN 'HTTP 404' WHEN page_id % 3 = 0 THEN 'no posting' END FROM n WHERE NOT out AND k <= 60""")
def s05_format(spark, sf):
    """The pages as three sources with a budget of 60 pages each, read by their own format."""
    k = F.col("page_id")
    url = F.concat(F.lit("https://p.example/"), F.when(k % 13 == 12, "about/").otherwise(""), k.cast("string"))
    rows = J.demo_pages(spark, sf).select("page_id", F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), url.alias("url"), F.when(k % 11 == 0, 404).otherwise(200).alias("status"), "html")
    folder = shared_folder(spark)
    crawl.write_pages(rows, f"{folder}/pages", "page_id")
    crawl.register(spark)
    out = spark.read.format("postings").option("path", f"{folder}/pages").option("maxDetailPages", "60").option("excludePatterns", '["/about/"]').load()
    return out.select("source", "url", "kind", F.get_json_object("posting", "$.title").alias("title"), "message")


_TAKE = lambda name, query, before: f"{name} AS (SELECT user_id, '{query}' AS query FROM (SELECT user_id, min(rn) AS first FROM e WHERE event_type = '{query}' {before} GROUP BY 1) ORDER BY first LIMIT 20)"


@query("s09_search_stream", f"""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
{_TAKE('a', 'view', '')}, {_TAKE('b', 'click', 'AND user_id NOT IN (SELECT user_id FROM a)')}, {_TAKE('c', 'purchase', 'AND user_id NOT IN (SELECT user_id FROM a UNION ALL SELECT user_id FROM b)')}
SELECT CAST(user_id AS VARCHAR) AS external_id, query FROM (FROM a UNION ALL FROM b UNION ALL FROM c)""")
def s09_stream(spark, sf):
    """Events as answers to a search for each type, fifty records a page, users as postings: what three searches with a budget of 60 take."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = M.table(spark, sf, "events").where("event_type in ('view', 'click', 'purchase')").select("event_type", (F.row_number().over(w) - 1).alias("n"), F.struct(F.col("user_id").alias("jobId"), F.concat(F.lit("https://p.example/"), F.col("user_id").cast("string")).alias("jobUrl")).alias("r"))
    pages = e.groupBy(F.col("event_type").alias("query"), F.floor(F.col("n") / 50).cast("int").alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "r"))), lambda x: x.r).alias("data"))
    folder = shared_folder(spark)
    pages.select("query", "page", F.lit(200).alias("status"), F.to_json(F.struct("data")).alias("body")).write.parquet(f"{folder}/answers")
    # The pages of a query end with one that has no records.
    ends = pages.groupBy("query").agg((F.max("page") + 1).alias("page")).select("query", "page", F.lit(200).alias("status"), F.lit('{"data":[]}').alias("body"))
    ends.write.mode("append").parquet(f"{folder}/answers")
    crawl.register(spark)
    found = appended(spark.readStream.format("search_pages").option("path", f"{folder}/answers").option("queries", json.dumps(["view", "click", "purchase"])).option("maxJobs", "60").load(), folder)
    return found.where("kind = 'job'").select("external_id", "query")
