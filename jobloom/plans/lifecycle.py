"""Merge, sweep, miss and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.operators import lifecycle as L
from jobloom.plans.registry import query
from jobloom.plans.stats import ALIVE, P
from jobloom.sources import model as M
from jobloom.sources import postings_json as J
from jobloom.streaming.misses import windowed_counts

NEW = "new AS (SELECT source_id, external_id, salary_min * 2 AS salary_min, salary_max, expires_on FROM posting WHERE posting_id % 3 = 0 UNION ALL SELECT 99, 'new-' || external_id, salary_min, salary_max, expires_on FROM posting WHERE posting_id % 50 = 0)"


def batch(p):
    changed = p.where("posting_id % 3 = 0").select("source_id", "external_id", (F.col("salary_min") * 2).alias("salary_min"), "salary_max", "expires_on")
    return changed.union(p.where("posting_id % 50 = 0").select(F.lit(99).cast("long"), F.concat(F.lit("new-"), "external_id"), "salary_min", "salary_max", "expires_on"))


@query("s16_upsert", f"""{P}, {NEW} SELECT coalesce(n.source_id, p.source_id) AS source_id, coalesce(n.external_id, p.external_id) AS external_id, CASE WHEN n.source_id IS NULL THEN 'kept' WHEN p.source_id IS NULL THEN 'created' ELSE 'updated' END AS outcome,
 CASE WHEN n.source_id IS NULL THEN status WHEN n.expires_on < DATE '2000-06-15' THEN 'EXPIRED' ELSE 'OPEN' END AS status, CASE WHEN n.source_id IS NULL THEN miss_count ELSE 0 END AS miss_count, CASE WHEN n.source_id IS NULL THEN p.salary_min ELSE n.salary_min END AS salary_min, CASE WHEN n.source_id IS NULL THEN p.salary_max ELSE n.salary_max END AS salary_max
FROM posting p FULL JOIN new n ON p.source_id = n.source_id AND p.external_id = n.external_id""")
def s16(spark, sf):
    p = M.postings(spark, sf)
    return L.upsert(p, batch(p), F.lit("2000-06-15").cast("date"))


@query("w06_audit_diff", f"""{P}, {NEW} SELECT p.source_id, p.external_id, 'salary_min' AS field, CAST(p.salary_min AS VARCHAR) AS old_value, CAST(n.salary_min AS VARCHAR) AS new_value FROM posting p JOIN new n ON p.source_id = n.source_id AND p.external_id = n.external_id WHERE p.salary_min IS DISTINCT FROM n.salary_min""")
def w06(spark, sf):
    p = M.postings(spark, sf)
    return L.audit(p.select(*L.KEY, "salary_min", "salary_max"), batch(p), ["salary_min", "salary_max"])


@query("p10_deadline_sweep", f"{P} SELECT posting_id, status AS old_status, 'EXPIRED' AS new_status FROM posting WHERE {ALIVE} AND expires_on < DATE '2000-06-15'")
def p10(spark, sf):
    return L.deadline_sweep(M.postings(spark, sf), F.lit("2000-06-15").cast("date"))


@query("p14_probe_outcome", f"""{P} SELECT posting_id, CASE WHEN c IN (404, 410) THEN 'EXPIRED' WHEN c = 304 THEN r WHEN c <> 200 THEN status WHEN posting_id % 13 = 0 THEN 'EXPIRED' WHEN posting_id % 4 = 0 THEN 'EXPIRED' WHEN expires_on < DATE '2000-06-15' THEN 'EXPIRED' ELSE r END AS status
FROM (SELECT *, CASE posting_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 304 WHEN 2 THEN 503 ELSE 200 END AS c, CASE WHEN status = 'STALE' THEN 'OPEN' ELSE status END AS r FROM posting WHERE {ALIVE})""")
def p14(spark, sf):
    k = F.col("posting_id")
    code = F.when(k % 5 == 0, 404).when(k % 5 == 1, 304).when(k % 5 == 2, 503).otherwise(200)
    out = L.probe_outcome(code, k % 13 == 0, k % 4, F.col("expires_on"), F.col("status"), F.lit("2000-06-15").cast("date"))
    return M.postings(spark, sf).where(F.col("status").isin(M.ALIVE)).select("posting_id", out.alias("status"))


REAP_SQL = f"""{P} SELECT posting_id, CASE WHEN missed AND miss_count + 1 >= 3 THEN 'CLOSED' WHEN missed THEN 'STALE' ELSE status END AS status, CASE WHEN seen THEN 0 WHEN missed THEN miss_count + 1 ELSE miss_count END AS miss_count
FROM (SELECT *, posting_id % 4 = 1 AND source_id < 6 AS seen, NOT (posting_id % 4 = 1) AND source_id IN (SELECT DISTINCT source_id FROM posting WHERE posting_id % 4 = 1 AND source_id < 6) AND {ALIVE} AS missed FROM posting)"""


@query("w02_miss_counter", REAP_SQL)
def w02(spark, sf):
    p = M.postings(spark, sf)
    return L.reap_missing(p, p.where("posting_id % 4 = 1 and source_id < 6")).select("posting_id", "status", "miss_count")


@query("w01_high_water", "SELECT user_id AS source_id, max(ts) - INTERVAL 1 HOUR AS since FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1")
def w01(spark, sf):
    status = F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "view", "PARTIAL").otherwise("FAILED")
    return L.high_water(M.table(spark, sf, "events").select(F.col("user_id").alias("source_id"), status.alias("status"), F.col("ts").alias("finished_at")))


@query("w04_failure_streak", """WITH r AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS run FROM events),
g AS (SELECT user_id, bad, count(*) AS n FROM r GROUP BY user_id, bad, run) SELECT user_id, coalesce(max(n) FILTER (bad), 0) AS streak FROM g GROUP BY 1""")
def w04(spark, sf):
    return L.longest_streak(M.table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query("w07_dedupe_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def w07(spark, sf):
    return M.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("w08_rolling_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def w08(spark, sf):
    return windowed_counts(M.table(spark, sf, "events"))


@query("s09_quota", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 21")
def s09(spark, sf):
    return L.within_quota(M.table(spark, sf, "events"), "event_type", ["ts", "event_id"], 102, 5).select("event_type", "event_id")


@query("s06_best_block", "SELECT page_id, 'Job ' || page_id AS title FROM pages WHERE page_id % 3 > 0")
def s06(spark, sf):
    best = J.best_block(J.collect_postings(J.demo_pages(spark, sf)))
    return best.select("page_id", F.get_json_object("posting", "$.title").alias("title"))


@query("e06_missing_fields", "SELECT page_id, 'description,hiringOrganization,datePosted' AS missing FROM pages WHERE page_id % 3 > 0")
def e06(spark, sf):
    best = J.best_block(J.collect_postings(J.demo_pages(spark, sf)))
    return best.select("page_id", F.array_join(J.missing_fields(F.col("posting")), ",").alias("missing"))


@query("h09_company_merge", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'new-' || c_name END, c_mktsegment) AS website FROM customer")
def h09(spark, sf):
    c = M.table(spark, sf, "customer")
    given = c.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("new-"), "c_name").alias("given"))
    return c.join(given, "c_custkey", "left").select("c_custkey", F.coalesce("given", "c_mktsegment").alias("website"))


@query("h08_event_fold", "SELECT user_id, count(*) FILTER (event_type = 'view') AS seen, count(*) FILTER (event_type = 'purchase') AS job, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1")
def h08(spark, sf):
    kinds = {"seen": "view", "job": "purchase", "error": "error"}
    return M.table(spark, sf, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()])
