"""Joins with dimensions, companies' names, places' and skills' links, saved postings, probes and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.operators import lifecycle as L
from jobloom.operators import links as O
from jobloom.operators import search as Q
from jobloom.operators import stats
from jobloom.plans.registry import query
from jobloom.plans.stats import ALIVE, AS_OF_SQL, P, as_of
from jobloom.sources import model as M

AS_OF_DAY = "DATE '2000-06-15'"
ID = "posting_id"


def posts(spark, sf):
    return M.postings(spark, sf)


def today():
    return F.lit("2000-06-15").cast("date")


@query("j01_posting_with_dims", f"{P}, {M.SOURCE_SQL} SELECT posting_id, c_name AS company, s.source, n_name AS province FROM posting JOIN customer ON company_id = c_custkey JOIN source s USING (source_id) JOIN nation ON location_id = n_nationkey WHERE {ALIVE}")
def j01(spark, sf):
    c = M.table(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company"))
    p = posts(spark, sf).where(stats.alive()).drop("company")
    return p.join(c, "company_id").join(M.sources(spark, sf), "source_id").join(M.locations(spark, sf), "location_id").select(ID, "company", "source", "province")


@query("j03_company_counts", f"{P} SELECT c_custkey AS company_id, c_name AS company, count(*) AS n FROM posting JOIN customer ON company_id = c_custkey WHERE {ALIVE} GROUP BY 1, 2")
def j03(spark, sf):
    c = M.table(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"), "c_name")
    return posts(spark, sf).where(stats.alive()).groupBy("company_id").agg(F.count("*").alias("n")).join(c, "company_id").select("company_id", F.col("c_name").alias("company"), "n")


_ASKED = [3, 99, 1, 7]


@query("j07_lookup_drop_unmatched", f"SELECT pos, n_name AS name FROM (VALUES {', '.join(f'({i}, {x})' for i, x in enumerate(_ASKED))}) v(pos, id) JOIN nation ON n_nationkey = id")
def j07(spark, sf):
    asked = spark.createDataFrame(list(enumerate(_ASKED)), "pos int, location_id long")
    return asked.join(M.locations(spark, sf), "location_id").orderBy("pos").select("pos", F.col("province").alias("name"))


@query("h05_province_names", "SELECT posting_id, coalesce(n_name, 'nation_' || location) AS name FROM (SELECT o_orderkey AS posting_id, o_orderkey % 30 AS location FROM orders) LEFT JOIN nation ON n_nationkey = location")
def h05(spark, sf):
    asked = M.table(spark, sf, "orders").select(F.col("o_orderkey").alias(ID), (F.col("o_orderkey") % 30).alias("location_id"))
    return asked.join(M.locations(spark, sf), "location_id", "left").select(ID, F.coalesce("province", F.concat(F.lit("nation_"), F.col("location_id").cast("string"))).alias("name"))


@query("j10_seen_again", f"{P} SELECT posting_id, 0 AS miss_count FROM posting WHERE miss_count > 0 AND posting_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def j10(spark, sf):
    seen = M.table(spark, sf, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias(ID))
    return posts(spark, sf).where("miss_count > 0").join(seen, ID, "left_semi").select(ID, F.lit(0).alias("miss_count"))


def seen_companies(spark, sf):
    """Companies and names: a third are known by another name, a third by their slug, a third are new."""
    c = M.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("slug"), F.col("c_name").alias("name"), F.concat(F.lit("key "), F.lower("c_name")).alias("key"))
    none = F.lit(None).cast("string")
    companies = c.where("k % 3 < 2").select("slug", "name", F.when(F.col("k") % 2 == 0, "old.example").alias("website"), none.alias("logo_url"))
    names = c.where("k % 3 = 0").select("key", F.concat("slug", F.lit("-other")).alias("slug"))
    seen = c.select("key", "slug", F.concat("name", F.lit(" JSC")).alias("name"), F.when(F.col("k") % 4 == 0, "new.example").alias("website"), F.when(F.col("k") % 5 == 0, "logo.png").alias("logo_url"))
    return companies, names, seen.union(seen.where("website is null"))


_C = "c AS (SELECT c_custkey AS k, lower(replace(c_name, '#', '-')) AS slug, c_name AS name FROM customer)"


@query("h09_upsert_company", f"""WITH {_C} SELECT slug, CASE WHEN k % 3 < 2 THEN name ELSE name || ' JSC' END AS name, CASE WHEN k % 3 <> 0 AND k % 4 = 0 THEN 'new.example' WHEN k % 3 < 2 AND k % 2 = 0 THEN 'old.example' END AS website, CASE WHEN k % 3 <> 0 AND k % 5 = 0 THEN 'logo.png' END AS logo_url FROM c""")
def h09_upsert(spark, sf):
    return O.merge_companies(*seen_companies(spark, sf))[0]


@query("j11_company_alias", f"WITH {_C} SELECT 'key ' || lower(name) AS key, CASE WHEN k % 3 = 0 THEN slug || '-other' ELSE slug END AS company FROM c")
def j11(spark, sf):
    companies, names, seen = seen_companies(spark, sf)
    after = O.merge_companies(companies, names, seen)[1]
    return O.company_of(seen.select("key", "slug").distinct(), after).select("key", "company")


def location_links(spark, sf):
    """(links, postings, known): places declared by half of the postings, of which some are unknown; others are remote without one."""
    p = posts(spark, sf)
    place = F.struct(F.concat(F.lit("at "), F.col("location_id").cast("string")).alias("raw"), F.when(F.col(ID) % 5 != 0, F.concat(F.lit("n"), F.col("location_id").cast("string"))).alias("slug"))
    declared = p.select(ID, F.when(F.col(ID) % 2 == 0, F.array(place, place)).otherwise(F.array().cast("array<struct<raw:string,slug:string>>")).alias("locations"), F.when(F.col(ID) % 3 == 0, "REMOTE").otherwise("ONSITE").alias("work_mode"))
    links = p.where("posting_id % 4 = 0").select(ID, F.concat(F.lit("n"), F.col("location_id").cast("string")).alias("slug"), F.lit("old").alias("raw"))
    known = M.locations(spark, sf).where("location_id < 20").select(F.concat(F.lit("n"), F.col("location_id").cast("string")).alias("slug")).union(spark.createDataFrame([(O.REMOTE,)], "slug string"))
    return links, declared, known


@query("h11_link_locations", f"""{P}, d AS (SELECT posting_id, CASE WHEN posting_id % 2 = 0 AND posting_id % 5 <> 0 AND location_id < 20 THEN 'n' || location_id WHEN posting_id % 3 = 0 AND (posting_id % 2 = 1 OR posting_id % 5 = 0) THEN 'remote' END AS slug, CASE WHEN posting_id % 2 = 0 THEN 'at ' || location_id ELSE 'Làm từ xa' END AS raw FROM posting)
SELECT posting_id, slug, coalesce(d.raw, o.raw) AS raw FROM (SELECT * FROM d WHERE slug IS NOT NULL) d FULL JOIN (SELECT posting_id, 'n' || location_id AS slug, 'old' AS raw FROM posting WHERE posting_id % 4 = 0) o USING (posting_id, slug)""")
def h11(spark, sf):
    return O.link_locations(*location_links(spark, sf))


@query("h10_link_skills", f"""WITH {M.SKILL_SQL}, fresh AS (SELECT posting_id, lower(skill) AS slug, 'TEXT' AS origin FROM skill WHERE posting_id % 2 = 0 AND skill <> 'Brand#1') SELECT * FROM fresh UNION ALL SELECT posting_id, lower(skill), 'OLD' FROM skill WHERE posting_id % 2 = 1""")
def h10(spark, sf):
    s = M.posting_skills(spark, sf).select(ID, F.lower("skill").alias("slug"))
    old, found = s.withColumn("origin", F.lit("OLD")), s.where("posting_id % 2 = 0").withColumn("origin", F.lit("TEXT"))
    catalogue = M.table(spark, sf, "part").select(F.lower("p_brand").alias("slug")).distinct().where("slug <> 'brand#1'")
    return O.link_skills(old, found.union(found), posts(spark, sf).where("posting_id % 2 = 0"), catalogue)


def saved(spark, sf):
    """(user_id, posting_id, saved_at): what users bought is what they saved."""
    e = M.table(spark, sf, "events").where("event_type = 'purchase'")
    return e.groupBy("user_id", (F.col("event_id") % 1500).alias(ID)).agg(F.min("ts").alias("saved_at"))


_SAVED = "saved AS (SELECT user_id, event_id % 1500 AS posting_id, min(ts) AS saved_at FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)"


@query("j15_saved_postings", f"{P}, {_SAVED} SELECT user_id, posting_id, status, saved_at FROM saved JOIN posting USING (posting_id)")
def j15(spark, sf):
    return O.saved_postings(saved(spark, sf), posts(spark, sf)).select("user_id", ID, "status", "saved_at")


@query("m12_toggle_saved", f"""{P}, {_SAVED}, w AS (SELECT user_id, event_id % 1500 AS posting_id, arg_max(event_type = 'view', ts) AS save, max(ts) AS since FROM events WHERE event_type IN ('view', 'error') GROUP BY 1, 2),
k AS (SELECT * FROM saved s WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = s.user_id AND w.posting_id = s.posting_id AND NOT save)), n AS (SELECT user_id, posting_id, since AS saved_at FROM w WHERE save AND posting_id IN (SELECT posting_id FROM posting) AND NOT EXISTS (SELECT 1 FROM k WHERE w.user_id = k.user_id AND w.posting_id = k.posting_id)),
r AS (SELECT *, false AS new FROM k UNION ALL SELECT *, true FROM n) SELECT user_id, posting_id, saved_at FROM r QUALIFY NOT new OR row_number() OVER (PARTITION BY user_id ORDER BY new, saved_at, posting_id) <= 20""")
def m12(spark, sf):
    e = M.table(spark, sf, "events").where("event_type in ('view', 'error')")
    wishes = e.select("user_id", (F.col("event_id") % 1500).alias(ID), F.col("ts").alias("at"), (F.col("event_type") == "view").alias("save"))
    return O.toggle_saved(saved(spark, sf), wishes, posts(spark, sf))


@query("h07_save_context", f"WITH {_SAVED}, u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, count(posting_id) AS count, user_id % 3 <> 0 AND count(posting_id) < 20 AS can_save, user_id % 3 <> 0 AS can_unsave, CASE WHEN user_id % 3 = 0 THEN 'not-allowed' WHEN count(posting_id) >= 20 THEN 'full' END AS reason FROM u LEFT JOIN saved USING (user_id) GROUP BY user_id")
def h07(spark, sf):
    return O.save_context(saved(spark, sf), M.table(spark, sf, "events").select("user_id").distinct(), F.col("user_id") % 3 != 0)


@query("h12_saved_due", f"{P}, {_SAVED} SELECT posting_id FROM posting WHERE {ALIVE} AND (checked_on IS NULL OR CAST(checked_on AS TIMESTAMP) < {AS_OF_SQL} - INTERVAL 20 HOUR) AND posting_id IN (SELECT posting_id FROM saved)")
def h12(spark, sf):
    return O.saved_due(saved(spark, sf), posts(spark, sf).withColumn("checked_at", F.col("checked_on").cast("timestamp")), as_of()).select(ID)


def probes(p):
    k = F.col(ID)
    status = F.when(F.col("status") == "STALE", "OPEN").when(k % 6 == 0, "EXPIRED").otherwise(F.col("status"))
    return p.where("posting_id % 2 = 0").select(ID, status.alias("new_status"), F.when(k % 4 == 0, F.date_add("expires_on", 30)).alias("new_expires_on"))


_PROBED = f"{P}, r AS (SELECT *, CASE WHEN posting_id % 2 = 1 THEN status WHEN status = 'STALE' THEN 'OPEN' WHEN posting_id % 6 = 0 THEN 'EXPIRED' ELSE status END AS s2, CASE WHEN posting_id % 4 = 0 THEN expires_on + 30 ELSE expires_on END AS e2 FROM posting)"


@query("w05_revive_extend", f"{_PROBED} SELECT posting_id, s2 AS status, e2 AS expires_on, CASE WHEN posting_id % 2 = 0 AND s2 IN ('OPEN', 'STALE') THEN 0 ELSE miss_count END AS miss_count FROM r")
def w05(spark, sf):
    p = posts(spark, sf)
    return O.record_status(p, probes(p), as_of())[0].select(ID, "status", "expires_on", "miss_count")


@query("h12_status_audit", f"{_PROBED} SELECT posting_id, 'status' AS field, status AS old_value, s2 AS new_value FROM r WHERE status <> s2 UNION ALL SELECT posting_id, 'expires_on', CAST(expires_on AS VARCHAR), CAST(e2 AS VARCHAR) FROM r WHERE expires_on <> e2")
def h12_audit(spark, sf):
    p = posts(spark, sf)
    return O.record_status(p, probes(p), as_of())[1].drop("at")


@query("w03_sweep_scope", f"{P} SELECT posting_id FROM posting WHERE source_id IN (2, 3, 4, 5, 6, 7) OR (source_id = 1 AND regexp_matches(external_id, '[13579]$'))")
def w03(spark, sf):
    targets = spark.createDataFrame([(0, "query", None), (1, "url", "[13579]$")], "source_id long, kind string, pattern string")
    return O.sweep_scope(posts(spark, sf).withColumn("url", F.col("external_id")), targets).select(ID)


@query("w09_query_quota", f"{P} SELECT company_id, posting_id FROM posting QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY posted_at DESC, posting_id) <= 4")
def w09(spark, sf):
    return L.within_quota(posts(spark, sf), "company_id", [F.desc("posted_at"), ID], 10, 3).select("company_id", ID)


@query("u03_probe_queue", f"{P}, {_SAVED}, s AS (SELECT DISTINCT posting_id FROM saved) SELECT posting_id, posting_id IN (SELECT posting_id FROM s) AS saved FROM posting WHERE posting_id IN (SELECT posting_id FROM s) OR {ALIVE}")
def u03(spark, sf):
    p, s = posts(spark, sf), saved(spark, sf).select(ID).distinct()
    first = p.join(s, ID, "left_semi").select(ID, F.lit(True).alias("saved"))
    return first.unionByName(p.where(stats.alive()).join(s, ID, "left_anti").select(ID, F.lit(False).alias("saved")))


@query("n02_derived_status", f"{P} SELECT posting_id, CASE WHEN expires_on < {AS_OF_DAY} THEN 'EXPIRED' ELSE 'OPEN' END AS status FROM posting")
def n02(spark, sf):
    return posts(spark, sf).select(ID, L.derived_status(F.col("expires_on"), today()).alias("status"))


@query("n03_parse_status", f"{P} SELECT posting_id, CASE WHEN parse_status = 'OK' AND posting_id % 4 = 0 THEN 'PARTIAL' ELSE parse_status END AS parse_status FROM posting")
def n03(spark, sf):
    return posts(spark, sf).select(ID, L.parse_status(F.col("parse_status"), F.col(ID) % 4 == 0).alias("parse_status"))


@query("p12_projections", f"{P} SELECT posting_id, status, source_id, external_id, expires_on, checked_on FROM posting WHERE {ALIVE}")
def p12(spark, sf):
    return posts(spark, sf).where(stats.alive()).select(*Q.PROBE_COLUMNS)


@query("p13_request_filters", f"{P} SELECT posting_id FROM posting WHERE {ALIVE} AND level = 'SENIOR' AND source_id = 3 AND is_public")
def p13(spark, sf):
    f = Q.JobFilters.parse({"level": ["SENIOR", "x"], "source": "3", "salary": "on", "from": "junk", "page": "2"})
    return posts(spark, sf).where(Q.where(f, as_of())).select(ID)


@query("p15_probe_kind", f"{P} SELECT posting_id, CASE WHEN status = 'STALE' THEN 'OPEN' ELSE status END AS alive_status, CASE WHEN source_id = 2 THEN 'head' WHEN source_id % 2 = 0 THEN 'api' ELSE 'page' END AS kind FROM posting")
def p15(spark, sf):
    configured = F.when(F.col("source_id") == 2, "head")
    return posts(spark, sf).select(ID, L.alive_status(F.col("status")).alias("alive_status"), L.probe_kind(configured, F.when(F.col("source_id") % 2 == 0, "API").otherwise("SITEMAP")).alias("kind"))


@query("h01_find_jobs", f"{P}, f AS (SELECT posting_id, posted_at FROM posting WHERE {ALIVE} AND level = 'SENIOR') SELECT posting_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY posted_at DESC, posting_id LIMIT 20 OFFSET (SELECT 20 * ((greatest(1, count(*)) - 1) // 20) FROM f)")
def h01(spark, sf):
    total, page = Q.find(posts(spark, sf), Q.JobFilters(level="SENIOR"), None)
    return page.select(ID, F.lit(total).cast("long").alias("total"))


@query("h06_active_sources", f"WITH {M.SOURCE_SQL} SELECT source_id, source FROM source WHERE active")
def h06(spark, sf):
    return M.sources(spark, sf).where("active").orderBy("priority", "source_id").select("source_id", "source")


@query("h13_trigger", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'SCHEDULE' WHEN user_id % 2 = 0 THEN 'FULL' ELSE 'MANUAL' END AS \"trigger\" FROM events")
def h13(spark, sf):
    return M.table(spark, sf, "events").select("event_id", L.trigger(F.col("event_type") == "view", F.col("user_id") % 2 == 0).alias("trigger"))


@query("h14_hits_per_query", "SELECT event_type AS query, count(*) AS hits, count(*) FILTER (value > 60) AS kept FROM events GROUP BY 1")
def h14(spark, sf):
    return M.table(spark, sf, "events").groupBy(F.col("event_type").alias("query")).agg(F.count("*").alias("hits"), F.count_if(F.col("value") > 60).alias("kept"))


@query("w08_recent_windows", "WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) FILTER (ts > now - INTERVAL 24 HOUR) AS last_24h, count(*) FILTER (ts > now - INTERVAL 7 DAY) AS last_7d, count(*) FILTER (ts > now - INTERVAL 14 DAY AND ts <= now - INTERVAL 7 DAY) AS prev_7d FROM events, n GROUP BY 1")
def w08(spark, sf):
    e = M.table(spark, sf, "events")
    return stats.recent(e, "event_type", F.col("ts"), e.agg(F.max("ts")).scalar())


@query("a01_sources_and_last_run", f"WITH {M.SOURCE_SQL} SELECT (SELECT count(*) FROM source WHERE active) AS active_sources, (SELECT max(ts) FROM events WHERE event_type <> 'error') AS last_run")
def a01_sources(spark, sf):
    last = M.table(spark, sf, "events").where("event_type <> 'error'").agg(F.max("ts")).scalar()
    return M.sources(spark, sf).agg(F.count_if("active").alias("active_sources")).withColumn("last_run", last)


@query("h08_source_runs", """WITH r AS (SELECT user_id AS source_id, count(*) FILTER (event_type = 'view') AS seen, count(*) FILTER (event_type = 'purchase') AS jobs, count(*) FILTER (event_type = 'error') AS errors, max(ts) AS finished_at, arg_max(event_type, ts) FILTER (event_type = 'error') IS NOT NULL AS failed FROM events GROUP BY 1)
SELECT source_id, seen, jobs, errors, CASE WHEN jobs = 0 AND errors > 0 THEN 'FAILED' WHEN errors > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, CASE WHEN jobs > 0 OR errors = 0 THEN finished_at - INTERVAL 1 HOUR END AS since FROM r""")
def h08_runs(spark, sf):
    kinds = {"view": "seen", "purchase": "job", "error": "error"}
    known = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    events = M.table(spark, sf, "events").select(F.col("user_id").alias("source_id"), F.try_element_at(known, F.col("event_type")).alias("kind"), F.col("ts").alias("at"))
    return L.source_runs(events)
