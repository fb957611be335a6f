"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import classify as C
from jobloom.operators import report as R
from jobloom.operators import stats
from jobloom.plans.matching import TYPES
from jobloom.plans.registry import query
from jobloom.plans.stats import ALIVE, P
from jobloom.sources import model as M

_SHARE = "CAST(floor({n} * 100.0 / (SELECT count(*) FROM posting) + 0.5) AS BIGINT)"
_HEADS = {"companies": "count(DISTINCT company_id)", "public pay": "count(*) FILTER (is_public)", "places": "count(location_id)", "raw": "count(raw_key)", "partial": "count(*) FILTER (parse_status = 'PARTIAL')", "expired": "count(*) FILTER (status = 'EXPIRED')"}
_TOTALS = " UNION ALL ".join(f"SELECT 'total' AS section, '{k}' AS label, {e} AS n, {'NULL' if k in ('postings', 'companies') else _SHARE.format(n=e)} AS percent FROM posting" for k, e in {"postings": "count(*)", **_HEADS}.items())


@query("a14_inspect_report", f"""{P}, s AS (SELECT salary_min AS v, row_number() OVER (ORDER BY salary_min) - 1 AS i, count(*) OVER () AS m FROM posting WHERE is_public AND salary_min IS NOT NULL)
{_TOTALS} UNION ALL SELECT 'source', CAST(source_id AS VARCHAR), count(*), NULL FROM posting GROUP BY source_id
UNION ALL SELECT 'level', coalesce(level, '{R.UNKNOWN}'), count(*), {_SHARE.format(n='count(*)')} FROM posting GROUP BY level
UNION ALL (SELECT 'province', n_name, count(*), NULL FROM posting JOIN nation ON location_id = n_nationkey GROUP BY n_name ORDER BY count(*) DESC, n_name LIMIT 8)
UNION ALL SELECT 'pay', q, max(v) FILTER (i = floor(m * x)), NULL FROM s CROSS JOIN (VALUES ('p25', 0.25), ('p50', 0.5), ('p75', 0.75)) t(q, x) GROUP BY q
UNION ALL (SELECT 'recent', external_id, salary_min, NULL FROM posting ORDER BY posted_at DESC, posting_id DESC LIMIT 5)""")
def a14_report(spark, sf):
    return R.inspect_report(M.postings(spark, sf), M.locations(spark, sf))


@query("a23_even_sample", """WITH u AS (SELECT url, regexp_matches(url, '/(en|fr)/|[02468]$') AS kept, page_id FROM pages), n AS (SELECT kept, url, row_number() OVER (PARTITION BY kept ORDER BY page_id) - 1 AS place, count(*) OVER (PARTITION BY kept) AS of FROM u)
SELECT kept, url, place, of FROM n WHERE of <= 12 OR place IN (SELECT CAST(floor(i * (of / 12.0)) AS BIGINT) FROM range(12) r(i))""")
def a23_sample(spark, sf):
    return R.hit_sample(M.table(spark, sf, "pages").select("url", "page_id"), "url", "/(en|fr)/|[02468]$", [F.col("page_id")], 12)


@query("o08_source_places", f"WITH {M.SOURCE_SQL} SELECT source_id, row_number() OVER (ORDER BY active DESC, priority, source_id) AS place FROM source")
def o08_places(spark, sf):
    return R.placed(M.sources(spark, sf), [F.desc("active"), F.col("priority"), F.col("source_id")]).select("source_id", (F.col("place") + 1).alias("place"))


@query("j17_nested_runs", """WITH r AS (SELECT user_id AS run_id, min(ts) AS started_at FROM events GROUP BY 1 ORDER BY started_at DESC, run_id DESC LIMIT 10)
SELECT run_id, started_at, string_agg(event_id || ':' || event_type || ':' || coalesce(s_name, ''), ',' ORDER BY event_id) AS sources FROM r JOIN events e ON e.user_id = run_id LEFT JOIN supplier ON s_suppkey = event_id % 20 GROUP BY 1, 2""")
def j17_nested(spark, sf):
    e = M.table(spark, sf, "events")
    runs = e.groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("started_at"))
    parts = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), (F.col("event_id") % 20).alias("source_id"), "event_type")
    sources = M.sources(spark, sf).select("source_id", F.col("source").alias("code"), F.col("source").alias("name"))
    out = R.runs_with_sources(runs, parts, sources)
    shown = F.transform("sources", lambda x: F.concat_ws(":", x.id.cast("string"), x.event_type, F.coalesce(x["name"], F.lit(""))))
    return out.select("run_id", "started_at", F.array_join(shown, ",").alias("sources"))


@query("f11_similar_by_purchase", f"""{P}, t AS (SELECT p.*, CASE WHEN contains(' ' || k, ' bolt') THEN 'metal' WHEN contains(' ' || k, ' ring') THEN 'jewel' ELSE 'chua-ro' END AS kind
 FROM posting p JOIN (SELECT l_orderkey, trim(regexp_replace(lower(first(p_name ORDER BY l_linenumber, p_partkey) || ' ' || string_agg(p_name, ', ' ORDER BY l_linenumber, p_partkey)), '[^a-z0-9]+', ' ', 'g')) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_orderkey = posting_id WHERE {ALIVE}),
m AS (SELECT posting_id, kind FROM t ORDER BY posting_id LIMIT 1) SELECT posting_id, kind FROM t WHERE posting_id <> (SELECT posting_id FROM m) ORDER BY kind = (SELECT kind FROM m) DESC, posted_at DESC, posting_id LIMIT 3""")
def f11_purchase(spark, sf):
    """What is similar to the alive posting of the least id."""
    kind = C.purchase_type(F.lit(None).cast("string"), F.col("title"), F.col("description"), TYPES).slug
    items = M.postings(spark, sf).where(stats.alive()).join(M.posting_titles(spark, sf), "posting_id").withColumn("kind", kind)
    least = M.postings(spark, sf).where(stats.alive()).join(M.posting_titles(spark, sf).select("posting_id"), "posting_id", "left_semi").agg(F.min("posting_id")).first()[0]
    return R.similar(items, least, "kind", [F.desc("posted_at"), F.col("posting_id")]).select("posting_id", "kind")
