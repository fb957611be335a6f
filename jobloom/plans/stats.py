"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import classify as C
from jobloom.functions import salary as S
from jobloom.operators import facets, stats
from jobloom.plans.registry import query
from jobloom.sources import model as M

AS_OF_SQL = "TIMESTAMP '2000-06-15'"
ALIVE = "status IN ('OPEN', 'STALE')"
SHOWN = "is_public AND (salary_min IS NOT NULL OR salary_max IS NOT NULL)"
VALUE = "coalesce(CAST(salary_min + salary_max AS DOUBLE) / 2, CAST(salary_min AS DOUBLE), CAST(salary_max AS DOUBLE))"
P = "WITH " + M.POSTING_SQL


def as_of():
    return F.lit("2000-06-15").cast("timestamp")


def quart(v: str) -> str:
    return ", ".join(f"CAST(round_even(quantile_cont({v}, {q}), 0) AS BIGINT) AS {n}" for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))


@query("a01_overview", f"""{P}
SELECT count(*) FILTER (status = 'OPEN') AS open, count(*) FILTER (status = 'STALE') AS stale, count(*) FILTER (status = 'EXPIRED') AS expired, count(*) FILTER (status = 'CLOSED') AS closed,
  count(*) FILTER ({ALIVE}) AS alive, count(*) FILTER ({ALIVE} AND {SHOWN}) AS with_salary, count(DISTINCT CASE WHEN {ALIVE} THEN company_id END) AS companies, count(DISTINCT CASE WHEN {ALIVE} THEN source_id END) AS live_sources,
  count(*) FILTER (posted_at >= {AS_OF_SQL} AND posted_at < {AS_OF_SQL} + INTERVAL 1 DAY) AS posted_today, count(*) FILTER ({ALIVE} AND posted_at >= {AS_OF_SQL} - INTERVAL 1 DAY AND posted_at < {AS_OF_SQL}) AS last_24h,
  count(*) FILTER (posted_at >= {AS_OF_SQL} - INTERVAL 7 DAY AND posted_at < {AS_OF_SQL}) AS last_7d, count(*) FILTER (posted_at >= {AS_OF_SQL} - INTERVAL 14 DAY AND posted_at < {AS_OF_SQL} - INTERVAL 7 DAY) AS prev_7d, max(checked_on) AS last_check
FROM posting""")
def a01(spark, sf):
    return stats.overview(M.postings(spark, sf), as_of())


@query("a02_daily_intake", f"""{P}, n AS (SELECT CAST(posted_at + INTERVAL 7 HOUR AS DATE) AS day, count(*) AS n FROM posting GROUP BY 1)
SELECT s.day, coalesce(n, 0) AS n FROM (SELECT CAST(generate_series AS DATE) AS day FROM generate_series(DATE '2000-06-15' - 29, DATE '2000-06-15', INTERVAL 1 DAY)) s LEFT JOIN n USING (day)""")
def a02(spark, sf):
    return stats.daily_intake(M.postings(spark, sf), F.lit("2000-06-15").cast("date"), 30)


FACET = "CASE WHEN is_public THEN nullif(greatest(coalesce(salary_min, 0), coalesce(salary_max, 0)), 0) END"


@query("a03_salary_by_level", f"""{P}
SELECT level, count(v) AS sample, count(*) AS total, {quart('v')} FROM (SELECT level, CASE WHEN {SHOWN} THEN {VALUE} END AS v FROM posting WHERE {ALIVE} AND level IS NOT NULL) GROUP BY level HAVING count(v) >= 3""")
def a03(spark, sf):
    return stats.salary_by(M.postings(spark, sf), "level")


@query("a03_salary_by_level_refined", f"""{P}
SELECT level, count(v) AS sample, count(*) AS total, {quart('v')} FROM (SELECT level, CASE WHEN {SHOWN} THEN {VALUE} END AS v FROM posting WHERE {ALIVE} AND level IS NOT NULL) GROUP BY level HAVING count(v) >= 3""")
def a03_refined(spark, sf):
    return stats.salary_by_refined(M.postings(spark, sf), "level")


@query("a18_medians_refined", f"""{P}, {M.SKILL_SQL}
SELECT skill, level, count({FACET}) AS n, quantile_cont(CAST({FACET} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({FACET} AS DOUBLE), 0.9) AS p90 FROM posting JOIN skill USING (posting_id) WHERE {ALIVE} GROUP BY 1, 2""")
def a18_refined(spark, sf):
    p = M.postings(spark, sf).where(stats.alive()).select("posting_id", "level", S.facet_value(F.col("is_public"), F.col("salary_min"), F.col("salary_max")).alias("v"))
    return stats.quantiles(p.join(M.posting_skills(spark, sf), "posting_id"), ["skill", "level"], "v", {"median": 0.5, "p90": 0.9})


@query("a04_salary_overall", f"{P} SELECT count(v) AS sample, {quart('v')} FROM (SELECT CASE WHEN {SHOWN} THEN {VALUE} END AS v FROM posting WHERE {ALIVE})")
def a04(spark, sf):
    return stats.salary_overall(M.postings(spark, sf))


PROVINCE_SQL = f"""SELECT n_name AS province, count(*) AS total, count(*) FILTER (is_public) AS sample, CAST(round_even(quantile_cont(CASE WHEN is_public THEN {VALUE} END, 0.5), 0) AS BIGINT) AS p50
FROM posting JOIN nation ON location_id = n_nationkey WHERE {ALIVE} GROUP BY 1 HAVING count(*) FILTER (is_public) >= 3"""


@query("a05_salary_by_province", f"{P} {PROVINCE_SQL} ORDER BY total DESC, province LIMIT 10")
def a05(spark, sf):
    return stats.salary_by_province(M.postings(spark, sf), M.locations(spark, sf))


@query("a06_salary_histogram", f"""{P}, b AS (SELECT CAST(least(floor({VALUE} / 5000000) * 5000000, 60000000) AS BIGINT) AS bucket, count(*) AS n FROM posting WHERE {ALIVE} AND {SHOWN} AND {VALUE} > 0 GROUP BY 1)
SELECT s.bucket, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 60000001, 5000000)) AS bucket) s LEFT JOIN b USING (bucket)""")
def a06(spark, sf):
    return stats.salary_histogram(M.postings(spark, sf))


@query("a07_top_provinces", f"{P} SELECT n_name AS province, count(*) AS n, count(*) FILTER ({SHOWN}) AS with_salary FROM posting JOIN nation ON location_id = n_nationkey WHERE {ALIVE} GROUP BY 1 ORDER BY n DESC, province LIMIT 10")
def a07(spark, sf):
    return stats.top(M.postings(spark, sf).join(M.locations(spark, sf), "location_id"), "province")


@query("a08_top_companies", f"{P} SELECT company, count(*) AS n, count(*) FILTER ({SHOWN}) AS with_salary FROM posting WHERE {ALIVE} GROUP BY 1 ORDER BY n DESC, company LIMIT 10")
def a08(spark, sf):
    return stats.top(M.postings(spark, sf), "company")


@query("a09_level_spread", f"{P} SELECT coalesce(level, 'UNKNOWN') AS level, count(*) AS n FROM posting WHERE {ALIVE} GROUP BY 1")
def a09(spark, sf):
    return stats.level_spread(M.postings(spark, sf))


@query("a10_filter_options", f"""{P}
SELECT 'level' AS kind, level AS value, count(*) AS n FROM posting WHERE {ALIVE} AND level IS NOT NULL GROUP BY 2
UNION ALL (SELECT 'province', n_name, count(*) AS n FROM posting JOIN nation ON location_id = n_nationkey WHERE {ALIVE} GROUP BY 2 ORDER BY n DESC, n_name LIMIT 20)
UNION ALL SELECT 'source', s_name, count(*) FROM posting JOIN supplier ON source_id = s_suppkey WHERE {ALIVE} GROUP BY 2""")
def a10(spark, sf):
    p = M.postings(spark, sf).where(stats.alive())
    count = lambda rows, kind, c: rows.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
    provinces = count(p.join(M.locations(spark, sf), "location_id"), "province", "province").orderBy(F.desc("n"), "value").limit(20)
    return count(p.where("level is not null"), "level", "level").union(provinces).union(count(p.join(M.sources(spark, sf), "source_id"), "source", "source"))


@query("a11_source_health", f"""{P}, {M.SOURCE_SQL}
SELECT s.source_id, source, count(*) FILTER ({ALIVE}) AS alive, count(posting_id) AS total, count(*) FILTER ({ALIVE} AND {SHOWN}) AS with_salary, count(*) FILTER (parse_status = 'FAILED') AS failed, max(checked_on) AS last_seen
FROM source s LEFT JOIN posting USING (source_id) GROUP BY 1, 2""")
def a11(spark, sf):
    return stats.source_health(M.postings(spark, sf), M.sources(spark, sf))


@query("a12_parse_health", f"{P} SELECT count(*) FILTER (parse_status = 'OK') AS ok, count(*) FILTER (parse_status = 'PARTIAL') AS partial, count(*) FILTER (parse_status = 'FAILED') AS failed FROM posting")
def a12(spark, sf):
    return M.postings(spark, sf).agg(*[F.count_if(F.col("parse_status") == s).alias(s.lower()) for s in ("OK", "PARTIAL", "FAILED")])


@query("a13_reparse_coverage", f"{P} SELECT count(raw_key) AS with_raw, count(*) AS total FROM posting")
def a13(spark, sf):
    return M.postings(spark, sf).agg(F.count("raw_key").alias("with_raw"), F.count("*").alias("total"))


@query("a14_inspect_nearest_rank", f"""{P}, v AS (SELECT source_id, salary_min AS v, row_number() OVER (PARTITION BY source_id ORDER BY salary_min) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS n FROM posting WHERE {ALIVE} AND is_public AND salary_min IS NOT NULL)
SELECT source_id, max(n) AS n, max(v) FILTER (i = floor(n * 0.5)) AS p50, max(v) FILTER (i = floor(n * 0.9)) AS p90 FROM v GROUP BY 1""")
def a14(spark, sf):
    p = M.postings(spark, sf).where(stats.alive() & F.col("is_public") & F.col("salary_min").isNotNull())
    return stats.nearest_rank(p, "source_id", "salary_min", {"p50": 0.5, "p90": 0.9})




@query("a15_median_by_level", f"{P} SELECT level, count(v) AS n, CAST(floor(quantile_cont(CAST(v AS DOUBLE), 0.5) + 0.5) AS BIGINT) AS median FROM (SELECT level, {FACET} AS v FROM posting WHERE {ALIVE}) GROUP BY 1")
def a15(spark, sf):
    v = S.facet_value(F.col("is_public"), F.col("salary_min"), F.col("salary_max"))
    return M.postings(spark, sf).where(stats.alive()).groupBy("level").agg(F.count(v).alias("n"), stats.median(v).alias("median"))


YEARS = "CASE WHEN years_min < 1 THEN '0' WHEN years_min <= 2 THEN '1-2' WHEN years_min <= 5 THEN '3-5' WHEN years_min > 5 THEN '5+' ELSE '__none' END"
PAY = f"CASE WHEN {FACET} < 15000000 THEN '0-15' WHEN {FACET} < 25000000 THEN '15-25' WHEN {FACET} < 40000000 THEN '25-40' WHEN {FACET} IS NOT NULL THEN '40+' ELSE '__none' END"


@query("a16_field_stats_experience", f"""{P}, g AS (SELECT {YEARS} AS band, count(*) AS n, CAST(floor(quantile_cont(CAST({FACET} AS DOUBLE), 0.5) + 0.5) AS BIGINT) AS median FROM posting WHERE {ALIVE} GROUP BY 1)
SELECT s.band, coalesce(n, 0) AS n, median FROM (VALUES ('0'), ('1-2'), ('3-5'), ('5+')) s(band) LEFT JOIN g USING (band)""")
def a16(spark, sf):
    v = S.facet_value(F.col("is_public"), F.col("salary_min"), F.col("salary_max"))
    per = M.postings(spark, sf).where(stats.alive()).groupBy(C.experience_band(F.col("years_min")).alias("band")).agg(F.count("*").alias("n"), stats.median(v).alias("median"))
    return spark.createDataFrame([(b,) for b in C.EXPERIENCE_BANDS[:4]], "band string").join(per, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"), "median")


@query("a17_coverage", f"{P} SELECT count(*) AS total, count({FACET}) AS salary, count(level) AS level, count(years_min) AS years, count(work_mode) AS work_mode, count(checked_on) AS checked, count(raw_key) AS raw FROM posting WHERE {ALIVE}")
def a17(spark, sf):
    p = M.postings(spark, sf).where(stats.alive()).withColumn("salary", S.facet_value(F.col("is_public"), F.col("salary_min"), F.col("salary_max")))
    return p.agg(F.count("*").alias("total"), F.count("salary").alias("salary"), F.count("level").alias("level"), F.count("years_min").alias("years"), F.count("work_mode").alias("work_mode"), F.count("checked_on").alias("checked"), F.count("raw_key").alias("raw"))


@query("a18_median_salary_by_skill", f"""{P}, {M.SKILL_SQL}
SELECT skill, count(*) AS n, count({FACET}) AS sample, CAST(floor(quantile_cont(CAST({FACET} AS DOUBLE), 0.5) + 0.5) AS BIGINT) AS median FROM posting JOIN skill USING (posting_id) WHERE {ALIVE} GROUP BY 1 HAVING count({FACET}) >= 5 ORDER BY median DESC, skill LIMIT 8""")
def a18(spark, sf):
    p = M.postings(spark, sf).where(stats.alive()).select("posting_id", S.facet_value(F.col("is_public"), F.col("salary_min"), F.col("salary_max")).alias("v"))
    return stats.median_by_skill(p.join(M.posting_skills(spark, sf), "posting_id"))


@query("a19_dictionary_report", f"""WITH {M.TITLE_SQL}, t AS (SELECT posting_id, ' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS k FROM title),
s AS (SELECT term, kind, pos FROM (VALUES ('ring', 'strong', 0), ('gear', 'strong', 1), ('bolt', 'strong', 2), ('nothing', 'strong', 3), ('small', 'exclude', 0), ('old', 'exclude', 1)) v(term, kind, pos)),
h AS (SELECT posting_id, term, kind, pos FROM t JOIN s ON contains(k, ' ' || term)),
b AS (SELECT posting_id, arg_min(term, pos) AS term FROM h WHERE kind = 'exclude' GROUP BY 1),
n AS (SELECT 'strong' AS kind, term, count(*) AS n FROM h WHERE kind = 'strong' AND posting_id NOT IN (SELECT posting_id FROM b) GROUP BY 2
      UNION ALL SELECT 'exclude', term, count(*) FROM b WHERE posting_id IN (SELECT posting_id FROM h WHERE kind = 'strong') GROUP BY 2)
SELECT s.kind, s.term, coalesce(n, 0) AS n FROM s LEFT JOIN n ON s.kind = n.kind AND s.term = n.term""")
def a19(spark, sf):
    from jobloom.functions.text import match_key

    strong, excludes = ["ring", "gear", "bolt", "nothing"], ["small", "old"]
    k = match_key(F.col("title"))
    rows = M.posting_titles(spark, sf).select(C.terms_hit(k, strong).alias("s"), F.try_element_at(C.terms_hit(k, excludes), F.lit(1)).alias("x"))
    hits = F.when(F.col("x").isNull(), F.transform("s", lambda t: F.struct(F.lit("strong").alias("kind"), t.alias("term")))).when(F.size("s") > 0, F.array(F.struct(F.lit("exclude").alias("kind"), F.col("x").alias("term"))))
    per = rows.select(F.inline(hits)).groupBy("kind", "term").agg(F.count("*").alias("n"))
    spine = spark.createDataFrame([("strong", t) for t in strong] + [("exclude", t) for t in excludes], "kind string, term string")
    return spine.join(per, ["kind", "term"], "left").select("kind", "term", F.coalesce("n", F.lit(0)).alias("n"))


RUN_SQL = "run AS (SELECT user_id AS run_id, event_type <> 'error' AS ok, event_id % 7 AS seen, CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error FROM events)"


@query("a21_run_rollup", f"""WITH {RUN_SQL} SELECT run_id, CAST(sum(seen) AS BIGINT) AS seen, CASE WHEN count(*) FILTER (NOT ok) = count(*) THEN 'FAILED' WHEN count(*) FILTER (NOT ok) > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, coalesce(string_agg(error, chr(10) ORDER BY error), '') AS errors FROM run GROUP BY 1""")
def a21(spark, sf):
    e = M.table(spark, sf, "events")
    bad = F.col("event_type") == "error"
    return stats.run_rollup(e.select(F.col("user_id").alias("run_id"), (~bad).alias("ok"), (F.col("event_id") % 7).alias("seen"), F.when(bad, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error")))


@query("a22_top_band_share", f"{P}, b AS (SELECT {PAY} AS band, count(*) AS n FROM posting WHERE {ALIVE} AND {FACET} IS NOT NULL GROUP BY 1) SELECT arg_max(band, n) AS band, max(n) AS n, CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS share FROM b")
def a22(spark, sf):
    v = S.facet_value(F.col("is_public"), F.col("salary_min"), F.col("salary_max"))
    per = M.postings(spark, sf).where(stats.alive() & v.isNotNull()).groupBy(C.salary_band(v).alias("band")).agg(F.count("*").alias("n"))
    return per.agg(F.max_by("band", "n").alias("band"), F.max("n").alias("n"), (F.max("n").cast("double") / F.sum("n").cast("double")).alias("share"))


@query("a23_pattern_hit_rate", """SELECT pattern, count(*) FILTER (regexp_matches(url, pattern)) AS kept, count(*) AS total FROM pages CROSS JOIN (VALUES ('^https'), ('/en/'), ('example\\.org')) p(pattern) GROUP BY 1""")
def a23(spark, sf):
    patterns = ["^https", "/en/", r"example\.org"]
    counts = M.table(spark, sf, "pages").agg(*[F.count_if(F.col("url").rlike(p)).alias(f"k{i}") for i, p in enumerate(patterns)], F.count("*").alias("total"))
    return counts.select("total", F.inline(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"k{i}").alias("kept")) for i, p in enumerate(patterns)])))


CHOSEN = {"level": ["SENIOR", "MID"], "work_mode": ["REMOTE"], "pay": ["40+"], "years": []}
FACET_ROWS = f"rows AS (SELECT posting_id, level, work_mode, {PAY} AS pay, {YEARS} AS years FROM posting WHERE {ALIVE})"
_OK = {"level": "coalesce(level, '__none') IN ('SENIOR', 'MID')", "work_mode": "coalesce(work_mode, '__none') IN ('REMOTE')", "pay": "pay IN ('40+')", "years": "TRUE"}


def facet_rows(spark, sf):
    v = S.facet_value(F.col("is_public"), F.col("salary_min"), F.col("salary_max"))
    return M.postings(spark, sf).where(stats.alive()).select("posting_id", "level", "work_mode", C.salary_band(v).alias("pay"), C.experience_band(F.col("years_min")).alias("years"))


@query("f02_facets_self_excluding", f"{P}, {FACET_ROWS} " + " UNION ALL ".join(f"SELECT '{d}' AS dim, coalesce({d}, '__none') AS value, count(*) AS n FROM rows WHERE {' AND '.join(v for k, v in _OK.items() if k != d)} GROUP BY 2" for d in _OK))
def f02(spark, sf):
    return facets.self_excluding(facet_rows(spark, sf), CHOSEN)


@query("f04_bands_zero_kept", f"{P}, {FACET_ROWS} SELECT s.pos, s.band, coalesce(n, 0) AS n FROM (VALUES (0, '0-15'), (1, '15-25'), (2, '25-40'), (3, '40+'), (4, '__none')) s(pos, band) LEFT JOIN (SELECT pay AS band, count(*) AS n FROM rows GROUP BY 1) USING (band)")
def f04(spark, sf):
    return facets.banded(facet_rows(spark, sf), F.col("pay"), C.SALARY_BANDS)


@query("f05_levels_in_order", f"{P}, {FACET_ROWS} SELECT s.pos, s.band, coalesce(n, 0) AS n FROM (VALUES {', '.join(str((i, x)) for i, x in enumerate(C.LEVEL_ORDER))}) s(pos, band) LEFT JOIN (SELECT level AS band, count(*) AS n FROM rows GROUP BY 1) USING (band)")
def f05(spark, sf):
    return facets.banded(facet_rows(spark, sf), F.col("level"), C.LEVEL_ORDER)


@query("f06_skill_facets", f"{P}, {M.SKILL_SQL} SELECT skill, count(*) AS n FROM posting JOIN skill USING (posting_id) WHERE {ALIVE} GROUP BY 1")
def f06(spark, sf):
    return M.postings(spark, sf).where(stats.alive()).select("posting_id").join(M.posting_skills(spark, sf), "posting_id").groupBy("skill").agg(F.count("*").alias("n"))


@query("f09_relax_hints", f"""{P}, {FACET_ROWS}, c AS (SELECT count(*) FILTER (level IN ('LEAD') AND work_mode IN ('REMOTE')) AS total, count(*) FILTER (work_mode IN ('REMOTE')) AS a, count(*) FILTER (level IN ('LEAD')) AS b FROM rows)
SELECT * FROM (SELECT 'level' AS dim, a AS n FROM c WHERE total = 0 UNION ALL SELECT 'work_mode', b FROM c WHERE total = 0) WHERE n > 0""")
def f09(spark, sf):
    return facets.relax_hints(facet_rows(spark, sf), {"level": ["LEAD"], "work_mode": ["REMOTE"], "years": []})


@query("f12_funnel", f"""{P}, {M.TITLE_SQL}, t AS (SELECT *, ' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS k FROM posting JOIN title USING (posting_id) WHERE {ALIVE})
SELECT count(*) AS scanned, count(*) FILTER (location_id >= 20) AS dropped_by_place, count(*) FILTER (location_id < 20 AND (contains(k, ' ring') OR contains(k, ' gear'))) AS accepted, count(*) FILTER (location_id < 20 AND (contains(k, ' ring') OR contains(k, ' gear')) AND level = 'SENIOR') AS in_view FROM t""")
def f12(spark, sf):
    from jobloom.functions.text import match_key

    t = M.postings(spark, sf).where(stats.alive()).join(M.posting_titles(spark, sf), "posting_id")
    near, hit = F.col("location_id") < 20, F.size(C.terms_hit(match_key(F.col("title")), ["ring", "gear"])) > 0
    return t.agg(F.count("*").alias("scanned"), F.count_if(~near).alias("dropped_by_place"), F.count_if(near & hit).alias("accepted"), F.count_if(near & hit & (F.col("level") == "SENIOR")).alias("in_view"))


@query("x01_salary_rollup", f"""{P} SELECT level, n_name AS province, count(*) AS n, CAST(round_even(quantile_cont({VALUE}, 0.5), 0) AS BIGINT) AS p50 FROM posting JOIN nation ON location_id = n_nationkey WHERE {ALIVE} AND {SHOWN} GROUP BY GROUPING SETS ((level), (n_name), ())""")
def x01(spark, sf):
    p = M.postings(spark, sf).where(stats.alive() & stats.disclosed()).join(M.locations(spark, sf), "location_id")
    return p.groupingSets([["level"], ["province"], []], "level", "province").agg(F.count("*").alias("n"), stats.quantile(0.5, stats.value()).alias("p50"))
