"""Filters, joins, orders, pages and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.functions.text import match_key, step
from jobloom.operators import search as Q
from jobloom.operators import stats
from jobloom.plans.registry import query
from jobloom.plans.stats import ALIVE, AS_OF_SQL, FACET, P, as_of
from jobloom.sources import model as M

FULL = f"{P}, {M.TITLE_SQL}, f AS (SELECT posting.*, n_name AS province, title, description FROM posting JOIN nation ON location_id = n_nationkey LEFT JOIN title USING (posting_id))"


def full(spark, sf):
    return M.postings(spark, sf).join(M.locations(spark, sf).select("location_id", "province"), "location_id").join(M.posting_titles(spark, sf), "posting_id", "left")


@query("p01_search", f"""{FULL} SELECT posting_id, title, province FROM f WHERE {ALIVE} AND (contains(lower(title), 'ring') OR contains(lower(description), 'ring') OR contains(lower(company), 'ring')) AND level = 'SENIOR' AND is_public AND (salary_min >= 100000000 OR salary_max >= 100000000) AND posted_at >= {AS_OF_SQL} - INTERVAL 2000 DAY""")
def p01(spark, sf):
    f = Q.JobFilters(q="ring", level="SENIOR", salary_only=True, salary_from=100_000_000, posted_within=2000)
    return full(spark, sf).where(Q.where(f, as_of())).select("posting_id", "title", "province")


@query("p02_text_search", f"{FULL} SELECT posting_id FROM f WHERE {ALIVE} AND (contains(lower(title), 'hot gear') OR contains(lower(description), 'hot gear') OR contains(lower(company), 'hot gear'))")
def p02(spark, sf):
    return full(spark, sf).where(Q.where(Q.JobFilters(q="Hot Gear"))).select("posting_id")


@query("p03_salary_floor", f"{P} SELECT posting_id FROM posting WHERE {ALIVE} AND (salary_min >= 300000000 OR salary_max >= 300000000)")
def p03(spark, sf):
    return M.postings(spark, sf).where(Q.where(Q.JobFilters(salary_from=300_000_000))).select("posting_id")


@query("p04_scope", f"{P} SELECT posting_id FROM posting WHERE {ALIVE} AND location_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2)) AND posted_at >= {AS_OF_SQL} - INTERVAL 365 DAY AND level IN ('SENIOR', 'MID')")
def p04(spark, sf):
    near = M.table(spark, sf, "nation").where("n_regionkey in (1, 2)").select(F.col("n_nationkey").alias("location_id"))
    return M.postings(spark, sf).where(stats.alive() & (F.col("posted_at") >= as_of() - F.expr("interval 365 days")) & F.col("level").isin("SENIOR", "MID")).join(near, "location_id", "left_semi").select("posting_id")


@query("p05_multi_filter", f"{P} SELECT posting_id FROM posting WHERE {ALIVE} AND coalesce(level, '__none') IN ('SENIOR', '__none') AND coalesce(work_mode, '__none') IN ('REMOTE', 'HYBRID')")
def p05(spark, sf):
    from jobloom.operators.facets import kept

    return kept(M.postings(spark, sf).where(stats.alive()), {"level": ["SENIOR", "__none"], "work_mode": ["REMOTE", "HYBRID"], "source_id": []}).select("posting_id")


@query("p07_any_skill", f"{P}, {M.SKILL_SQL} SELECT posting_id FROM posting WHERE {ALIVE} AND posting_id IN (SELECT posting_id FROM skill WHERE skill IN ('Brand#3', 'Brand#7'))")
def p07(spark, sf):
    return M.postings(spark, sf).where(stats.alive()).join(M.posting_skills(spark, sf).where(F.col("skill").isin("Brand#3", "Brand#7")), "posting_id", "left_semi").select("posting_id")


@query("p09_recheck_valves", f"{P} SELECT posting_id FROM posting WHERE {ALIVE} AND (expires_on <= DATE '2000-06-18' OR miss_count >= 1 OR checked_on IS NULL OR checked_on < DATE '2000-06-08')")
def p09(spark, sf):
    return Q.recheck_due(M.postings(spark, sf), F.lit("2000-06-15").cast("date")).select("posting_id")


@query("p11_reparse_selector", f"{P} SELECT posting_id FROM posting WHERE raw_key IS NOT NULL AND source_id = 3 AND parse_status IN ('PARTIAL', 'FAILED')")
def p11(spark, sf):
    return M.postings(spark, sf).where("raw_key is not null and source_id = 3 and parse_status in ('PARTIAL', 'FAILED')").select("posting_id")


@query("j02_province_counts_fan_out", f"{P} SELECT r_name AS region, n_name AS province, count(*) AS n FROM posting JOIN nation ON location_id = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def j02(spark, sf):
    return M.postings(spark, sf).join(M.locations(spark, sf), "location_id").groupBy("region", "province").agg(F.count("*").alias("n"))


@query("j04_semi", f"{P} SELECT posting_id FROM posting WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = posting_id AND l_quantity >= 49)")
def j04(spark, sf):
    big = M.table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("posting_id"))
    return M.postings(spark, sf).join(big, "posting_id", "left_semi").select("posting_id")


@query("j05_spine_left", "SELECT s.d AS day, coalesce(n, 0) AS n FROM (SELECT CAST(generate_series AS DATE) AS d FROM generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)) s LEFT JOIN (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1) USING (d)")
def j05(spark, sf):
    spine = spark.range(1).select(F.explode(F.expr("sequence(date'2024-01-01', date'2024-02-05')")).alias("day"))
    per = M.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return spine.join(per, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("j06_outer_sources", f"{P}, {M.SOURCE_SQL} SELECT source_id, count(posting_id) AS n FROM source LEFT JOIN posting USING (source_id) GROUP BY 1")
def j06(spark, sf):
    per = M.postings(spark, sf).groupBy("source_id").agg(F.count("*").alias("n"))
    return M.sources(spark, sf).join(per, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("j08_keep_unmatched", "SELECT pos, slug, coalesce(n_name, slug) AS name FROM (VALUES (0, 'NATION_3'), (1, 'nowhere'), (2, 'NATION_1')) v(pos, slug) LEFT JOIN nation ON n_name = slug")
def j08(spark, sf):
    asked = spark.range(1).select(F.posexplode(F.array(*map(F.lit, ["NATION_3", "nowhere", "NATION_1"]))).alias("pos", "slug"))
    return asked.join(M.table(spark, sf, "nation"), F.col("slug") == F.col("n_name"), "left").select("pos", "slug", F.coalesce("n_name", "slug").alias("name"))


@query("j09_anti_missing", f"{P} SELECT posting_id FROM posting WHERE {ALIVE} AND posting_id NOT IN (SELECT l_orderkey FROM lineitem)")
def j09(spark, sf):
    return M.postings(spark, sf).where(stats.alive()).join(M.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("posting_id")), "posting_id", "left_anti").select("posting_id")


@query("j14_longest_contains", """WITH a AS (SELECT * FROM (VALUES ('the'), ('thea'), ('theand'), ('tion'), ('ation'), ('elle'), ('ment')) v(alias)), d AS (SELECT doc_id, trim(regexp_replace(lower(strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D'))), '[^a-z0-9]+', ' ', 'g')) AS k FROM documents)
SELECT doc_id, alias FROM d JOIN a ON contains(k, alias) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(alias) DESC, alias) = 1""")
def j14(spark, sf):
    aliases = ["the", "thea", "theand", "tion", "ation", "elle", "ment"]
    # The text is folded once, for all searches and for the filter.
    k = step(M.spread(M.table(spark, sf, "documents")).select("doc_id", "text"), k=match_key(F.col("text")))
    longest = F.coalesce(*[F.when(F.col("k").contains(a), F.lit(a)) for a in sorted(aliases, key=lambda a: (-len(a), a))])
    return step(k, alias=longest).select("doc_id", "alias").where("alias is not null")


@query("j16_silent_sources", f"{P}, {M.SOURCE_SQL} SELECT source_id FROM source WHERE active AND source_id NOT IN (SELECT source_id FROM posting)")
def j16(spark, sf):
    return M.sources(spark, sf).where("active").join(M.postings(spark, sf).select("source_id"), "source_id", "left_anti").select("source_id")


@query("j17_runs_with_sources", "SELECT user_id AS run_id, count(*) AS parts, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1 ORDER BY run_id DESC LIMIT 10")
def j17(spark, sf):
    e = M.table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("parts"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))
    return e.orderBy(F.desc("run_id")).limit(10)


_SAVED = "saved AS (SELECT posting_id FROM posting WHERE posting_id % 997 = 0)"


@query("j18_probe_order", f"""{P}, {_SAVED}, q AS (SELECT 0 AS first, posting_id, checked_on FROM posting SEMI JOIN saved USING (posting_id) UNION ALL (SELECT 1, posting_id, checked_on FROM posting ANTI JOIN saved USING (posting_id) WHERE {ALIVE}))
SELECT first, posting_id FROM q ORDER BY first, checked_on ASC NULLS FIRST, posting_id LIMIT 50""")
def j18(spark, sf):
    p = M.postings(spark, sf)
    saved = p.where("posting_id % 997 = 0").select("posting_id")
    first = p.join(saved, "posting_id", "left_semi").select(F.lit(0).alias("first"), "posting_id", "checked_on")
    rest = p.where(stats.alive()).join(saved, "posting_id", "left_anti").select(F.lit(1).alias("first"), "posting_id", "checked_on")
    return first.unionByName(rest).orderBy("first", F.asc_nulls_first("checked_on"), "posting_id").limit(50).select("first", "posting_id")


@query("o01_sort_salary_nulls_last", f"{P} SELECT posting_id, salary_max FROM posting WHERE {ALIVE} ORDER BY salary_max DESC NULLS LAST, posted_at DESC, posting_id LIMIT 40")
def o01(spark, sf):
    return M.postings(spark, sf).where(stats.alive()).orderBy(*Q.order("salary")).limit(40).select("posting_id", "salary_max")


@query("o02_page", f"{P} SELECT posting_id FROM posting WHERE {ALIVE} ORDER BY posted_at DESC, posting_id LIMIT 20 OFFSET 40")
def o02(spark, sf):
    return Q.page(M.postings(spark, sf).where(stats.alive()), 3).select("posting_id")


@query("o03_cumulative_page", f"{P} SELECT posting_id FROM posting WHERE {ALIVE} ORDER BY posted_at DESC, posting_id LIMIT 60")
def o03(spark, sf):
    return M.postings(spark, sf).where(stats.alive()).orderBy(*Q.order("newest")).limit(3 * Q.PAGE).select("posting_id")


@query("o05_deadline_order", f"{P} SELECT posting_id FROM posting WHERE {ALIVE} ORDER BY expires_on ASC NULLS LAST, posted_at DESC, posting_id LIMIT 20")
def o05(spark, sf):
    return M.postings(spark, sf).where(stats.alive()).orderBy(*Q.order("deadline")).limit(20).select("posting_id")


@query("o06_nulls_first", f"{P} SELECT posting_id FROM posting WHERE {ALIVE} ORDER BY checked_on ASC NULLS FIRST, expires_on, posting_id LIMIT 100")
def o06(spark, sf):
    return M.postings(spark, sf).where(stats.alive()).orderBy(F.asc_nulls_first("checked_on"), "expires_on", "posting_id").limit(100).select("posting_id")


@query("o08_source_order", f"WITH {M.SOURCE_SQL} SELECT source_id, CAST(row_number() OVER (ORDER BY active DESC, priority, source_id) AS INTEGER) AS place FROM source")
def o08(spark, sf):
    return M.sources(spark, sf).select("source_id", F.row_number().over(Window.orderBy(F.desc("active"), "priority", "source_id")).alias("place"))


@query("f11_similar", f"{P} SELECT posting_id FROM posting WHERE {ALIVE} AND posting_id <> 8 ORDER BY (level = (SELECT level FROM posting WHERE posting_id = 8)) DESC NULLS LAST, posted_at DESC, posting_id LIMIT 3")
def f11(spark, sf):
    p = M.postings(spark, sf)
    mine = p.where("posting_id = 8").select("level").scalar()
    return p.where(stats.alive() & (F.col("posting_id") != 8)).orderBy(F.desc_nulls_last(F.col("level") == mine), F.desc("posted_at"), "posting_id").limit(3).select("posting_id")


@query("u01_ordered_distinct", "SELECT k AS key, min(event_id) AS seq FROM (SELECT lower(event_type) || user_id % 5 AS k, event_id FROM events) GROUP BY 1")
def u01(spark, sf):
    return M.table(spark, sf, "events").groupBy(F.concat(F.lower("event_type"), (F.col("user_id") % 5).cast("string")).alias("key")).agg(F.min("event_id").alias("seq"))


@query("u02_except_both", """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 60), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 60)
SELECT 'added' AS side, user_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'removed', user_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def u02(spark, sf):
    e = M.table(spark, sf, "events").where("value > 60")
    a, b = (e.where(F.col("event_type") == k).select("user_id").distinct() for k in ("purchase", "signup"))
    return b.exceptAll(a).select(F.lit("added").alias("side"), "user_id").union(a.exceptAll(b).select(F.lit("removed").alias("side"), "user_id"))


@query("u04_skill_union", f"""WITH {M.SKILL_SQL} SELECT posting_id, count(DISTINCT s) AS n FROM (SELECT posting_id, skill AS s FROM skill UNION ALL SELECT o_orderkey, o_orderpriority FROM orders) GROUP BY 1""")
def u04(spark, sf):
    declared = M.table(spark, sf, "orders").select(F.col("o_orderkey").alias("posting_id"), F.array("o_orderpriority").alias("d"))
    own = M.posting_skills(spark, sf).groupBy("posting_id").agg(F.collect_set("skill").alias("s"))
    return declared.join(own, "posting_id", "full_outer").select("posting_id", F.size(F.array_union(F.coalesce("d", F.array().cast("array<string>")), F.coalesce("s", F.array().cast("array<string>")))).cast("long").alias("n"))


@query("h02_point_lookup", f"{P} SELECT posting_id, company, {FACET} AS value FROM posting WHERE posting_id = 42")
def h02(spark, sf):
    from jobloom.functions.salary import facet_value

    return M.postings(spark, sf).where("posting_id = 42").select("posting_id", "company", facet_value(F.col("is_public"), F.col("salary_min"), F.col("salary_max")).alias("value"))
