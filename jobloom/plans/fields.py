"""A field's page: scope, judgement, counters, facets and items over the posting model; and the match report."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import classify as C
from jobloom.functions.text import tech_key
from jobloom.operators import fields as O
from jobloom.operators import fit, stats, terms
from jobloom.plans.matching import EXCLUDES, GRAY, MATCH_SQL, STRONG
from jobloom.plans.registry import query
from jobloom.plans.stats import ALIVE, AS_OF_SQL, FACET, PAY, YEARS, as_of
from jobloom.plans.text import key_sql
from jobloom.sources import model as M

FIELD = O.Definition("hardware", [*STRONG, *(f"~{g}" for g in GRAY)], EXCLUDES, ["NATION_1", "NATION_3", "NATION_7"], ["SENIOR", "MID", "MANAGER"], 1500)
SKILLS = ["Brand#3", "Brand#7"]
ASKED = O.Request({"level": ["SENIOR", "MID", "__none"], "pay": ["40+", "25-40"], "skills": SKILLS}, strict=True)


def candidates(spark, sf):
    """Alive postings with title, places and skills."""
    p = M.postings(spark, sf).where(stats.alive())
    skills = M.posting_skills(spark, sf).groupBy("posting_id").agg(F.collect_set("skill").alias("skills"))
    rows = p.join(M.posting_titles(spark, sf), "posting_id").join(skills, "posting_id", "left").join(M.locations(spark, sf).select("location_id", "province"), "location_id")
    return rows.select(
        "*", F.array("province").alias("provinces"), F.array(F.when(F.col("location_id") % 5 == 0, "Bình Dương").otherwise("Quận 1")).alias("places"), F.when(F.col("location_id") % 3 == 0, "Quận 1").alias("district"), F.when(F.col("posting_id") % 2 == 0, "NONE").alias("saturday"),
        F.col("checked_on").cast("timestamp").alias("checked_at"), F.col("source_id").cast("string").alias("source"),
    )


_M = MATCH_SQL.removeprefix("WITH ")
_OK = {"level": "coalesce(level, '__none') IN ('SENIOR', 'MID', '__none')", "pay": "pay IN ('40+', '25-40')", "skills": "list_has_any(skills, ['Brand#3', 'Brand#7'])", "district": "TRUE", "saturday": "TRUE", "years": "TRUE", "work_mode": "TRUE"}
_ALL = " AND ".join(_OK.values())
JUDGED = f"""WITH {M.POSTING_SQL}, {_M}, {M.SKILL_SQL}, sk AS (SELECT posting_id, list(skill) AS skills FROM skill GROUP BY 1),
c AS (SELECT posting.*, n_name AS province, coalesce(skills, []) AS skills, location_id % 5 = 0 AS far, CASE WHEN location_id % 3 = 0 THEN 'Quận 1' END AS district, CASE WHEN posting_id % 2 = 0 THEN 'NONE' END AS saturday, {FACET} AS pay_value, {PAY} AS pay, {YEARS} AS years,
  CASE WHEN rejected_by IS NOT NULL THEN 'reject' WHEN th > 0 THEN 'strong' WHEN dh >= 2 THEN 'weak' ELSE 'reject' END AS verdict FROM posting JOIN m USING (posting_id) LEFT JOIN sk USING (posting_id) JOIN nation ON location_id = n_nationkey WHERE {ALIVE}),
j AS (SELECT *, NOT far AND verdict <> 'reject' AS accepted, NOT far AND verdict = 'strong' AS in_field FROM c)"""


def judged(spark, sf):
    return O.judged(candidates(spark, sf), FIELD, ASKED)


@query("f01_field_counters", f"""{JUDGED} SELECT count(*) AS scanned, count(*) FILTER (far) AS dropped_far, count(*) FILTER (accepted) AS accepted, count(*) FILTER (accepted AND NOT in_field) AS weak_hidden, count(*) FILTER (in_field) AS in_field, count(*) FILTER (in_field AND {_ALL}) AS total, count(*) FILTER (in_field AND {_ALL}) AS strong,
 count(*) FILTER (in_field AND {_ALL} AND checked_on >= DATE '2000-06-14') AS fresh, count(*) FILTER (in_field AND {_ALL} AND posted_at >= {AS_OF_SQL} - INTERVAL 1 DAY) AS posted_24h, count(pay_value) FILTER (in_field AND {_ALL}) AS pay_sample, CAST(floor(quantile_cont(CAST(pay_value AS DOUBLE), 0.5) FILTER (in_field AND {_ALL}) + 0.5) AS BIGINT) AS pay_median,
 count(district) FILTER (in_field) AS with_district, count(saturday) FILTER (in_field) AS with_saturday, count(years_min) FILTER (in_field) AS with_years, count(pay_value) FILTER (in_field) AS with_pay, count(work_mode) FILTER (in_field) AS with_work_mode, count(level) FILTER (in_field) AS with_level, count(*) FILTER (in_field AND len(skills) > 0) AS with_skills FROM j""")
def f01_counters(spark, sf):
    return O.counters(judged(spark, sf), ASKED, as_of())


@query("f01_field_facets", f"{JUDGED} " + " UNION ALL ".join(f"SELECT '{d}' AS dim, {f'coalesce({d}, {chr(39)}__none{chr(39)})' if d != 'skills' else 's'} AS value, count(*) AS n FROM j{', unnest(skills) u(s)' if d == 'skills' else ''} WHERE in_field AND {' AND '.join(v for k, v in _OK.items() if k != d)} GROUP BY 2" for d in _OK))
def f01_facets(spark, sf):
    return O.facet_counts(judged(spark, sf), ASKED)


@query("f01_field_items", f"{JUDGED}, t2 AS (SELECT posting_id, posted_at FROM j WHERE in_field AND {_ALL}) SELECT posting_id FROM t2 ORDER BY posted_at DESC, posting_id LIMIT 30 OFFSET (SELECT 30 * least(1, greatest(0, (count(*) - 1) // 30)) FROM t2)")
def f01_items(spark, sf):
    return O.items(judged(spark, sf), O.Request(ASKED.chosen, strict=True, page=2)).select("posting_id")


@query("o02_page_clamped", f"{JUDGED}, t2 AS (SELECT posting_id, posted_at FROM j WHERE in_field AND {_ALL}) SELECT posting_id FROM t2 ORDER BY posted_at DESC, posting_id LIMIT 30 OFFSET (SELECT 30 * ((greatest(1, count(*)) - 1) // 30) FROM t2)")
def o02_clamped(spark, sf):
    return O.items(judged(spark, sf), O.Request(ASKED.chosen, strict=True, page=None)).select("posting_id")


@query("f03_count_by", f"WITH {M.POSTING_SQL} SELECT company AS value, count(*) AS n, min(posting_id) AS first FROM posting WHERE {ALIVE} AND level IS NOT NULL GROUP BY 1 ORDER BY n DESC, first LIMIT 8")
def f03(spark, sf):
    rows = M.postings(spark, sf).where(stats.alive() & F.col("level").isNotNull())
    return O.count_by(rows, F.col("company"), F.col("posting_id")).limit(8)


@query("f06_skill_facets_ordered", f"WITH {M.POSTING_SQL}, {M.SKILL_SQL} SELECT row_number() OVER (ORDER BY count(*) DESC, skill) AS place, skill, count(*) AS n FROM posting JOIN skill USING (posting_id) WHERE {ALIVE} GROUP BY skill QUALIFY place <= 12")
def f06(spark, sf):
    per = M.postings(spark, sf).where(stats.alive()).select("posting_id").join(M.posting_skills(spark, sf), "posting_id").groupBy("skill").agg(F.count("*").alias("n"))
    # As many rows as skills: the catalogue's.
    top = per.orderBy(F.desc("n"), "skill").limit(12).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "skill", "n"))).alias("a"))
    return top.select(F.posexplode("a").alias("i", "x")).select((F.col("i") + 1).cast("long").alias("place"), "x.skill", "x.n")


@query("f07_experience_bands", f"WITH {M.POSTING_SQL} SELECT posting_id, {YEARS} AS band FROM posting")
def f07(spark, sf):
    return M.postings(spark, sf).select("posting_id", C.experience_band(F.col("years_min")).alias("band"))


@query("f08_salary_bands", f"WITH {M.POSTING_SQL} SELECT posting_id, {PAY} AS band FROM posting")
def f08(spark, sf):
    from jobloom.functions.salary import facet_value

    return M.postings(spark, sf).select("posting_id", C.salary_band(facet_value(F.col("is_public"), F.col("salary_min"), F.col("salary_max"))).alias("band"))


_SCOPE = f"coalesce(province IN ('NATION_1', 'NATION_3', 'NATION_7') AND level IN ('SENIOR', 'MID', 'MANAGER') AND posted_at >= {AS_OF_SQL} - INTERVAL 1500 DAY, false)"


@query("f10_field_judge", f"{JUDGED} SELECT posting_id, {_SCOPE} AS in_scope, verdict, {_SCOPE} AND verdict = 'strong' AS listed FROM j")
def f10(spark, sf):
    return O.judge(candidates(spark, sf), FIELD, as_of()).select("posting_id", "in_scope", F.col("match.verdict").alias("verdict"), "listed")


@query("p06_hits_text", f"WITH {M.POSTING_SQL}, {M.TITLE_SQL} SELECT posting_id FROM posting JOIN title USING (posting_id) WHERE contains(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 'hot gear') OR contains(trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')), 'hot gear')")
def p06(spark, sf):
    return M.postings(spark, sf).join(M.posting_titles(spark, sf), "posting_id").where(O.hits_text("Hot, Gear")).select("posting_id")


@query("p08_only_known", f"WITH {M.POSTING_SQL} SELECT posting_id FROM posting WHERE {ALIVE} AND level = 'SENIOR'")
def p08(spark, sf):
    levels = O.only_known(["SENIOR", "WIZARD"], C.LEVEL_ORDER)
    return M.postings(spark, sf).where(stats.alive() & F.col("level").isin(*levels)).select("posting_id")


def fields_table(spark, sf):
    """(slug, name, keywords): a saved field for each nation; its terms are the region's words."""
    n = M.table(spark, sf, "nation").join(M.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("slug"), F.col("n_name").alias("name"), F.array(F.lower("r_name"), F.concat(F.lit("~"), F.lower("n_name"))).alias("keywords"))


@query("h03_fields", "SELECT lower(replace(n_name, '_', '-')) AS slug, n_name AS name, lower(r_name) AS strong, lower(n_name) AS gray FROM nation JOIN region ON n_regionkey = r_regionkey")
def h03(spark, sf):
    strong = F.filter("keywords", lambda t: ~t.startswith("~"))
    gray = F.transform(F.filter("keywords", lambda t: t.startswith("~")), lambda t: F.substring(t, 2, 100))
    return fields_table(spark, sf).orderBy("slug").select("slug", "name", F.array_join(strong, ",").alias("strong"), F.array_join(gray, ",").alias("gray"))


@query("h04_stack_rows", f"""{JUDGED} SELECT '{O.Definition("x", [], [], ["b", "a"], ["MID"], 30).scope_key()}' AS scope, posting_id, array_to_string(list_sort(skills), ',') AS skills, pay_value AS salary FROM j WHERE in_field""")
def h04(spark, sf):
    key = O.Definition("y", ["t"], [], ["a", "b"], ["MID"], 30).scope_key()
    return judged(spark, sf).where("in_field").select(F.lit(key).alias("scope"), "posting_id", F.array_join(F.array_sort(F.coalesce("skills", F.array().cast("array<string>"))), ",").alias("skills"), F.col("pay_value").alias("salary"))


@query("h20_field_domains", f"{MATCH_SQL} SELECT s.role, coalesce(n, 0) AS n FROM (VALUES ('in-field'), ('out'), ('unknown')) s(role) LEFT JOIN (SELECT CASE WHEN rejected_by IS NULL AND (th > 0 OR dh >= 2) THEN 'in-field' ELSE 'out' END AS role, count(*) AS n FROM m GROUP BY 1) USING (role)")
def h20(spark, sf):
    role = F.when(O.is_in_field(O.match(FIELD).verdict), "in-field").otherwise("out")
    per = M.posting_titles(spark, sf).select(role.alias("role")).groupBy("role").agg(F.count("*").alias("n"))
    return spark.createDataFrame([("in-field",), ("out",), ("unknown",)], "role string").join(per, "role", "left").select("role", F.coalesce("n", F.lit(0)).alias("n"))


@query("h21_experience_label", "SELECT o_orderkey AS k, CASE WHEN lo IS NULL AND hi IS NULL THEN NULL WHEN lo IS NULL THEN 'tới ' || hi || ' năm KN' WHEN hi IS NULL OR lo = hi THEN lo || '+ năm KN' ELSE lo || '–' || hi || ' năm KN' END AS label FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5 END AS lo, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 + o_orderkey % 2 END AS hi FROM orders)")
def h21(spark, sf):
    k = F.col("o_orderkey")
    return M.table(spark, sf, "orders").select(k.alias("k"), C.experience_label(F.when(k % 4 != 0, k % 5), F.when(k % 3 != 0, k % 5 + k % 2)).alias("label"))


PROFILE = fit.Profile.parse({"years": 2, "core": [{"skills": ["csharp", "dotnet"], "weight": 35}, {"skills": ["react"], "weight": 10}], "gaps": ["azure", "kafka"], "requirements": ["english"], "other_stacks": ["java"], "domain": ["bank"]})
_FIT = f"""{MATCH_SQL}, r AS (SELECT posting_id AS k, CASE WHEN rejected_by IS NOT NULL THEN 'reject' WHEN th > 0 THEN 'strong' WHEN dh >= 2 THEN 'weak' ELSE 'reject' END AS verdict, CASE WHEN posting_id % 4 <> 0 THEN CAST(posting_id % 9 AS INTEGER) END AS yrs FROM m),
s AS (SELECT *, k % 11 = 0 AS java, k % 2 = 0 AS own, k % 3 = 0 AS react, k % 5 = 0 AS azure, k % 13 = 0 AS bare FROM r),
p AS (SELECT *, CASE WHEN bare THEN 0 WHEN own THEN 35.0 ELSE 17.5 END + CASE WHEN NOT bare AND react THEN 10 ELSE 0 END + CASE WHEN k % 4 = 2 THEN 5 ELSE 0 END + CASE WHEN yrs IS NULL THEN 10 WHEN yrs <= 2 THEN 20 WHEN yrs = 3 THEN 14 ELSE 6 END + CASE WHEN java AND own AND NOT bare THEN -10 ELSE 0 END AS points FROM s),
q AS (SELECT *, coalesce(yrs - 2 >= 3, false) AS senior, java AND NOT (own AND NOT bare) AS other FROM p),
b AS (SELECT *, CASE WHEN senior OR other THEN 'off' WHEN bare AND NOT java THEN 'unknown' WHEN floor(points + 0.5) >= 70 THEN 'great' WHEN floor(points + 0.5) >= 50 THEN 'good' WHEN floor(points + 0.5) >= 30 THEN 'stretch' ELSE 'off' END AS band FROM q)"""


def scored(spark, sf):
    """Postings with a verdict, a role and a fit; skills by key, some postings with a requirement only."""
    k = F.col("posting_id")
    own, react, java, bare = k % 2 == 0, k % 3 == 0, k % 11 == 0, k % 13 == 0
    none = F.array().cast("array<string>")
    some = lambda c, *xs: F.when(c, F.array(*map(F.lit, xs))).otherwise(none)
    t = M.posting_titles(spark, sf)
    rows = t.select(
        "posting_id", O.match(FIELD).verdict.alias("verdict"), tech_key(F.col("title")).alias("title_key"), F.concat(some(own & ~bare, "csharp"), some(java, "java")).alias("title_skills"), some(react & ~bare, "react").alias("declared"),
        F.concat(some(~bare, "csharp"), some((k % 5 == 0) & ~bare, "azure"), some(bare, "english")).alias("text_skills"), F.when(k % 4 != 0, k % 9).cast("int").alias("years_min"), F.when(k % 4 == 2, "REMOTE").alias("work_mode"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("district"),
    )
    return rows.select("posting_id", "verdict", fit.score(PROFILE).alias("fit"), F.when(own & ~bare, "net").otherwise("other").alias("role"))


@query("a20_match_report", f"""{_FIT} SELECT 'verdict' AS part, verdict AS key, count(*) AS n FROM b GROUP BY 2 UNION ALL SELECT 'band', band, count(*) FROM b WHERE verdict <> 'reject' GROUP BY 2 UNION ALL SELECT 'role', CASE WHEN own AND NOT bare THEN 'net' ELSE 'other' END, count(*) FROM b WHERE verdict <> 'reject' GROUP BY 2
 UNION ALL SELECT 'flag', 'too-senior', count(*) FROM b WHERE verdict <> 'reject' AND senior HAVING count(*) > 0 UNION ALL SELECT 'flag', 'other-stack', count(*) FROM b WHERE verdict <> 'reject' AND other HAVING count(*) > 0 UNION ALL SELECT 'gap', 'azure', count(*) FROM b WHERE verdict <> 'reject' AND azure AND NOT bare AND band IN ('great', 'good') HAVING count(*) > 0""")
def a20(spark, sf):
    return fit.report(scored(spark, sf))


NAMES = {"csharp": "C#", "azure": "Azure", "react": "React"}


@query("m08_explain_fit", f"""{_FIT} SELECT k, band, concat_ws(' · ', CASE WHEN NOT bare THEN 'khớp ' || concat_ws(', ', 'C#', CASE WHEN react THEN 'React' END) END, CASE WHEN azure AND NOT bare THEN 'thiếu Azure' END, CASE WHEN k % 4 = 2 THEN 'remote' END) AS words FROM b""")
def m08(spark, sf):
    return scored(spark, sf).select(F.col("posting_id").alias("k"), "fit.band", fit.explain(F.col("fit"), NAMES).alias("words"))


@query("h17_words", "SELECT p_partkey, regexp_matches(' ' || p_name || ' ', ' (ring|bolt) ') AS hit, true AS same, CASE WHEN p_partkey % 2 = 0 THEN 'C#' ELSE 'go' END AS name FROM part")
def h17(spark, sf):
    slug = F.when(F.col("p_partkey") % 2 == 0, "csharp").otherwise("go")
    k = tech_key(F.col("p_name"))
    return M.table(spark, sf, "part").select("p_partkey", (fit.has_word(k, "Ring") | fit.has_word(k, "bolt")).alias("hit"), fit.same_text(F.upper("p_name"), F.col("p_name")).alias("same"), F.get(fit.names_of(F.array(slug), NAMES), F.lit(0)).alias("name"))


@query("m01_compiled_terms", "SELECT p_partkey, CAST(regexp_matches(' ' || p_name, ' rin') AS INTEGER) + CAST(regexp_matches(' ' || p_name, ' ge') AS INTEGER) AS hits, CAST(regexp_matches(' ' || p_name, ' wid') AS INTEGER) AS gray FROM part")
def m01(spark, sf):
    strong, gray = O.Definition("x", ["Rin", "ge", "~wid", "et"]).terms()
    k = C.match_key(F.col("p_name"))
    return M.table(spark, sf, "part").select("p_partkey", F.size(C.terms_hit(k, strong[:2])).alias("hits"), F.size(C.terms_hit(k, gray)).alias("gray"))


@query("j12_skill_theta_join", f"""WITH {M.TITLE_SQL}, a(slug, alias) AS (VALUES ('ring', 'ring'), ('bolt', 'bolt'), ('bolt', 'bolts'), ('blue', 'blue'), ('blue', 'navy blue')) SELECT DISTINCT posting_id, slug FROM title JOIN a ON contains(' ' || trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || alias || ' ')""")
def j12(spark, sf):
    from jobloom.plans.matching import CATALOGUE

    return M.posting_titles(spark, sf).select("posting_id", F.explode(C.match_skills(F.col("description"), CATALOGUE)).alias("slug"))


@query("j13_term_theta_join", f"{MATCH_SQL} SELECT posting_id, term FROM t JOIN (VALUES ('ring'), ('gear')) v(term) ON contains(dk, ' ' || term)")
def j13(spark, sf):
    return M.posting_titles(spark, sf).select("posting_id", F.explode(C.terms_hit(C.match_key(F.col("description")), STRONG)).alias("term"))


_FIRST = f"SELECT DISTINCT array_to_string(string_split(k, ' ')[1:2], ' ') AS term FROM (SELECT {key_sql('text')} AS k FROM documents) WHERE k <> ''"


@query("j13_many_terms", f"""WITH d AS (SELECT doc_id, ' ' || {key_sql('text')} AS k FROM documents), v AS ({_FIRST}) SELECT doc_id, term FROM d JOIN v ON contains(k, ' ' || term)""")
def j13_many(spark, sf):
    """The first two words of every document are a dictionary; which of its terms every document holds."""
    return terms.find_terms(keys(spark, sf), first_words(spark, sf).withColumn("term_key", F.col("term")), ["doc_id"]).drop("term_key")


@query("j12_many_skills", f"""WITH d AS (SELECT doc_id, ' ' || {key_sql('text')} || ' ' AS k FROM documents), v AS ({_FIRST}) SELECT term, count(DISTINCT doc_id) AS n FROM d JOIN v ON contains(k, ' ' || term || ' ') GROUP BY 1""")
def j12_many(spark, sf):
    """The same as whole words: how many documents hold each."""
    found = terms.find_terms(keys(spark, sf), first_words(spark, sf).withColumn("term_key", F.col("term")), ["doc_id"], whole=True)
    return found.groupBy("term").agg(F.count("*").alias("n"))


def keys(spark, sf):
    return M.spread(M.table(spark, sf, "documents")).select("doc_id", C.match_key(F.col("text")).alias("key"))


def first_words(spark, sf):
    return keys(spark, sf).where("key <> ''").select(F.array_join(F.slice(F.split("key", " "), 1, 2), " ").alias("term")).distinct()


@query("m06_main_skills", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'dotnet-backend' WHEN 1 THEN 'react-frontend' WHEN 2 THEN 'backend-khac' ELSE 'fullstack-khac' END AS role FROM orders")
def m06_main(spark, sf):
    k = F.col("o_orderkey") % 4
    none = F.array().cast("array<string>")
    some = lambda at, *xs: F.when(k == at, F.array(*map(F.lit, xs))).otherwise(none)
    # Skills of the text count only where title and declaration have none.
    main = C.main_skills(some(0, "csharp"), some(1, "react"), F.when(k == 3, F.array(F.lit("vue"), F.lit("php"))).otherwise(F.array(F.lit("java"))))
    return M.spread(M.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("k"), C.software_role(F.lit("Developer"), main).alias("role"))


@query("a19_gray_terms", f"{MATCH_SQL} SELECT 'widget' AS term, count(*) FILTER (contains(tk, ' widget') OR contains(dk, ' widget')) AS n, count(*) FILTER ((contains(tk, ' widget') OR contains(dk, ' widget')) AND th > 0) AS with_strong FROM t JOIN m USING (posting_id) WHERE rejected_by IS NULL")
def a19_gray(spark, sf):
    _, gray = FIELD.terms()
    rows = M.posting_titles(spark, sf).select(O.match(FIELD).alias("m"), C.match_key(F.concat_ws(" ", "title", "description")).alias("key")).where("m.rejected_by is null")
    each = rows.select(F.explode(C.terms_hit(F.col("key"), gray)).alias("term"), "m")
    return each.groupBy("term").agg(F.count("*").alias("n"), F.count_if(F.col("m.verdict") == "strong").alias("with_strong"))
