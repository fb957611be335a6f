"""Sources: API records, pasted texts, fetched pages, raw records, their catalogue, and making rows again."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import salary as S
from jobloom.functions.text import step
from jobloom.operators import fit, normalize, repair
from jobloom.operators.normalize import logo_of, positive_number, record_at
from jobloom.plans.pay import pick, pick_sql
from jobloom.plans.registry import query
from jobloom.plans.stats import P
from jobloom.sources import catalogue as C
from jobloom.sources import model as M
from jobloom.sources import postings_json as J
from jobloom.sources import records as R
from jobloom.sources.store import shared_folder

T0 = "2026-08-02 00:00:00"


def start():
    return F.lit(T0).cast("timestamp")


def orders(spark, sf):
    return M.spread(M.table(spark, sf, "orders"))


def api_records(spark, sf):
    """(k, record: struct of RECORD) of orders and companies, by way of JSON; fields are missing by key."""
    o = orders(spark, sf).join(M.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"), "o_custkey")
    k, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("double")
    none = F.lit(None).cast("string")
    place = F.struct(F.concat(F.lit("Số "), k.cast("string")).alias("address"), F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("Hà Nội")).alias("cityNameVI"), F.lit("Hanoi").alias("cityName"))
    record = F.struct(
        k.alias("jobId"), F.concat(F.lit("Job "), k.cast("string")).alias("jobTitle"), F.lit("Mô tả").alias("jobDescription"), F.when(k % 2 == 0, "Yêu cầu").otherwise("").alias("jobRequirement"), F.concat(F.lit("https://api.example/"), k.cast("string")).alias("jobUrl"),
        F.when(k % 5 != 0, "2026-08-01").alias("approvedOn"), F.lit("2026-07-01").alias("createdOn"), F.lit("2026-09-01").alias("expiredOn"), F.when(k % 7 != 0, k % 7).cast("int").alias("typeWorkingId"), F.col("c_name").alias("companyName"), F.lit("").alias("companyUrl"), F.when(k % 2 == 0, "l.png").alias("companyLogo"),
        F.when(k % 9 == 0, False).alias("isSalaryVisible"), F.when(k % 4 == 0, 0.0).when(k % 4 == 1, price / 100).when(k % 4 == 2, price * 100).alias("salaryMin"), F.when(k % 4 == 1, price / 50).when(k % 4 == 2, price * 150).alias("salaryMax"), F.when(k % 2 == 1, "usd").when(k % 4 == 2, "USD").alias("salaryCurrency"),
        F.when(k % 6 == 0, F.array().cast("array<struct<address:string,cityNameVI:string,cityName:string>>")).otherwise(F.array(place)).alias("workingLocations"), F.when(k % 12 == 0, "Huế").otherwise("").alias("address"), F.array(F.struct(F.lit("C#").alias("skillName")), F.struct(none.alias("skillName"))).alias("skills"),
        F.array(F.struct(none.alias("industryV3NameVI"), F.lit("Tech").alias("industryV3Name"))).alias("industriesV3"), F.struct(F.lit("CNTT").alias("parentNameVI"), none.alias("parentName")).alias("jobFunction"), (k % 4).cast("int").alias("yearsOfExperience"),
    )
    return o.select(k.alias("k"), F.from_json(F.to_json(record), R.RECORD).alias("record"))


_REC = "r AS (SELECT o_orderkey AS k, c_name AS company, floor(o_totalprice) AS p FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("s10_record_to_posting", f"""WITH {_REC} SELECT k, 'Job ' || k AS title, 'Mô tả' || CASE WHEN k % 2 = 0 THEN chr(10) || 'Yêu cầu' ELSE '' END AS description, CASE WHEN k % 5 <> 0 THEN '2026-08-01' ELSE '2026-07-01' END AS date_posted, CASE k % 7 WHEN 0 THEN 'FULL_TIME' WHEN 2 THEN 'PART_TIME' WHEN 3 THEN 'CONTRACT' WHEN 4 THEN 'INTERN' WHEN 5 THEN 'TEMPORARY' ELSE 'FULL_TIME' END AS employment_type,
 company, CASE WHEN k % 2 = 0 THEN 'l.png' END AS logo, 'C#' AS skill, 'Tech' AS industry, 'CNTT' AS category, CASE WHEN k % 4 > 0 THEN k % 4 || ' năm kinh nghiệm' END AS experience FROM r""")
def s10(spark, sf):
    p = step(step(api_records(spark, sf), p=R.record_to_posting(F.col("record"))), v=F.parse_json("p"))
    at = lambda path: F.try_variant_get("v", path, "string")
    return p.select("k", at("$.title").alias("title"), at("$.description").alias("description"), at("$.datePosted").alias("date_posted"), at("$.employmentType").alias("employment_type"), at("$.hiringOrganization.name").alias("company"), at("$.hiringOrganization.logo").alias("logo"), at("$.skills[0]").alias("skill"), at("$.industry[0]").alias("industry"), at("$.occupationalCategory[0]").alias("category"), at("$.experienceRequirements").alias("experience"))


@query("s11_record_pay", f"""WITH {_REC}, v AS (SELECT k, CASE k % 4 WHEN 1 THEN p / 100 WHEN 2 THEN p * 100 END AS lo, CASE k % 4 WHEN 1 THEN p / 50 WHEN 2 THEN p * 150 END AS hi, k % 9 <> 0 AND k % 4 IN (1, 2) AS said FROM r)
SELECT k, CASE WHEN said THEN lo END AS low, CASE WHEN said THEN hi END AS high, CASE WHEN said THEN CASE WHEN greatest(lo, hi) < 1000000 THEN 'USD' ELSE 'VND' END END AS currency FROM v""")
def s11(spark, sf):
    p = api_records(spark, sf).select("k", R.declared_pay(F.col("record")).alias("s"))
    return p.select("k", F.col("s.value.minValue").alias("low"), F.col("s.value.maxValue").alias("high"), "s.currency")


@query("s12_record_places", f"WITH {_REC} SELECT k, CASE WHEN k % 12 = 0 THEN 'Huế' WHEN k % 6 <> 0 THEN 'Số ' || k END AS street, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 3 = 0 THEN 'Hanoi' ELSE 'Hà Nội' END AS region FROM r")
def s12(spark, sf):
    p = api_records(spark, sf).select("k", F.try_element_at(R.declared_places(F.col("record")), F.lit(1)).alias("x"))
    return p.select("k", F.col("x.address.streetAddress").alias("street"), F.col("x.address.addressRegion").alias("region"))


@query("s13_adapters", f"WITH {_REC} SELECT k, 'Job ' || k AS title FROM r")
def s13(spark, sf):
    read = C.adapter("any", C.API)(api_records(spark, sf).select("record"))
    return read.select(F.get_json_object("posting", "$.identifier").cast("long").alias("k"), F.get_json_object("posting", "$.title").alias("title"))


def source_rows(spark, sf):
    """The catalogue: a source for each supplier."""
    s = M.table(spark, sf, "supplier")
    code, kind = F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.when(F.col("s_suppkey") % 10 == 0, C.MANUAL).when(F.col("s_suppkey") % 3 == 0, C.API).otherwise(C.SITEMAP)
    return s.select(code.alias("code"), F.col("s_name").alias("name"), F.lit("https://s.example").alias("home_url"), kind.alias("kind"), F.lit(None).cast("string").alias("entry_url"), F.lit("/job/").alias("job_url_pattern"), F.col("s_nationkey").cast("int").alias("priority"), F.lit("").alias("note"))


_S = "s AS (SELECT 's' || s_suppkey AS code, s_name AS name, CASE WHEN s_suppkey % 10 = 0 THEN 'MANUAL' WHEN s_suppkey % 3 = 0 THEN 'API' ELSE 'SITEMAP_JSONLD' END AS kind, CAST(s_nationkey AS INTEGER) AS priority, s_suppkey AS k FROM supplier)"


@query("s14_source_seeds", f"""WITH {_S} SELECT code, kind, priority, CASE WHEN kind = 'API' THEN '{{"queries":["a","b"]}}' WHEN kind = 'SITEMAP_JSONLD' THEN '{{"urlIncludePattern":"/it/"}}' END AS config, k % 5 <> 4 AS is_active FROM s""")
def s14(spark, sf):
    c = source_rows(spark, sf)
    kind = F.col("kind")
    targets = c.select("code", (F.substring("code", 2, 20).cast("long") % 5 != 4).alias("is_active"), F.when(kind == C.API, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("queries"), F.when(kind == C.SITEMAP, "/it/").alias("url_include_pattern"))
    return C.seeds(c, targets).select("code", "kind", "priority", "config", "is_active")


@query("s15_catalogue_by_kind", f"WITH {_S} SELECT kind, count(*) AS n, min(priority) AS first FROM s GROUP BY 1")
def s15(spark, sf):
    return source_rows(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.min("priority").alias("first"))


@query("s22_seed_dimension", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'seeded' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'seeded' END AS created FROM customer")
def s22(spark, sf):
    c = M.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    seed = c.where("k % 3 = 0").withColumn("name", F.lit("seeded"))
    once = C.upsert_dimension(c, seed, "k")
    created = C.upsert_dimension(c.where("k % 2 = 0"), c.withColumn("name", F.lit("seeded")), "k", create_only=True)
    return C.upsert_dimension(once, seed, "k").join(created.withColumnRenamed("name", "created"), "k")


@query("s18_blob_key", "SELECT page_id, 'src/2026-08/' || left(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), 100) || '.json.gz' AS key FROM pages")
def s18(spark, sf):
    return M.table(spark, sf, "pages").select("page_id", C.blob_key(F.lit("src"), F.col("url"), start()).alias("key"))


def fetched(spark, sf):
    """(url, status, html): pages with postings of `demo_pages` and pay beside them; every eleventh wasn't found."""
    p = J.demo_pages(spark, sf)
    extra = F.concat(F.lit('<div class="box pay"><b> '), F.col("page_id").cast("string"), F.lit(' triệu</b></div><span class="tag">SQL</span><span class="tag"> </span><span class="tag">Go</span>'))
    return p.select(F.concat(F.lit("https://p.example/"), F.col("page_id").cast("string")).alias("url"), F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("status"), F.concat("html", extra).alias("html"))


@query("s05_collect_pages", """SELECT 'https://p.example/' || page_id AS url, kind, CASE WHEN kind = 'job' THEN 'Job ' || page_id END AS title, CASE WHEN kind = 'error' THEN CASE WHEN page_id % 11 = 0 THEN 'HTTP 404' ELSE 'no posting' END END AS error
FROM (SELECT page_id, unnest(['seen', CASE WHEN page_id % 11 <> 0 AND page_id % 3 > 0 THEN 'job' ELSE 'error' END]) AS kind FROM pages)""")
def s05(spark, sf):
    return R.collect(fetched(spark, sf)).select("url", "kind", F.get_json_object("posting", "$.title").alias("title"), "error")


@query("s07_fallbacks", "SELECT 'https://p.example/' || page_id AS url, page_id || ' triệu' AS salary_text, 'SQL,Go' AS skills FROM pages")
def s07(spark, sf):
    return fetched(spark, sf).select("url", R.fallbacks(F.col("html"), "div.pay", ".tag").alias("f")).select("url", "f.salary_text", F.array_join("f.skills", ",").alias("skills"))


PASTES = ["🔥 * TUYỂN KẾ TOÁN {k}\nCông ty: Alpha {k}\nLương: 12 - 18 triệu VNĐ/tháng\nĐịa điểm: Quận 7, TP HCM\n2 năm kinh nghiệm", "--\nDev {k}\nNhà tuyển dụng: Beta\nThu nhập từ 20 triệu\nở Cần Thơ", "Hi\nab\nkhông có gì"]


def pastes(spark, sf):
    o = orders(spark, sf)
    return o.select(F.col("o_orderkey").alias("k"), F.replace(pick(PASTES), F.lit("{k}"), F.col("o_orderkey").cast("string")).alias("text"))


@query("t14_guesses", "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'TUYỂN KẾ TOÁN ' || o_orderkey WHEN 1 THEN 'Dev ' || o_orderkey ELSE 'không có gì' END AS title, CASE o_orderkey % 3 WHEN 0 THEN 'Alpha ' || o_orderkey WHEN 1 THEN 'Beta' END AS company, CASE o_orderkey % 3 WHEN 0 THEN 'Lương: 12 - 18 triệu VNĐ/tháng' WHEN 1 THEN 'Thu nhập từ 20 triệu' END AS pay, CASE o_orderkey % 3 WHEN 0 THEN 'Địa điểm: Quận 7, TP HCM' WHEN 1 THEN 'ở Cần Thơ' END AS place FROM orders")
def t14(spark, sf):
    t = F.col("text")
    return pastes(spark, sf).select("k", R.guess_title(t).alias("title"), R.guess_company(t).alias("company"), R.pick_line(t, R.PAY_LABELS).alias("pay"), R.pick_place(t).alias("place"))


@query("s21_pasted_postings", f"""SELECT CAST(1000000 + o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 3 WHEN 0 THEN 12000000 WHEN 1 THEN 20000000 END AS low, CASE o_orderkey % 3 WHEN 0 THEN 18000000 END AS high, CASE o_orderkey % 3 WHEN 0 THEN 'ho-chi-minh' WHEN 1 THEN 'can-tho' END AS province, CASE WHEN o_orderkey % 3 = 0 THEN 2 END AS years_min,
 TIMESTAMP '{T0}' + INTERVAL 30 DAY AS expires_at, CASE WHEN o_orderkey % 3 = 2 THEN 'PARTIAL' ELSE 'OK' END AS parse_status FROM orders""")
def s21(spark, sf):
    texts = pastes(spark, sf).select(F.concat(F.lit("https://fb.example/p/"), (F.col("k") + 1000000).cast("string")).alias("url"), "text", F.lit(None).cast("timestamp").alias("posted_at"))
    out = normalize.normalize(R.pasted(texts, start()), street_first=True, as_of=start())
    return out.select(F.col("external_id_given").alias("id"), F.col("salary.min").cast("int").alias("low"), F.col("salary.max").cast("int").alias("high"), F.try_element_at("locations", F.lit(1)).slug.alias("province"), "years_min", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"), "parse_status")


def raw_records(spark, sf):
    """(source, external_id, at, payload): declared postings kept, some twice."""
    o = orders(spark, sf).where("o_orderkey % 9 <> 0")
    k = F.col("o_orderkey")
    posting = F.to_json(F.struct(F.concat(F.lit("Senior "), k.cast("string")).alias("title"), F.concat(F.lit("https://r.example/"), k.cast("string")).alias("url"), F.struct(F.lit("Alpha").alias("name")).alias("hiringOrganization"), F.lit("x").alias("description"), F.lit("2026-08-01").alias("datePosted"), F.when(k % 2 == 0, "Hà Nội").alias("jobLocation")))
    once = o.select((k % 8).cast("string").alias("source"), k.cast("string").alias("external_id"), start().alias("at"), posting.alias("payload"))
    return once


@query("s19_reparse", "SELECT o_orderkey % 8 AS source, CAST(o_orderkey AS VARCHAR) AS own_id, 'Senior ' || o_orderkey AS title, 'SENIOR' AS level, CASE WHEN o_orderkey % 2 = 0 THEN 'OK' ELSE 'PARTIAL' END AS parse_status, CAST(o_orderkey % 4 AS INTEGER) AS miss_count FROM orders WHERE o_orderkey % 9 <> 0 AND (o_orderkey % 10 = 0 OR o_orderkey % 33 = 0)")
def s19(spark, sf):
    stored = M.postings(spark, sf).select(F.col("source_id").cast("string").alias("source"), F.col("posting_id").cast("string").alias("external_id"), "parse_status", *repair.LIVENESS)
    out = repair.reparse(stored, raw_records(spark, sf), failed_only=True, as_of=start())
    return out.select(F.col("source").cast("long").alias("source"), "own_id", "title", "level", "parse_status", "miss_count")


@query("s17_raw_round_trip", "SELECT o_orderkey % 8 AS source, CAST(o_orderkey AS VARCHAR) AS external_id, 'Senior ' || o_orderkey AS title, '2026-08' AS month FROM orders WHERE o_orderkey % 9 <> 0")
def s17(spark, sf):
    folder = shared_folder(spark)
    C.write_raw(raw_records(spark, sf), folder)
    return C.read_raw(spark, folder).select(F.col("source").cast("long").alias("source"), "external_id", F.get_json_object("payload", "$.title").alias("title"), "month")


def stored_pay(spark, sf):
    """Postings without a raw record: written, declared and cut pay, with what was once made of it."""
    k = F.col("o_orderkey")
    n = (k % 40 + 5).cast("string")
    declared = F.concat(F.lit('{"currency":"USD","value":{"minValue":'), (k % 3000).cast("string"), F.lit("}}"))
    raw = F.when(k % 4 == 0, F.concat(F.lit("Từ "), n, F.lit(" triệu"))).when(k % 4 == 1, declared).when(k % 4 == 2, F.left(declared, F.lit(20))).otherwise(F.lit("Thoả thuận"))
    low = F.when(k % 8 == 0, (k % 40 + 5) * 1000000)
    return orders(spark, sf).select(
        k.alias("posting_id"), F.when(k % 10 == 9, "raw").alias("raw_key"), raw.alias("salary_raw"), low.alias("salary_min"), F.lit(None).cast("long").alias("salary_max"), F.lit("VND").alias("currency"), F.lit("MONTH").alias("period"), ((k % 8 == 0) | (k % 4 == 3)).alias("is_public"),
        F.when(k % 5 == 0, "thiếu title").alias("parse_error"), F.when(k % 7 == 0, "FAILED").when(k % 5 == 0, "PARTIAL").otherwise("OK").alias("parse_status"),
    )


_PAY = """s AS (SELECT o_orderkey AS k, o_orderkey % 4 AS kind, CAST(floor((o_orderkey % 3000) * 25400.0 + 0.5) AS BIGINT) AS usd FROM orders WHERE o_orderkey % 10 <> 9),
r AS (SELECT *, kind = 1 AND usd NOT BETWEEN 1000000 AND 500000000 AS odd, CASE kind WHEN 0 THEN true WHEN 1 THEN usd BETWEEN 1000000 AND 500000000 ELSE false END AS public, k % 8 = 0 OR kind = 3 AS was_public FROM s),
o AS (SELECT *, CASE WHEN kind = 2 THEN 'unreadable' WHEN k % 8 = 0 THEN 'same' ELSE 'changed' END AS outcome FROM r)"""


@query("s20_repair_salary", f"""WITH {_PAY} SELECT k AS posting_id, outcome, CASE kind WHEN 0 THEN (k % 40 + 5) * 1000000 WHEN 1 THEN CASE WHEN NOT odd THEN usd END END AS salary_min, nullif(concat_ws('; ', CASE WHEN k % 5 = 0 THEN 'thiếu title' END, CASE WHEN odd THEN '{S.PROBLEM}: {{"currency":"USD","value":{{"minValue":' || k % 3000 || '}}}}' END), '') AS parse_error,
 CASE WHEN k % 7 = 0 THEN 'FAILED' WHEN k % 5 = 0 OR odd THEN 'PARTIAL' ELSE 'OK' END AS parse_status FROM o WHERE kind <> 2""")
def s20(spark, sf):
    r = repair.repair_salary(stored_pay(spark, sf)).where("outcome <> 'unreadable'")
    return r.select("posting_id", "outcome", "new.salary_min", "new.parse_error", "new.parse_status")


@query("s20_repair_counts", f"WITH {_PAY} SELECT count(*) AS scanned, count(*) FILTER (outcome = 'unreadable') AS unreadable, count(*) FILTER (outcome = 'changed') AS changed, count(*) FILTER (outcome = 'changed' AND NOT was_public AND public) AS now_public, count(*) FILTER (outcome = 'changed' AND was_public AND NOT public) AS now_hidden FROM o")
def s20_counts(spark, sf):
    return repair.repair_counts(repair.repair_salary(stored_pay(spark, sf)))


KINDS = ['{"@type":"JobPosting","o":{"name":"a","logo":"x.png"},"n":"12 tháng"}', '{"@type":["Thing","http://schema.org/JobPosting"],"o":[{"name":"b","logo":{"url":"y.png"}}],"n":7}', '{"@type":"Person","o":"c","n":"không"}', '{"o":[1],"n":"0"}']


@query("h15_record_helpers", "SELECT o_orderkey AS k, o_orderkey % 4 < 2 AS is_posting, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS name, CASE o_orderkey % 4 WHEN 0 THEN 'x.png' WHEN 1 THEN 'y.png' END AS logo, CASE o_orderkey % 4 WHEN 0 THEN 12.0 WHEN 1 THEN 7.0 END::DOUBLE AS number FROM orders")
def h15(spark, sf):
    p = orders(spark, sf).select(F.col("o_orderkey").alias("k"), pick(KINDS).alias("p"))
    org = record_at(F.col("p"), "$.o")
    kind = F.get_json_object("p", "$['@type']")
    return p.select("k", J.is_posting(kind).alias("is_posting"), F.get_json_object(org, "$.name").alias("name"), logo_of(org).alias("logo"), positive_number(F.get_json_object("p", "$.n")).alias("number"))


NUMBERS = ['{"n":12.5,"u":"YEAR"}', '{"n":"1.234,5","u":"hour"}', '{"n":true}', '{"n":"x","u":"MONTHS"}', '{"n":"15.000","u":"Week"}']


@query("h16_number_and_period", f"SELECT o_orderkey AS k, (ARRAY[12.5, 1234.5, NULL, NULL, 15000])[o_orderkey % 5 + 1]::DOUBLE AS number, {pick_sql(['YEAR', 'HOUR', 'MONTH', 'MONTH', 'WEEK'])} AS period FROM orders")
def h16(spark, sf):
    p = orders(spark, sf).select(F.col("o_orderkey").alias("k"), F.parse_json(pick(NUMBERS)).alias("v"))
    number = F.when(S.json_kind(F.col("v"), "$.n") != "BOOLEAN", S.json_number(F.col("v"), "$.n"))
    return p.select("k", number.alias("number"), S.period_from_unit(F.try_variant_get("v", "$.u", "string")).alias("period"))


@query("m04_skill_catalogue", "SELECT lower(p_brand) AS slug, any_value(p_brand) AS name, count(DISTINCT p_type) AS n_aliases FROM part GROUP BY 1")
def m04(spark, sf):
    from jobloom.functions.classify import catalogue_of

    rows = M.table(spark, sf, "part").select(F.lower("p_brand").alias("slug"), F.col("p_brand").alias("name"), F.lower("p_type").alias("alias"))
    return catalogue_of(rows).select("slug", "name", F.size("aliases").cast("long").alias("n_aliases"))


@query("m09_profile", f"{P} SELECT posting_id, CASE WHEN years_min IS NULL THEN 10 WHEN years_min <= 3 THEN 20 WHEN years_min = 4 THEN 14 WHEN years_min = 5 THEN 6 ELSE 6 END AS score FROM posting WHERE level IS NULL AND work_mode = 'ONSITE'")
def m09(spark, sf):
    p = fit.Profile.parse({"years": 3, "core": [{"skills": ["x"], "weight": 10}]})
    none = F.array().cast("array<string>")
    rows = M.postings(spark, sf).where("level is null and work_mode = 'ONSITE'").select("posting_id", "years_min", "work_mode", "level", F.lit(None).cast("string").alias("district"), F.lit("").alias("title_key"), none.alias("title_skills"), none.alias("declared"), none.alias("text_skills"))
    return rows.select("posting_id", fit.score(p).score.alias("score"))
