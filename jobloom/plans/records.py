"""Places, times and whole postings: declared records made typed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import calendar as D
from jobloom.functions import classify as C
from jobloom.functions import places as P
from jobloom.functions.text import step
from jobloom.operators import normalize as N
from jobloom.plans.pay import pick, pick_sql
from jobloom.plans.registry import query
from jobloom.plans.text import key_sql
from jobloom.sources import model as M

AS_OF = "1998-08-02 09:30:00"


def orders(spark, sf):
    return M.spread(M.table(spark, sf, "orders"))


def key():
    return F.col("o_orderkey")


def now():
    return F.lit(AS_OF).cast("timestamp")


@query("l02_level_from_years", "SELECT o_orderkey AS k, CASE WHEN y = 0 THEN 'FRESHER' WHEN y < 2 THEN 'JUNIOR' WHEN y < 5 THEN 'MID' WHEN y IS NOT NULL THEN 'SENIOR' END AS level FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 9 END AS y FROM orders)")
def l02(spark, sf):
    return orders(spark, sf).select(key().alias("k"), C.level_from_years(F.when(key() % 4 != 0, key() % 9)).alias("level"))


_ALIASES = ", ".join(f"('{name}', '{slug}')" for name, slug in P.aliases())
NAMES = [name for name, _ in P.aliases()]
FORMS = ["", "tỉnh ", "TP ", "Số 12 đường ABC, ", "huyện Xyz - "]


@query("l04_province", rf"""WITH a(name, slug) AS (VALUES {_ALIASES}),
t AS (SELECT o_orderkey AS k, {pick_sql(FORMS)} || {pick_sql(NAMES, 'o_orderkey // 5')} AS text FROM orders), e AS (SELECT k, {key_sql('text')} AS key FROM t),
s AS (SELECT k, key, trim(regexp_replace(key, '^(thanh pho|tp|tinh|quan|huyen|phuong|xa|thi xa|thi tran|khu vuc|kv)\s+', '')) AS bare FROM e),
i AS (SELECT key, arg_max(slug, length(name)) AS slug FROM (SELECT DISTINCT key FROM s) JOIN a ON length(name) >= 4 AND contains(key, name) GROUP BY 1)
SELECT k, coalesce(a.slug, b.slug, i.slug) AS slug FROM s LEFT JOIN a ON a.name = s.key LEFT JOIN a b ON b.name = s.bare LEFT JOIN i ON i.key = s.key""")
def l04(spark, sf):
    text = F.concat(pick(FORMS), F.element_at(F.array(*map(F.lit, NAMES)), (F.floor(key() / 5) % len(NAMES) + 1).cast("int")))
    return orders(spark, sf).select(key().alias("k"), P.resolve_province(text).alias("slug"))


REGIONS, STREETS = ["Hà Nội", "Bình Dương", "N/A", "", "Tỉnh Đồng Nai"], ["12 Lê Lợi", "KCN Sóng Thần, Bình Dương", "chưa cập nhật"]


@query("l05_locations", f"""WITH p AS (SELECT o_orderkey AS k, {pick_sql(REGIONS)} AS region, {pick_sql(STREETS)} AS street, o_orderkey % 4 AS kind FROM orders),
c AS (SELECT k, kind, CASE WHEN region = 'N/A' THEN '' ELSE region END AS region, CASE WHEN street = 'chưa cập nhật' THEN '' ELSE street END AS street FROM p),
r AS (SELECT k, kind, region, street, concat_ws(', ', nullif(street, ''), nullif(region, '')) AS raw FROM c),
s AS (SELECT *, CASE WHEN kind = 3 AND contains(street, 'Bình Dương') THEN 'ho-chi-minh' WHEN region = 'Hà Nội' THEN 'ha-noi' WHEN region = 'Bình Dương' THEN 'ho-chi-minh' WHEN contains(region, 'Đồng Nai') THEN 'dong-nai' WHEN contains(street, 'Bình Dương') THEN 'ho-chi-minh' END AS slug FROM r)
SELECT k, array_to_string(CASE kind WHEN 0 THEN ['Quận 1, TP HCM=ho-chi-minh'] WHEN 1 THEN list_concat(CASE WHEN raw = '' THEN [] ELSE [raw || '=' || coalesce(slug, '')] END, ['Cà Mau=ca-mau']) ELSE CASE WHEN raw = '' THEN [] ELSE [raw || '=' || coalesce(slug, '')] END END, ';') AS places FROM s""")
def l05(spark, sf):
    address = F.struct(F.struct(pick(STREETS).alias("streetAddress"), pick(REGIONS).alias("addressRegion")).alias("address"))
    name = F.struct(F.lit(" Cà  Mau ").alias("name"))
    place = F.when(key() % 4 == 0, F.lit("Quận 1, TP HCM")).when(key() % 4 == 1, F.concat(F.lit("["), F.to_json(address), F.lit(","), F.to_json(address), F.lit(",["), F.to_json(name), F.lit(',"Cà Mau"]]'))).otherwise(F.to_json(address))
    shown = lambda found: F.array_join(F.transform(found, lambda x: F.concat(x.raw, F.lit("="), F.coalesce(x.slug, F.lit("")))), ";")
    rows = step(orders(spark, sf), place=place)
    return rows.select(key().alias("k"), F.when(key() % 4 == 3, shown(P.extract_locations(F.col("place"), True))).otherwise(shown(P.extract_locations(F.col("place")))).alias("places"))


MODES = ["Làm việc từ xa", "Remote Java Dev", "Kế toán tại Hà Nội", "Nhân viên WFH", "Remoteness officer", "Tư vấn tại nhà"]


@query("l06_remote", rf"SELECT k, regexp_matches(t, '\b(remote|tu xa|lam viec tai nha|work from home|wfh|telecommute)\b') AS remote FROM (SELECT o_orderkey AS k, lower(strip_accents({pick_sql(MODES)} || ' ' || o_orderstatus)) AS t FROM orders)")
def l06(spark, sf):
    return orders(spark, sf).select(key().alias("k"), C.is_remote(F.concat(pick(MODES), F.lit(" "), "o_orderstatus")).alias("remote"))


@query("l07_location_slugs", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'a' || o_orderkey % 3 || ',b' WHEN 1 THEN 'a' || o_orderkey % 3 WHEN 2 THEN 'remote' ELSE '' END AS slugs FROM orders")
def l07(spark, sf):
    a, none = F.concat(F.lit("a"), (key() % 3).cast("string")), F.lit(None).cast("string")
    slugs = F.when(key() % 4 == 0, F.array(a, F.lit("b"), a)).when(key() % 4 == 1, F.array(none, a)).otherwise(F.array(none))
    return orders(spark, sf).select(key().alias("k"), F.array_join(C.location_slugs(slugs, F.when(key() % 4 < 3, "REMOTE").otherwise("ONSITE")), ",").alias("slugs"))


@query("l10_excerpt", "SELECT k, CASE WHEN length(x) > 60 THEN left(x, 59) || '…' ELSE x END AS raw FROM (SELECT o_orderkey AS k, right(repeat('a', CAST(o_orderkey % 100 AS INTEGER)), 60) || 'Giờ làm việc' || left(repeat('b', CAST(o_orderkey % 150 AS INTEGER)), 110) AS x FROM orders)")
def l10(spark, sf):
    text = F.concat(F.repeat(F.lit("a"), (key() % 100).cast("int")), F.lit("Giờ  làm việc"), F.repeat(F.lit("b"), (key() % 150).cast("int")))
    return orders(spark, sf).select(key().alias("k"), C.schedule_excerpt(text, 60).alias("raw"))


HYBRID = ["Dev (Hybrid)", "Làm việc kết hợp", "hybridisation", "Kế toán", "Ket hop online"]


@query("l14_hybrid", f"SELECT o_orderkey AS k, o_orderkey % 5 IN (0, 1, 4) OR (o_orderkey % 3 = 0 AND o_orderkey % 500 <= 393) AS hybrid FROM orders")
def l14(spark, sf):
    text = F.concat(F.repeat(F.lit("x"), (key() % 500).cast("int")), F.when(key() % 3 == 0, F.lit(" hybrid ")).otherwise(F.lit(" onsite ")))
    return orders(spark, sf).select(key().alias("k"), N.is_hybrid(pick(HYBRID), text).alias("hybrid"))


@query("l15_industry", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_brand WHEN 2 THEN left(repeat('ngành ', 20), 79) || '…' END AS industry FROM part")
def l15(spark, sf):
    k, js = F.col("p_partkey") % 4, F.to_json
    long = F.trim(F.repeat(F.lit("ngành "), 20))
    posting = F.when(k == 0, js(F.struct(F.array(F.lit("  "), F.col("p_type"), F.lit("y")).alias("industry")))).when(k == 1, js(F.struct(F.lit("").alias("industry"), F.concat(F.lit(" "), F.col("p_brand")).alias("occupationalCategory")))).when(k == 2, js(F.struct(long.alias("industry")))).otherwise(F.lit("{}"))
    return M.table(spark, sf, "part").select("p_partkey", N.industry_of(posting).alias("industry"))


@query("l16_months_to_years", "SELECT o_orderkey AS k, CAST(floor((o_orderkey % 130) / 12.0 + 0.5) AS INTEGER) AS low FROM orders")
def l16(spark, sf):
    return orders(spark, sf).select(key().alias("k"), C.years_of_experience(N.years_text(key() % 130)).min.alias("low"))


_NOW = f"TIMESTAMP '{AS_OF}'"


@query("l17_ages", f"""SELECT o_orderkey AS k, CASE WHEN d <= 0 THEN 'hôm nay' WHEN d = 1 THEN 'hôm qua' WHEN d < 30 THEN d || ' ngày' ELSE d // 30 || ' tháng' END AS short_age,
 CASE WHEN m < 1 THEN 'vừa xong' WHEN m < 60 THEN m || ' phút trước' WHEN m < 1440 THEN m // 60 || ' giờ trước' WHEN m < 2880 THEN 'hôm qua' WHEN m < 43200 THEN m // 1440 || ' ngày trước' ELSE m // 43200 || ' tháng trước' END AS time_ago, CAST(ceil(-s / 86400.0) AS INTEGER) AS days_left
FROM (SELECT o_orderkey, date_diff('day', CAST(ts + INTERVAL 7 HOUR AS DATE), CAST({_NOW} + INTERVAL 7 HOUR AS DATE)) AS d, epoch({_NOW} - ts) AS s, CAST(floor(epoch({_NOW} - ts) / 60) AS BIGINT) AS m
 FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS TIMESTAMP) ELSE {_NOW} - to_seconds(CAST(o_orderkey * 37 % 200000 AS INTEGER)) END AS ts FROM orders))""")
def l17(spark, sf):
    at = F.when(key() % 2 == 0, F.col("o_orderdate").cast("timestamp")).otherwise(F.timestamp_seconds(F.unix_seconds(now()) - key() * 37 % 200000))
    return orders(spark, sf).select(key().alias("k"), D.short_age(at, now()).alias("short_age"), D.time_ago(at, now()).alias("time_ago"), D.days_left(at, now()).alias("days_left"))


@query("l18_next_crawl", f"""SELECT k, t AS next_at, CASE WHEN m < 60 THEN m || ' phút' WHEN m // 60 < 3 AND m % 60 >= 15 THEN m // 60 || ' giờ ' || m % 60 || ' phút' WHEN m % 60 >= 30 THEN m // 60 + 1 || ' giờ' ELSE m // 60 || ' giờ' END AS wait
FROM (SELECT k, min(t) AS t, CAST(floor(epoch(min(t) - any_value(ts)) / 60 + 0.5) AS BIGINT) AS m FROM (SELECT k, ts, CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_minutes(x) AS t FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS ts FROM orders), unnest([60, 420, 780, 1110, 1140, 1500]) u(x)) WHERE t > ts GROUP BY k)""")
def l18(spark, sf):
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (key() % 1440) * 60)
    return orders(spark, sf).select(key().alias("k"), at.alias("at")).select("k", "at", D.next_slot(F.col("at")).alias("n")).select("k", F.col("n").cast("timestamp_ntz").alias("next_at"), D.wait_text(F.col("at"), F.col("n")).alias("wait"))


@query("l19_freshness", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'critical' WHEN o_orderkey % 30 <= 6 THEN 'good' WHEN o_orderkey % 30 <= 24 THEN 'warn' ELSE 'critical' END AS tone FROM orders")
def l19(spark, sf):
    at = F.when(key() % 7 != 0, F.timestamp_seconds(F.unix_seconds(now()) - (key() % 30) * 3600))
    return orders(spark, sf).select(key().alias("k"), D.freshness(at, now()).alias("tone"))


def declared_postings(spark, sf):
    """(k, posting, page_url, salary_text, skills, work_mode): JSON-LD of orders, companies and titles; every field is missing somewhere."""
    k = F.col("k")
    base = M.posting_titles(spark, sf).withColumnRenamed("posting_id", "k").join(orders(spark, sf).withColumnRenamed("o_orderkey", "k"), "k").join(M.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"), "o_custkey")
    some = lambda n, c: F.when(k % n != 0, c)
    p = F.floor("o_totalprice").cast("long")
    posting = F.to_json(
        F.struct(
            F.lit("JobPosting").alias("@type"), some(7, F.concat(F.lit(" "), "title", F.when(k % 5 == 0, F.lit("  (Remote)")).otherwise(F.lit("")))).alias("title"), some(11, F.struct(F.concat(F.lit("Công ty TNHH "), "c_name").alias("name"), F.lit("https://c.example").alias("url"))).alias("hiringOrganization"),
            some(13, F.concat(F.lit("<p>"), "description", F.lit("</p><ul><li>Ít nhất "), (k % 9).cast("string"), F.lit(" năm</li></ul>"))).alias("description"), some(3, F.struct(F.lit("VND").alias("currency"), F.struct((p * 100).alias("minValue"), (p * 150).alias("maxValue"), F.lit("MONTH").alias("unitText")).alias("value"))).alias("baseSalary"),
            some(17, F.date_format(F.date_add("o_orderdate", 3650), "yyyy-MM-dd")).alias("datePosted"), F.date_format(F.date_add("o_orderdate", 3680), "dd/MM/yyyy").alias("validThrough"), some(4, F.struct(F.struct(F.lit("Quận 7").alias("addressLocality"), F.lit("TP HCM").alias("addressRegion")).alias("address"))).alias("jobLocation"),
            F.when(k % 2 == 0, "FULL_TIME").otherwise("part-time").alias("employmentType"), F.lit("C#, SQL; ring").alias("skills"),
        )
    )
    return base.select("k", posting.alias("posting"), F.concat(F.lit("https://Job.example/a-"), k.cast("string"), F.lit(".html?x=1")).alias("page_url"), F.when(k % 2 == 0, F.lit("10 - 20 triệu")).alias("salary_text"), F.when(k % 2 == 1, F.array(F.lit("extra"))).alias("skills"), F.lit(None).cast("string").alias("work_mode"))


_N01 = rf"""{M.TITLE_SQL}, r AS (SELECT posting_id AS k, CASE WHEN posting_id % 7 = 0 THEN '' ELSE title || CASE WHEN posting_id % 5 = 0 THEN ' (Remote)' ELSE '' END END AS title, posting_id % 5 = 0 AND posting_id % 7 <> 0 AS remote,
  CASE WHEN posting_id % 11 = 0 THEN 'Không rõ' ELSE 'Công ty TNHH ' || c_name END AS company, CASE WHEN posting_id % 11 = 0 THEN 'khong ro' ELSE replace(lower(c_name), '#', ' ') END AS company_key,
  CASE WHEN posting_id % 13 <> 0 THEN description || ' • Ít nhất ' || posting_id % 9 || ' năm' END AS description, CAST(floor(o_totalprice) AS BIGINT) AS p, CAST(o_orderdate AS DATE) + 3650 AS day
  FROM title JOIN orders ON posting_id = o_orderkey JOIN customer ON o_custkey = c_custkey),
s AS (SELECT *, k % 3 <> 0 AS declared, k % 3 <> 0 AND (p * 100 NOT BETWEEN 1000000 AND 500000000 OR p * 150 NOT BETWEEN 1000000 AND 500000000) AS odd FROM r),
v AS (SELECT *, CASE WHEN declared AND NOT odd THEN p * 100 WHEN k % 2 = 0 THEN 10000000 END AS lo, CASE WHEN declared AND NOT odd THEN p * 150 WHEN k % 2 = 0 THEN 20000000 END AS hi, odd AND k % 2 = 1 AS flagged FROM s)"""


@query("n01_typed_posting", rf"""WITH {_N01} SELECT k, CAST(k AS VARCHAR) AS external_id, 'https://job.example/a-' || k || '.html' AS url, title, trim(regexp_replace(regexp_replace(title, '\([^)]*\)|\bhot\b', ' ', 'g'), ' +', ' ', 'g')) AS title_norm, company AS company_name, company_key, replace(company_key, ' ', '-') AS company_slug, CASE WHEN k % 11 <> 0 THEN 'https://c.example' END AS company_website,
 description AS description_text, sha256(title || '|' || company_key || '|' || coalesce(description, '') || '|' || coalesce(CAST(lo AS VARCHAR), 'null') || '|' || coalesce(CAST(hi AS VARCHAR), 'null')) AS content_hash, lo AS salary_min, hi AS salary_max, lo IS NOT NULL AS is_public, CASE WHEN k % 2 = 0 THEN 'FULL_TIME' ELSE 'PART_TIME' END AS employment_type,
 CASE WHEN remote THEN 'REMOTE' ELSE 'ONSITE' END AS work_mode, CASE WHEN k % 13 <> 0 THEN CAST(k % 9 AS INTEGER) END AS years_min, CASE WHEN k % 4 <> 0 THEN 'Quận 7' END AS district, CASE WHEN k % 17 <> 0 THEN CAST(day AS TIMESTAMP) - INTERVAL 7 HOUR ELSE {_NOW} END AS posted_at, CAST(day + 31 AS TIMESTAMP) - INTERVAL 7 HOUR - INTERVAL 1 SECOND AS expires_at,
 CASE WHEN k % 4 <> 0 THEN 'Quận 7, TP HCM=ho-chi-minh' ELSE '' END AS places, CASE WHEN k % 2 = 1 THEN 'C#,SQL,ring,extra' ELSE 'C#,SQL,ring' END AS skills,
 CASE WHEN title = '' OR k % 11 = 0 OR k % 13 = 0 OR flagged OR k % 17 = 0 OR (k % 4 = 0 AND NOT remote) THEN 'PARTIAL' ELSE 'OK' END AS parse_status,
 nullif(concat_ws('; ', CASE WHEN title = '' THEN 'thiếu title' END, CASE WHEN k % 11 = 0 THEN 'thiếu hiringOrganization.name' END, CASE WHEN k % 13 = 0 THEN 'thiếu description' END, CASE WHEN flagged THEN 'lương ngoài khoảng hợp lý: {{"currency":"VND","value":{{"maxValue":' || p * 150 || ',"minValue":' || p * 100 || ',"unitText":"MONTH"}}}}' END,
   CASE WHEN k % 17 = 0 THEN 'thiếu/sai datePosted' END, CASE WHEN k % 4 = 0 AND NOT remote THEN 'thiếu jobLocation' END), '') AS parse_error FROM v""")
def n01(spark, sf):
    out = N.normalize(declared_postings(spark, sf), r"-(\d+)\.html", as_of=now())
    places = F.array_join(F.transform("locations", lambda x: F.concat(x.raw, F.lit("="), F.coalesce(x.slug, F.lit("")))), ";")
    plain = "k external_id url title title_norm company_name company_key company_slug company_website description_text content_hash employment_type work_mode years_min district parse_status parse_error".split()
    return out.select(*plain, F.col("salary.min").alias("salary_min"), F.col("salary.max").alias("salary_max"), F.col("salary.is_public").alias("is_public"), F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), F.col("expires_at").cast("timestamp_ntz").alias("expires_at"), places.alias("places"), F.array_join("skills", ",").alias("skills"))
