"""String, pay, level, place and date functions over whole tables; texts are built from keys where no table has them, so SQL knows the answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import classify as C
from jobloom.functions import salary as S
from jobloom.functions import text as T
from jobloom.plans.registry import query
from jobloom.sources import model as M
from jobloom.sources import postings_json as J
from jobloom.sources import sitemap


def key_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(replace(replace({c}, 'đ', 'd'), 'Đ', 'D'))), '[^a-z0-9]+', ' ', 'g'))"


def docs(spark, sf):
    return M.spread(M.table(spark, sf, "documents"))


@query("t01_whitespace", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def t01(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query("t01_nfc", "SELECT doc_id, nfc_normalize(replace(replace(replace(text, 'é', 'e' || chr(769)), 'ó', 'o' || chr(769)), 'ü', 'u' || chr(776))) AS text FROM documents")
def t01_nfc(spark, sf):
    """Texts with some letters taken apart, composed again."""
    apart = F.col("text")
    for whole, parts in (("é", "e\u0301"), ("ó", "o\u0301"), ("ü", "u\u0308")):
        apart = F.replace(apart, F.lit(whole), F.lit(parts))
    return docs(spark, sf).select("doc_id", T.nfc(apart).alias("text"))


@query("t03_match_key", f"SELECT doc_id, {key_sql('text')} AS key FROM documents")
def t03(spark, sf):
    return docs(spark, sf).select("doc_id", T.match_key(F.col("text")).alias("key"))


@query("t04_tech_key", "SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN 'senior csharp dotnet developer' WHEN 1 THEN 'c cpp engineer' WHEN 2 THEN 'reactnative dev' WHEN 3 THEN 'reactjs react and nodejs' WHEN 4 THEN 'aspnet dotnet mvc' WHEN 5 THEN 'cicd with vuejs vue' WHEN 6 THEN 'example net admin' ELSE 'truong nhom fsharp' END AS key FROM orders")
def t04(spark, sf):
    titles = ["Senior C#/.NET Developer", "C / C++ Engineer", "React-Native Dev", "ReactJS and Node.js", "ASP.NET MVC", "CI / CD with Vue.js", "example.net admin", "Trưởng nhóm F#"]
    title = F.element_at(F.array(*map(F.lit, titles)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return M.spread(M.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("k"), T.tech_key(title).alias("key"))


@query("t05_slug", f"SELECT doc_id, coalesce(nullif(left(replace({key_sql('text')}, ' ', '-'), 120), ''), 'khong-ten') AS slug FROM documents")
def t05(spark, sf):
    return docs(spark, sf).select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("t06_company_key", "SELECT c_custkey, CASE WHEN c_custkey % 6 = 3 THEN 'cong ty' ELSE 'abc ' || c_custkey END AS key FROM customer")
def t06(spark, sf):
    n = F.col("c_custkey").cast("string")
    k = F.col("c_custkey") % 6
    name = F.when(k == 0, F.concat(F.lit("Công ty TNHH ABC "), n)).when(k == 1, F.concat(F.lit("CTY CP ABC "), n, F.lit(" JSC"))).when(k == 2, F.concat(F.lit("ABC "), n, F.lit(" Co., Ltd"))).when(k == 3, F.lit("Công ty")).when(k == 4, F.concat(F.lit("Tập đoàn ABC-"), n, F.lit(" Việt Nam"))).otherwise(F.concat(F.lit("abc "), n))
    return M.table(spark, sf, "customer").select("c_custkey", T.company_key(name).alias("key"))


@query("t07_title_norm", r"""WITH t AS (
  SELECT p_partkey, lower(strip_accents(CASE p_partkey % 4 WHEN 0 THEN '[HN] ' || p_name WHEN 1 THEN p_name || ' (Upto 2000$)' WHEN 2 THEN p_name || ' lương upto 30tr -' ELSE 'Gấp ' || p_name END)) AS s FROM part),
u AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(s, '\[[^\]]*\]|\([^)]*\)', ' ', 'g'), '\b(?:luong|salary)\s+(?:upto|up to)\s*[0-9.,]+\s*(?:tr|trieu|k|m|usd)\b', ' ', 'g'), '\b(?:gap|hot|urgent)\b', ' ', 'g') AS s FROM t)
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(s, '-\s*$', ' '), '[^a-z0-9+#./ ]+', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM u""")
def t07(spark, sf):
    k, noise = F.col("p_partkey") % 4, F.col("p_name")
    title = F.when(k == 0, F.concat(F.lit("[HN] "), noise)).when(k == 1, F.concat(noise, F.lit(" (Upto 2000$)"))).when(k == 2, F.concat(noise, F.lit(" lương upto 30tr -"))).otherwise(F.concat(F.lit("Gấp "), F.initcap(noise)))
    return M.table(spark, sf, "part").select("p_partkey", T.title_norm(title).alias("title"))


@query("t08_html_to_text", r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'gis'), '<br\s*/?>', ' ', 'gi'), '</(p|div|li|tr|h[1-6])>', ' ', 'gi'), '<li[^>]*>', '• ', 'gi'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#0?39;', '''', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def t08(spark, sf):
    return M.table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("t09_canonical_url", r"SELECT page_id, 'https://' || lower(regexp_extract(url, '://([^/?#]+)', 1)) || CASE WHEN length(regexp_extract(url, '://[^/?#]+([^?#]*)', 1)) > 1 THEN regexp_replace(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/$', '') ELSE '/' END AS url FROM pages")
def t09(spark, sf):
    return M.table(spark, sf, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query("t10_truncate_bytes", "SELECT doc_id, CASE WHEN strlen(text) <= 100 THEN text ELSE list_aggregate(list_filter(list_transform(range(0, 101), lambda i: left(text, i)), lambda x: strlen(x) <= 100), 'max') END AS text FROM documents")
def t10(spark, sf):
    return docs(spark, sf).select("doc_id", T.truncate_bytes(F.col("text"), 100).alias("text"))


@query("t11_content_hash", f"SELECT doc_id, sha256({key_sql('left(text, 40)')} || '|' || source || '|' || text || '|' || doc_id || '|null') AS hash FROM documents")
def t11(spark, sf):
    return docs(spark, sf).select("doc_id", T.content_hash(T.match_key(F.left("text", F.lit(40))), F.col("source"), F.col("text"), F.col("doc_id"), F.lit(None).cast("int")).alias("hash"))


@query("t12_truncate_label", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 79) || '…' ELSE text END AS label FROM documents")
def t12(spark, sf):
    return docs(spark, sf).select("doc_id", T.truncate_label(F.col("text")).alias("label"))


@query("t13_skill_texts", r"""SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(31)) AS items FROM
 (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,;|/]|\s-\s'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '' AND length(x) <= 40) AS l FROM documents)""")
def t13(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.skill_texts(F.col("text")), "\x1f").alias("items"))


@query("t14_external_id", "SELECT page_id, CAST(1000000 + page_id AS VARCHAR) AS id FROM pages")
def t14(spark, sf):
    return M.table(spark, sf, "pages").select("page_id", T.external_id(F.concat(F.lit("job-12-"), (F.col("page_id") + 1000000).cast("string"), F.lit("-x"))).alias("id"))


@query("t16_excerpt", "SELECT doc_id, CASE WHEN length(text) > 600 THEN trim(left(text, 600)) || '…' ELSE text END AS text FROM documents")
def t16(spark, sf):
    return docs(spark, sf).select("doc_id", T.excerpt(F.col("text")).alias("text"))


@query("y01_parse_number", "SELECT k, CASE k % 4 WHEN 0 THEN k * 1000.0 + 500 WHEN 1 THEN k + 0.5 WHEN 2 THEN CAST(k AS DOUBLE) ELSE NULL END AS v FROM (SELECT o_orderkey + 1 AS k FROM orders)")
def y01(spark, sf):
    k = F.col("o_orderkey") + 1
    s = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(".500"))).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(",5"))).when(k % 4 == 2, k.cast("string")).otherwise(F.lit("abc"))
    return M.spread(M.table(spark, sf, "orders")).select(k.alias("k"), S.parse_number(s).alias("v"))


@query("y05_salary_text", """SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN n * 1000000 WHEN 1 THEN n * 1000000 WHEN 3 THEN NULL WHEN 4 THEN CAST((n * 100) * 25400 AS BIGINT) WHEN 5 THEN NULL WHEN 6 THEN n * 1000000 WHEN 7 THEN NULL END AS low,
 CASE o_orderkey % 8 WHEN 0 THEN (n + 5) * 1000000 WHEN 3 THEN n * 1000000 WHEN 4 THEN CAST((n * 100 + 50) * 25400 AS BIGINT) WHEN 6 THEN n * 1000000 END AS high, o_orderkey % 8 NOT IN (2, 5, 7) AS is_public, o_orderkey % 8 = 7 AS out_of_range
FROM (SELECT o_orderkey, o_orderkey % 30 + 10 AS n FROM orders)""")
def y05(spark, sf):
    n = (F.col("o_orderkey") % 30 + 10).cast("string")
    more = (F.col("o_orderkey") % 30 + 15).cast("string")
    usd = F.concat(((F.col("o_orderkey") % 30 + 10) * 100).cast("string"), F.lit(" - "), ((F.col("o_orderkey") % 30 + 10) * 100 + 50).cast("string"), F.lit(" USD"))
    texts = [F.concat(n, F.lit(" - "), more, F.lit(" triệu")), F.concat(F.lit("Từ "), n, F.lit(" triệu")), F.lit("Thoả thuận"), F.concat(F.lit("Upto "), n, F.lit("tr")), usd, F.lit(""), F.concat(n, F.lit(".000.000 VND")), F.concat(n, F.lit(" đồng"))]
    r = S.parse_salary(F.element_at(F.array(*texts), (F.col("o_orderkey") % 8 + 1).cast("int")))
    return M.spread(M.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("k"), r.alias("r")).select("k", F.col("r.min").alias("low"), F.col("r.max").alias("high"), "r.is_public", "r.out_of_range")


@query("y07_finalize", """WITH v AS (SELECT o_orderkey AS k, o_totalprice AS a, CASE o_orderkey % 5 WHEN 0 THEN 176 WHEN 1 THEN 22 WHEN 2 THEN 52.0 / 12 WHEN 3 THEN 1 ELSE 1.0 / 12 END::DOUBLE AS f FROM orders), r AS (SELECT k, CAST(floor(a * 2 * f + 0.5) AS BIGINT) AS lo, CAST(floor(a * f + 0.5) AS BIGINT) AS hi FROM v)
SELECT k, CASE WHEN ok THEN least(lo, hi) END AS low, CASE WHEN ok THEN greatest(lo, hi) END AS high, ok AS is_public FROM (SELECT *, lo BETWEEN 1000000 AND 500000000 AND hi BETWEEN 1000000 AND 500000000 AS ok FROM r)""")
def y07(spark, sf):
    period = F.element_at(F.array(*map(F.lit, S.PER_MONTH)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    r = S.finalize(F.col("o_totalprice") * 2, F.col("o_totalprice"), F.lit("VND"), period)
    return M.spread(M.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("k"), r.alias("r")).select("k", F.col("r.min").alias("low"), F.col("r.max").alias("high"), "r.is_public")


@query("l01_years", "SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN 0 WHEN 3 THEN n END AS low, CASE o_orderkey % 5 WHEN 0 THEN n + 2 WHEN 2 THEN 0 WHEN 3 THEN n END AS high FROM (SELECT o_orderkey, CAST(o_orderkey % 9 + 1 AS INTEGER) AS n FROM orders)")
def l01(spark, sf):
    n, more = (F.col("o_orderkey") % 9 + 1).cast("string"), (F.col("o_orderkey") % 9 + 3).cast("string")
    texts = [F.concat(more, F.lit(" - "), n, F.lit(" năm kinh nghiệm")), F.concat(F.lit("Ít nhất "), n, F.lit(" năm")), F.lit("Không yêu cầu kinh nghiệm"), F.concat(n, F.lit(" years")), F.lit("kinh nghiem")]
    r = C.years_of_experience(F.element_at(F.array(*texts), (F.col("o_orderkey") % 5 + 1).cast("int")))
    return M.spread(M.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("k"), r.alias("r")).select("k", F.col("r.min").alias("low"), F.col("r.max").alias("high"))


@query("l03_level", "SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN 'MANAGER' WHEN 1 THEN 'LEAD' WHEN 2 THEN 'SENIOR' WHEN 3 THEN 'INTERN' WHEN 4 THEN 'MID' WHEN 5 THEN 'FRESHER' WHEN 6 THEN 'SENIOR' END AS level FROM orders")
def l03(spark, sf):
    cases = [("Trưởng phòng mua hàng", ""), ("Team Lead Backend", ""), ("Senior Product Manager", ""), ("Thực tập sinh", ""), ("Product Owner", "3 năm"), ("Nhân viên", "không yêu cầu kinh nghiệm"), ("Kỹ sư", "trên 5 năm"), ("Nhân viên", "")]
    at = lambda j: F.element_at(F.array(*[F.lit(c[j]) for c in cases]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return M.spread(M.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("k"), C.infer_level(at(0), at(1)).alias("level"))


@query("l08_district", "SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'Bình Thạnh' WHEN 1 THEN 'Quận 7' WHEN 2 THEN 'KCN Tân Tạo' WHEN 3 THEN 'Thủ Đức' END AS district FROM orders")
def l08(spark, sf):
    texts = ["12 Điện Biên Phủ, Bình Thạnh, Thủ Đức", "Q.7, TP HCM", "KCN Tân Tạo, HCM", "Quận 9, TP. Thủ Đức", "Quận 2, TP HCM", "Hà Nội"]
    return M.spread(M.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("k"), C.district_of(F.element_at(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("district"))


@query("l09_schedule", "SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'NONE' WHEN 1 THEN 'FULL' WHEN 2 THEN 'HALF_DAY' WHEN 3 THEN 'ALTERNATE' END AS saturday, o_orderkey % 6 < 5 AS mentioned FROM orders")
def l09(spark, sf):
    texts = ["Thời gian làm việc: thứ 2 - thứ 6", "Thời gian làm việc: Thứ 2 đến Thứ 7", "Giờ làm việc 8h-17h, sáng thứ 7", "Thứ 7 làm việc luân phiên", "Thời gian làm việc có T7", "Lương cao"]
    r = C.parse_schedule(F.element_at(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % 6 + 1).cast("int")))
    return M.spread(M.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("k"), r.alias("r")).select("k", "r.saturday", F.col("r.raw").isNotNull().alias("mentioned"))


@query("l11_narrow_area", "SELECT o_orderkey AS k, o_orderkey % 3 = 1 AS narrow FROM orders")
def l11(spark, sf):
    places = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("Bình Dương"), F.lit("Dĩ An"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("Bình Dương"), F.lit("Quận 1"))).otherwise(F.array().cast("array<string>"))
    return M.spread(M.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("k"), C.is_narrow(places).alias("narrow"))


@query("l12_parse_date", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 17 HOUR - INTERVAL 1 SECOND END AS at FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-02'")
def l12(spark, sf):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "d/M/yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T12:00:00Z"))).otherwise(F.lit("31-02-2026"))
    return M.spread(M.table(spark, sf, "orders")).where("o_orderdate >= timestamp'2000-01-02'").select(F.col("o_orderkey").alias("k"), C.parse_date(text, True).cast("timestamp_ntz").alias("at"))


@query("l13_employment_type", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'FULL_TIME' WHEN 1 THEN 'PART_TIME' WHEN 2 THEN 'INTERNSHIP' END AS kind FROM orders")
def l13(spark, sf):
    lists = [["x", "full-time"], ["'PART_TIME'", "FULL_TIME"], ["intern"], ["unknown"]]
    value = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in lists]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return M.spread(M.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("k"), C.employment_type(value).alias("kind"))


@query("e01_jsonld_blocks", "SELECT page_id, CAST(page_id % 3 AS BIGINT) AS n FROM pages WHERE page_id % 3 > 0")
def e01(spark, sf):
    return J.demo_pages(spark, sf).select("page_id", F.explode(J.blocks(F.col("html"))).alias("b")).groupBy("page_id").agg(F.count("*").alias("n"))


@query("e04_collect_postings", "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(range(0, page_id % 3)) FROM pages) GROUP BY 1")
def e04(spark, sf):
    return J.collect_postings(J.demo_pages(spark, sf)).groupBy("page_id").agg(F.count("*").alias("n"))


@query("e04_all_postings", """SELECT page_id, 'Job ' || page_id AS title FROM pages WHERE page_id % 3 > 0 UNION ALL SELECT page_id, 'Other ' || page_id FROM pages WHERE page_id % 3 = 2 UNION ALL SELECT page_id, left(url, 40) FROM pages""")
def e04_all(spark, sf):
    """Blocks of every shape, and one of each page that holds its posting deep within."""
    pages = J.demo_pages(spark, sf).join(M.table(spark, sf, "pages").select("page_id", "url"), "page_id")
    deep = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("JobPosting").alias("@type"), F.left("url", F.lit(40)).alias("title")).alias("main"))).alias("items")))
    html = F.concat("html", F.lit('<script type="application/ld+json">'), deep, F.lit("</script>"))
    return J.all_postings(pages.select("page_id", html.alias("html"))).select("page_id", F.get_json_object("posting", "$.title").alias("title"))


@query("s02_sitemap_entries", "SELECT 'https://example.org/job-' || page_id || '?a=1&b=2' AS loc, CASE WHEN page_id % 2 = 0 THEN '2026-01-01' END AS lastmod FROM pages")
def s02(spark, sf):
    url = F.concat(F.lit("<url><loc><![CDATA[https://example.org/job-"), F.col("page_id").cast("string"), F.lit("?a=1&amp;b=2]]></loc>"), F.when(F.col("page_id") % 2 == 0, F.lit("<lastmod>2026-01-01</lastmod>")).otherwise(F.lit("")), F.lit("</url>"))
    files = M.table(spark, sf, "pages").groupBy(F.floor(F.col("page_id") / 100).alias("file")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(url), ""), F.lit("</urlset>")).alias("body"))
    return files.select(F.inline(sitemap.entries(F.col("body"))))
