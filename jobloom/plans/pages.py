"""Text, sitemap and JSON-LD functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import text as T
from jobloom.plans.registry import query
from jobloom.plans.text import docs, key_sql
from jobloom.sources import model as M
from jobloom.sources import postings_json as J
from jobloom.sources import sitemap


def pages(spark, sf):
    return M.table(spark, sf, "pages")


def one_of(values: list[str], by: str = "page_id"):
    """The value that stands at a row's number, modulo theirs."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


@query("t02_remove_diacritics", "SELECT doc_id, strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D')) AS text FROM documents")
def t02(spark, sf):
    return docs(spark, sf).select("doc_id", T.remove_diacritics(F.col("text")).alias("text"))


@query("t15_clean_term", rf"""SELECT doc_id, CASE WHEN t <> '' AND length(t) <= 60 AND length({key_sql('t')}) >= 2 THEN t END AS term
 FROM (SELECT doc_id, lower(trim(regexp_replace(replace(s, '~', ''), '\s+', ' ', 'g'))) AS t FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '~' ELSE '' END || left(text, CAST(doc_id % 80 AS INTEGER)) AS s FROM documents))""")
def t15(spark, sf):
    term = F.concat(F.when(F.col("doc_id") % 3 == 0, "~").otherwise(""), F.left("text", (F.col("doc_id") % 80).cast("int")))
    return docs(spark, sf).select("doc_id", T.clean_term(term).alias("term"))


@query("h22_short_error", "SELECT doc_id, left(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1], 200) AS error FROM documents")
def h22(spark, sf):
    return docs(spark, sf).select("doc_id", T.last_line(F.col("text")).alias("error"))


URLS = ["https://example.org/viec-lam/ke-toan-{n}.html", "https://example.org/job/{n}/", "https://example.org/viec-lam/x.html?id={n}", "https://example.org/"]


@query("s08_external_id", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN '/job/' || page_id || '/' WHEN 2 THEN '/viec-lam/x.html' ELSE '/' END AS id,
 CASE page_id % 4 WHEN 0 THEN 'ke-toan-' || page_id || '.html' WHEN 1 THEN CAST(page_id AS VARCHAR) WHEN 2 THEN 'x.html' ELSE '' END AS last_part FROM pages""")
def s08(spark, sf):
    url = F.replace(one_of(URLS), F.lit("{n}"), F.col("page_id").cast("string"))
    return pages(spark, sf).select("page_id", T.id_from_url(url, r"-(\d+)\.html$").alias("id"), T.id_from_url(url, None).alias("last_part"))


FILES = ["<sitemapindex><sitemap><loc>a</loc></sitemap></sitemapindex>", "<urlset><url><loc>b</loc></url></urlset>", "<SITEMAPINDEX />", ""]


@query("s03_sitemap_kind", "SELECT page_id, page_id % 4 IN (0, 2) AS is_index, page_id % 3 = 1 AND NOT contains(url, '/en/') AS is_nested FROM pages")
def s03(spark, sf):
    loc = F.concat("url", F.when(F.col("page_id") % 3 == 1, ".xml.gz").otherwise(""))
    return pages(spark, sf).select("page_id", sitemap.is_index(one_of(FILES)).alias("is_index"), sitemap.is_nested(loc, "/en/").alias("is_nested"))


@query("s04_decode_xml", "SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') AS text FROM pages")
def s04(spark, sf):
    return pages(spark, sf).select("page_id", sitemap.decode_xml(F.col("html")).alias("text"))


def sitemap_files(spark, sf):
    """(url, body): an index, a file for each hundred pages, and an entry that lists the index again."""
    text = F.col("page_id").cast("string")
    entry = F.concat(F.lit("<url><loc>https://Example.org/job-"), text, F.lit("?ref=1</loc><lastmod>2026-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod></url>"))
    other = F.lit("<url><loc>https://example.org/about</loc></url><url><loc>https://example.org/missing.xml</loc></url></urlset>")
    name = F.concat(F.lit("https://example.org/s"), F.floor(F.col("page_id") / 100).cast("string"), F.lit(".xml"))
    files = pages(spark, sf).groupBy(name.alias("url")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), other).alias("body"))
    listed = F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))), "")
    index = files.agg(F.concat(F.lit("<sitemapindex>"), listed, F.lit("<sitemap><loc>https://example.org/index.xml</loc></sitemap></sitemapindex>")).alias("body"))
    return files.unionByName(index.select(F.lit("https://example.org/index.xml").alias("url"), "body"))


@query("s01_sitemap_walk", "SELECT 'https://example.org/job-' || page_id AS url, '2026-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS lastmod FROM pages")
def s01(spark, sf):
    return sitemap.walk(sitemap_files(spark, sf), spark.createDataFrame([("https://example.org/index.xml",)], "url string"), r"/job-\d+")


@query("s01_walk_capped", "SELECT 'https://example.org/job-' || page_id AS url, '2026-01-' || (page_id % 28 + 1) AS lastmod, (SELECT count(*) FROM pages WHERE page_id % 28 >= 9) > 40 AS truncated FROM pages WHERE page_id % 28 >= 9 ORDER BY lastmod DESC, url LIMIT 40")
def s01_capped(spark, sf):
    roots = spark.createDataFrame([("https://example.org/index.xml",)], "url string")
    return sitemap.walk(sitemap_files(spark, sf), roots, r"/job-\d+", since="2026-01-10", max_urls=40)


@query("s01_frontier_walk", """SELECT 'job' AS kind, 'https://example.org/job-' || page_id AS url, '2026-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS said, (SELECT count(DISTINCT page_id // 100) + 2 FROM pages) AS files FROM pages WHERE page_id % 2 = 0 AND page_id % 28 >= 9
UNION ALL SELECT 'error', 'https://example.org/missing.xml', 'HTTP 404', (SELECT count(DISTINCT page_id // 100) + 2 FROM pages)""")
def s01_frontier(spark, sf):
    files = sitemap_files(spark, sf).withColumn("status", F.lit(200))
    w = sitemap.frontier_walk(files, ["https://example.org/index.xml"], r"/job-\d+", include_pattern=r"/JOB-\d*[02468]\?", since="2026-01-10", max_files=1_000_000)
    jobs = w.entries.select(F.lit("job").alias("kind"), "url", F.col("lastmod").alias("said"))
    return jobs.union(w.errors.select(F.lit("error"), "url", "message")).withColumn("files", F.lit(w.files).cast("long"))


LOOSE = ['{"a": %d}', '<![CDATA[ {"a": %d} ]]>', "{&quot;a&quot;: %d}", '{"a": %d,}', '{"a": %d', '// <![CDATA[\n{"a": [%d,]}\n// ]]>']


@query("e02_loose_json", "SELECT page_id, CASE page_id % 6 WHEN 4 THEN NULL WHEN 5 THEN '[' || page_id || ']' ELSE CAST(page_id AS VARCHAR) END AS a FROM pages")
def e02(spark, sf):
    body = F.replace(one_of(LOOSE), F.lit("%d"), F.col("page_id").cast("string"))
    return pages(spark, sf).select("page_id", F.get_json_object(J.loose_json(body), "$.a").alias("a"))


@query("e03_decode_entities", "SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&quot;', '\"'), '&#34;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text FROM pages")
def e03(spark, sf):
    return pages(spark, sf).select("page_id", J.decode_entities(F.col("html")).alias("text"))


@query("e05_has_posting", "SELECT page_id, page_id % 3 > 0 AS has_posting, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Job ' || page_id ELSE 'Job ' || page_id || ',Other ' || page_id END AS titles FROM pages")
def e05(spark, sf):
    found = J.collect_postings(J.demo_pages(spark, sf)).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.get_json_object("posting", "$.title"))), ",").alias("titles"))
    return pages(spark, sf).select("page_id").join(found, "page_id", "left").select("page_id", F.col("titles").isNotNull().alias("has_posting"), F.coalesce("titles", F.lit("")).alias("titles"))
