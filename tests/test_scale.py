"""What holds on tables larger than those of the other tests."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from jobloom.functions import classify as C
from jobloom.functions import places as P
from jobloom.functions import text as T
from jobloom.operators import fields as O
from jobloom.operators import normalize as N
from jobloom.operators import search as Q
from jobloom.sources import model as M
from tests.oracle import TABLES, same


def folder(sf, path, **made):
    """A folder of tables: those that are `made`, the others of `sf`."""
    for t in TABLES:
        if t not in made:
            os.symlink(f"{sf}/{t}.parquet", path / f"{t}.parquet")
    for t, df in made.items():
        df.coalesce(1).write.parquet(str(path / "made" / t))
        (part,) = (path / "made" / t).glob("part-*.parquet")
        os.symlink(part, path / f"{t}.parquet")
    return str(path)


def test_the_last_page_of_many(spark, sf, tmp_path):
    """More postings than ten thousand pages hold."""
    o = spark.range(200_031).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("O").alias("o_orderstatus"), (F.col("id") % 1000).cast("double").alias("o_totalprice"),
        F.date_add(F.lit("1995-01-01"), (F.col("id") * 7919 % 2000).cast("int")).cast("timestamp_ntz").alias("o_orderdate"), F.lit("2-HIGH").alias("o_orderpriority"),
    )
    c = spark.range(200_031).select(F.col("id").alias("c_custkey"), F.lit("c").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(0.0).alias("c_acctbal"), F.lit("x").alias("c_mktsegment"))
    at = folder(sf, tmp_path, orders=o, customer=c)
    got = __spark_entry__.queries()["h01_find_jobs"](spark, at)
    assert got.count() == 11
    same(got, __spark_entry__.oracle_sql()["h01_find_jobs"], at)


@pytest.mark.parametrize("kind", ["newest", "salary", "deadline"])
def test_pages_from_either_end(spark, kind):
    rows = spark.createDataFrame([(k, "OPEN", k % 3 if k % 4 else None, k % 5 if k % 7 else None, k % 2 if k % 9 else None) for k in range(47)], "posting_id int, status string, salary_max int, expires_on int, posted_at int")
    want = [r.posting_id for r in rows.orderBy(*Q.order(kind)).collect()]
    for number in (0, 1, 3, 4, 5, 6, None):
        total, page = Q.find(rows, Q.JobFilters(), number, kind, size=10)
        at = 40 if number is None else 10 * (min(max(number, 1), 5) - 1)
        assert total == 47 and [r.posting_id for r in page.collect()] == want[at : at + 10]
    assert Q.find(rows.limit(0), Q.JobFilters(), None, kind)[1].collect() == []


def test_tasks_do_not_grow_with_the_table(spark, tmp_path):
    """A row group can't be read by two tasks, however many rows it has."""
    spark.range(10 * M.TASK_ROWS).coalesce(1).write.parquet(str(tmp_path / "t"))
    parts = M.spread(spark.read.parquet(str(tmp_path / "t"))).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 10 * M.TASK_ROWS and max(r["count"] for r in parts) <= 1.1 * M.TASK_ROWS


@pytest.mark.parametrize("cumulative", [False, True])
def test_pages_of_a_field(spark, cumulative):
    """The rows are judged once for their number and the page together; the last page is asked for as None or by any number beyond it."""
    judged = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(k):
        judged.add(1)
        return k >= 0

    rows = spark.range(47).repartition(3).select(F.col("id").alias("posting_id"), F.struct(F.when(F.col("id") % 3 > 0, "strong").otherwise("weak").alias("verdict")).alias("match"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("posted_at"), seen.asNondeterministic()("id").alias("in_field"), *[F.lit(None).cast("string").alias(d) for d in O.DIMENSIONS], F.array(F.lit("x")).alias("skills"))
    want = [r.posting_id for r in rows.orderBy(F.desc(F.col("match.verdict") == "strong"), F.desc("posted_at"), "posting_id").select("posting_id").collect()]
    for number in (1, 2, 4, 5, 6, None):
        judged.value = 0
        at = 40 if number is None else 10 * (min(number, 5) - 1)
        page = O.items(rows, O.Request(page=number, cumulative=cumulative), size=10)
        assert [r.posting_id for r in page.collect()] == want[0 if cumulative else at : at + 10] and judged.value <= 47
        page.sparkSession.catalog.clearCache()


def test_a_posting_is_taken_apart_once(spark):
    """What the normaliser does on each row: a field of the JSON is got once, a text folded once, and no pay text is read behind public declared pay."""
    rows = spark.createDataFrame([('{"title": "x"}', "https://a.b/c-1.html", None, None, None)], "posting string, page_url string, salary_text string, skills array<string>, work_mode string")
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = N.normalize(rows)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert 0 < plan.count("variant_get(") <= 24 and 0 < plan.count("translate(") <= 24


TEXTS = [None, "", "java dev", "hot [gap] ke toan (remote) - ", "luong upto 10tr", "3 nam", "2-5 nam", "tu 2 den 4 years", "5+ nam", "it nhat 45 nam", "khong yeu cau kinh nghiem, 3 nam", "10 , 12 nam", "thu 7 nghi", "thu 2 - thu 6", "t7", "x6 y7", "saturday", "á b", "project manager", "intern 1 nam"]


def test_what_is_looked_through_first_changes_nothing(spark):
    """Against the patterns one after the other, without the looks that leave most texts alone."""
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    t, cut = F.col("t"), F.col("t")
    for pattern in [*T.TITLE_NOISE, r"[^a-z0-9+#./ ]+"]:
        cut = F.regexp_replace(cut, pattern, " ")
    level = F.coalesce(*[F.when(t.rlike(T.either(words)) & (~t.rlike(T.either(C.ROLES_NOT_MANAGING)) if k == "MANAGER" else F.lit(True)), F.lit(k)) for k, words in C.LEVEL_WORDS.items()])
    saturday = F.coalesce(*[F.when(t.rlike(r), F.lit(k)) for k, r in C.SATURDAY.items()])
    n = F.nullif(F.regexp_extract(t, r"(\d{1,2})\s*\+?\s*(?:year|nam)", 1), F.lit("")).cast("int")
    a, b = (F.nullif(F.regexp_extract(t, r"(\d{1,2})\s*(?:-|–|den|to)\s*(\d{1,2})\s*(?:year|nam)", k), F.lit("")).cast("int") for k in (1, 2))
    none, wide, one = t.rlike(T.either(C.NO_EXPERIENCE)), t.rlike(T.either(C.AT_LEAST)), n <= C.MOST_YEARS
    low = F.when(none, 0).when(a.isNotNull(), F.least(a, b)).when(one, n)
    high = F.when(none, 0).when(a.isNotNull(), F.greatest(a, b)).when(one & ~wide, n)
    want = [F.trim(F.regexp_replace(cut, r"\s+", " ")), level, saturday, low, high, F.regexp_replace(F.translate(t, *T.fold_table()), "[̀-ͯ]", "")]
    got = [T.title_key(t), C.level_named(t), C.parse_schedule(t, folded=t).saturday, C.years_in(t).min, C.years_in(t).max, T.remove_diacritics(t)]
    for r in rows.select(*[x.alias(f"w{i}") for i, x in enumerate(want)], *[x.alias(f"g{i}") for i, x in enumerate(got)]).collect():
        assert r[: len(want)] == r[len(want) :]


DATES = [None, "", "3/4/2024", "03-04-2024 10:00", "31/02/2024", "2024-02-29", "2023-02-29", "2024-1-5", "2024-01-05T10:00:00Z", "2024-01-05x", "1/1/1999", "x 1/1/2024", "1/1/2024\nlast"]
ADDRESSES = [{}, {"addressRegion": "N/A"}, {"streetAddress": "12  Lê Lợi", "addressLocality": "Quận 7", "addressRegion": "TP HCM"}, {"streetAddress": "KCN Sóng Thần, Bình Dương", "addressRegion": 7}, {"addressLocality": ["Hà Nội"], "addressRegion": None}, {"addressRegion": " Tỉnh Đồng Nai "}]


def test_a_posting_with_one_place(spark):
    """A place is read from its address, which isn't written out as JSON first; days are read by one pattern. Both as before."""
    rows = spark.createDataFrame([(json.dumps({"jobLocation": {"address": a}, "datePosted": d, "validThrough": d}), d) for a in ADDRESSES for d in DATES], "posting string, d string")
    given = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("page_url", "string"), ("salary_text", "string"), ("skills", "array<string>"), ("work_mode", "string"))])
    assert "StructField(jobLocation," not in N.normalize(given)._jdf.queryExecution().optimizedPlan().toString()
    v, text = F.try_parse_json("posting"), F.trim(F.col("d"))
    d, m, y = (F.regexp_extract(text, r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})", k) for k in (1, 2, 3))
    day = F.when(d != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    at = F.coalesce(F.try_to_timestamp(F.concat(day, F.lit(" 00:00:00+07:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX")), F.when(day.isNull() & text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), text.try_cast("timestamp")))
    address = F.try_variant_get(v, "$.jobLocation.address", f"struct<{','.join(f'{k}:string' for k in P.ADDRESS)}>")
    for first in (True, False):
        for r in rows.select(F.when(F.year(at).between(2000, 2100), at).alias("want"), C.parse_date(F.col("d")).alias("got"), P.extract_locations(F.get_json_object("posting", "$.jobLocation"), first).alias("places"), P.only_location(address, first).alias("only")).collect():
            assert r.want == r.got and r.places == r.only
