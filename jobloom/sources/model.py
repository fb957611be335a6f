"""The posting model over the order tables: the same columns a collected corpus would have, derived deterministically."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALIVE = ["OPEN", "STALE"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that does heavy work on each of them.
TASK_ROWS = 50_000


def spread(rows: DataFrame) -> DataFrame:
    """A table's `rows` dealt to all cores, and to so many tasks that none has much more than TASK_ROWS, where they lie in fewer parts: for heavy work on each row, whose tasks would grow with the table. Parquet's own counts tell how many rows there are."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a posting; see POSTING_SQL for the same in SQL."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    k = F.col("o_orderkey")
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "MANAGER").when(F.col("o_orderpriority") == "2-HIGH", "SENIOR").when(F.col("o_orderpriority") == "3-MEDIUM", "MID").when(F.col("o_orderpriority") == "5-LOW", "JUNIOR")
    status = F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "P", "STALE").when(k % 2 == 0, "EXPIRED").otherwise("CLOSED")
    posted = F.col("o_orderdate").cast("timestamp")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("posting_id"), F.col("o_custkey").alias("company_id"), F.col("c_name").alias("company"), F.col("c_nationkey").alias("location_id"), (k % 8).alias("source_id"),
        F.concat(F.lit("job-"), k.cast("string")).alias("external_id"), status.alias("status"), level.alias("level"), (k % 3 != 0).alias("is_public"),
        F.when(k % 5 != 0, F.floor(F.col("o_totalprice") * 800)).cast("long").alias("salary_min"), F.when(k % 7 != 0, F.floor(F.col("o_totalprice") * 1000)).cast("long").alias("salary_max"),
        F.when(k % 4 != 0, k % 9).cast("int").alias("years_min"), F.when(k % 4 == 0, "ONSITE").when(k % 4 == 1, "HYBRID").when(k % 4 == 2, "REMOTE").alias("work_mode"),
        posted.alias("posted_at"), F.expr("date_add(to_date(o_orderdate), int(o_orderkey % 60))").alias("expires_on"), F.when(k % 6 != 0, F.expr("date_add(to_date(o_orderdate), int(o_orderkey % 11))")).alias("checked_on"),
        (k % 4).cast("int").alias("miss_count"), F.when(k % 10 == 0, "PARTIAL").when(k % 33 == 0, "FAILED").otherwise("OK").alias("parse_status"), F.when(k % 9 != 0, F.concat(F.lit("raw/"), k.cast("string"))).alias("raw_key"),
    )


POSTING_SQL = """
posting AS (
  SELECT o_orderkey AS posting_id, o_custkey AS company_id, c_name AS company, c_nationkey AS location_id, o_orderkey % 8 AS source_id, 'job-' || o_orderkey AS external_id,
         CASE WHEN o_orderstatus = 'O' THEN 'OPEN' WHEN o_orderstatus = 'P' THEN 'STALE' WHEN o_orderkey % 2 = 0 THEN 'EXPIRED' ELSE 'CLOSED' END AS status,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'MANAGER' WHEN '2-HIGH' THEN 'SENIOR' WHEN '3-MEDIUM' THEN 'MID' WHEN '5-LOW' THEN 'JUNIOR' END AS level,
         o_orderkey % 3 <> 0 AS is_public,
         CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice * 800) AS BIGINT) END AS salary_min,
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice * 1000) AS BIGINT) END AS salary_max,
         CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 9 AS INTEGER) END AS years_min,
         CASE o_orderkey % 4 WHEN 0 THEN 'ONSITE' WHEN 1 THEN 'HYBRID' WHEN 2 THEN 'REMOTE' END AS work_mode,
         CAST(o_orderdate AS TIMESTAMP) AS posted_at, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS expires_on,
         CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 11 AS INTEGER) END AS checked_on,
         CAST(o_orderkey % 4 AS INTEGER) AS miss_count,
         CASE WHEN o_orderkey % 10 = 0 THEN 'PARTIAL' WHEN o_orderkey % 33 = 0 THEN 'FAILED' ELSE 'OK' END AS parse_status,
         CASE WHEN o_orderkey % 9 <> 0 THEN 'raw/' || o_orderkey END AS raw_key
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def posting_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(posting_id, skill): distinct brands of an order's parts."""
    l, p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("posting_id"), F.col("p_brand").alias("skill")).distinct()


def posting_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(posting_id, title, description): names of the first line's part and of all lines' parts in order."""
    l, p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = l.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("posting_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_partkey", "p_name"))).alias("names"))
    return rows.select("posting_id", F.get("names", F.lit(0)).p_name.alias("title"), F.array_join(F.transform("names", lambda x: x.p_name), ", ").alias("description"))


SKILL_SQL = "skill AS (SELECT DISTINCT l_orderkey AS posting_id, p_brand AS skill FROM lineitem JOIN part ON l_partkey = p_partkey)"
TITLE_SQL = "title AS (SELECT l_orderkey AS posting_id, first(p_name ORDER BY l_linenumber, p_partkey) AS title, string_agg(p_name, ', ' ORDER BY l_linenumber, p_partkey) AS description FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location_id, province, region): small by nature, a row a province."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("province"), F.col("r_name").alias("region"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, source, priority, active): suppliers beyond the eighth have no postings."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source"), F.col("s_nationkey").cast("int").alias("priority"), (F.col("s_suppkey") % 5 != 4).alias("active"))


SOURCE_SQL = "source AS (SELECT s_suppkey AS source_id, s_name AS source, CAST(s_nationkey AS INTEGER) AS priority, s_suppkey % 5 <> 4 AS active FROM supplier)"
