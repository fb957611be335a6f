"""Text functions over texts made of the tables' own columns; the SQL works the answers out of those columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import classify as C
from jobloom.plans.registry import query
from jobloom.sources import model as M
from jobloom.sources import records as R


def orders(spark, sf):
    return M.spread(M.table(spark, sf, "orders"))


ZONES_SQL = """
WITH c AS (SELECT c_custkey AS k, c_custkey // 2 % 15 AS n, lower(replace(n_name, '_', ' ')) || repeat(' x', CAST(c_custkey % 11 AS INTEGER)) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT k, CASE WHEN k % 2 = 0 AND n IN (1, 3, 4, 5, 6, 7, 8, 10, 11, 12) THEN 'Quận ' || n
 WHEN length(name) <= 24 THEN 'KCN ' || array_to_string(list_transform(string_split(name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') END AS district FROM c
"""


@query("l08_zones", ZONES_SQL)
def l08_zones(spark, sf):
    """Numbered districts, and zones with names of every length; a district that doesn't exist gives way to the zone."""
    k = F.col("c_custkey")
    name = F.concat(F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))), F.repeat(F.lit(" x"), (k % 11).cast("int")))
    before = F.when(k % 2 == 0, F.concat(F.lit("Quận "), F.expr("c_custkey div 2 % 15").cast("string"), F.lit(", "))).otherwise(F.lit("lô 3; "))
    # Of a name too long before the words for a zone the last words would be taken.
    zone = F.when(k % 3 > 0, F.concat(F.lit("KCN "), name)).when(F.length(name) <= 24, F.concat(name, F.lit(" Industrial Park"))).otherwise(F.lit("KCN (?)"))
    customers = M.spread(M.table(spark, sf, "customer")).join(M.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.select(k.alias("k"), C.district_of(F.concat(before, zone, F.lit(" , VN"))).alias("district"))


DAYS_SQL = """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 6 + 2 AS a, o_orderkey // 6 % 6 + 2 AS b, o_orderkey % 109 + 2 AS p, o_custkey FROM orders),
t AS (SELECT *, repeat('w', CAST(p - 1 AS INTEGER)) || ' Giờ làm việc thứ ' || a || ' đến thứ ' || b || ' ' || repeat('z', CAST(o_custkey % 200 AS INTEGER)) || '.' AS text,
 greatest(p - 60, 0) AS start, CASE WHEN b = 7 AND p + 23 <= 60 THEN p + 28 WHEN a = 7 AND p + 13 <= 60 THEN p + 18 ELSE p + 12 END + 110 AS stop FROM o)
SELECT k, CASE WHEN a = 2 AND b = 6 THEN 'NONE' WHEN a = 2 AND b = 7 THEN 'FULL' END AS saturday, CASE WHEN a = 7 OR b = 7 OR a = 2 AND b = 6 THEN trim(substr(text, start + 1, stop - start)) END AS raw FROM t
"""


@query("l09_days", DAYS_SQL)
def l09_days(spark, sf):
    """All pairs of first and last days, between words of every length."""
    k = F.col("o_orderkey")
    days = F.concat(F.lit("  Giờ làm việc thứ "), (k % 6 + 2).cast("string"), F.lit(" đến  thứ "), F.expr("o_orderkey div 6 % 6 + 2").cast("string"), F.lit(" "))
    text = F.concat(F.repeat(F.lit("w"), (k % 109 + 1).cast("int")), days, F.repeat(F.lit("z"), (F.col("o_custkey") % 200).cast("int")), F.lit("."))
    return orders(spark, sf).select(k.alias("k"), C.parse_schedule(text).alias("r")).select("k", "r.saturday", "r.raw")


KINDS_SQL = """
WITH o AS (SELECT o_orderkey AS k, [o_orderpriority, CASE WHEN o_orderstatus = 'O' THEN '"full  time"' ELSE 'none' END, CASE WHEN o_totalprice > 250000 THEN ' Part-Time ' END, CASE WHEN o_custkey % 2 = 0 THEN '''intern''' ELSE '' END, CASE WHEN o_custkey % 3 = 0 THEN 'other' ELSE 'others' END] AS kinds FROM orders),
n AS (SELECT k, list_transform(kinds, lambda x: regexp_replace(upper(trim(translate(x, '''"', ''))), '[ -]+', '_', 'g')) AS kinds FROM o)
SELECT k, replace(list_filter(kinds, lambda x: x IN ('FULL_TIME', 'PART_TIME', 'INTERN', 'OTHER'))[1], 'INTERN', 'INTERNSHIP') AS kind FROM n
"""


@query("l13_employment_lists", KINDS_SQL)
def l13_lists(spark, sf):
    """Lists of kinds that the orders' own columns make, with nulls, quotes and unknown ones among them."""
    customer = F.col("o_custkey")
    kinds = F.array(
        "o_orderpriority", F.when(F.col("o_orderstatus") == "O", '"full  time"').otherwise("none"), F.when(F.col("o_totalprice") > 250000, " Part-Time "),
        F.when(customer % 2 == 0, "'intern'").otherwise(""), F.when(customer % 3 == 0, "other").otherwise("others"),
    )
    return orders(spark, sf).select(F.col("o_orderkey").alias("k"), C.employment_type(kinds).alias("kind"))


LINES_SQL = """
WITH l AS (SELECT o_orderkey AS k, unnest([0, 1, 2, 3, 4, 5]) AS j, unnest([o_orderpriority, 'Mức  lương: ' || o_custkey, '(Thu nhập) ' || o_orderpriority, 'CTY Co ' || o_custkey, 'Nơi làm: ' || o_orderpriority, 'Workplace ' || o_custkey]) AS line FROM orders),
p AS (SELECT *, (j * 5 + k) % 6 AS turn FROM l WHERE k // 6 % 7 <> j)
SELECT k, arg_min(line, turn) AS title, max(substr(line, 5)) FILTER (line LIKE 'CTY %') AS company, arg_min(line, turn) FILTER (regexp_matches(line, 'lương|Thu nhập')) AS pay, arg_min(line, turn) FILTER (regexp_matches(line, 'Nơi làm|Workplace')) AS place FROM p GROUP BY k
"""


@query("t14_lines", LINES_SQL)
def t14_lines(spark, sf):
    """Lines of the orders' own columns in every turn, one left out of most texts."""
    k, customer, priority = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.col("o_orderpriority")
    lines = [priority, F.concat(F.lit("Mức  lương: "), customer), F.concat(F.lit("(Thu nhập) "), priority), F.concat(F.lit("CTY Co "), customer), F.concat(F.lit("Nơi làm: "), priority), F.concat(F.lit("Workplace "), customer)]
    turns = [F.when(F.expr("o_orderkey div 6 % 7") != j, F.struct(((k + j * 5) % 6).alias("turn"), line.alias("line"))) for j, line in enumerate(lines)]
    text = F.array_join(F.transform(F.array_sort(F.array_compact(F.array(*turns))), lambda x: x.line), "\r\n")
    t = F.col("text")
    return orders(spark, sf).select(k.alias("k"), text.alias("text")).select("k", R.guess_title(t).alias("title"), R.guess_company(t).alias("company"), R.pick_line(t, R.PAY_LABELS).alias("pay"), R.pick_line(t, R.PLACE_LABELS).alias("place"))
