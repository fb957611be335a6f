"""Units, currencies, periods, declared and kept pay over the order table."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import salary as S
from jobloom.functions.text import step
from jobloom.operators import stats as O
from jobloom.plans.registry import query
from jobloom.sources import model as M

UNITS = ["ty", "trieu", "trd", "tr", "cu", "m", "mil", "million", "millions", "nghin", "ngan", "k", "usd", ""]
CURRENCY_TEXTS = ["$1000", "1000 usd", "15 trieu", "15tr", "luong 2000 do la", "20 dong", "20 m", "500", "vnd 5", "usd 20 trieu", "thang 13"]
PERIOD_TEXTS = ["50k/h", "50k / gio", "200k/ngay", "moi ngay 200k", "1 trieu/tuan", "per week 10", "200 trieu/nam", "annual 20000 usd", "15 trieu", "10tr/thang", "per hour 5", "20 yr"]


def key():
    return F.col("o_orderkey")


def pick(values: list[str], by: str = "o_orderkey"):
    """The value that stands at a row's key, modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def pick_sql(values: list[str], key: str = "o_orderkey") -> str:
    return f"(ARRAY[{', '.join(repr(v) for v in values)}])[{key} % {len(values)} + 1]"


def orders(spark, sf):
    return M.spread(M.table(spark, sf, "orders"))


@query("y02_unit", f"SELECT k, CASE WHEN unit = 'ty' THEN 1e9 WHEN unit[1:1] IN ('t', 'c', 'm') THEN 1e6 WHEN unit[1:1] IN ('n', 'k') THEN 1e3 ELSE 1.0 END::DOUBLE AS multiplier FROM (SELECT o_orderkey AS k, {pick_sql(UNITS)} AS unit FROM orders)")
def y02(spark, sf):
    return orders(spark, sf).select(key().alias("k"), S.unit_multiplier(pick(UNITS)).alias("multiplier"))


@query("y03_currency", rf"""SELECT k, CASE WHEN contains(t, '$') OR regexp_matches(t, '\b(usd|do la)\b') THEN 'USD' WHEN contains(t, 'vnd') OR regexp_matches(t, '\btrieu\b|[0-9] ?(dong|trieu|tr|m)\b') THEN 'VND' ELSE 'EUR' END AS currency
 FROM (SELECT o_orderkey AS k, {pick_sql(CURRENCY_TEXTS)} || ' ' || (o_orderkey % 90 + 10) || ' nam' AS t FROM orders)""")
def y03(spark, sf):
    text = F.concat(pick(CURRENCY_TEXTS), F.lit(" "), (key() % 90 + 10).cast("string"), F.lit(" nam"))
    return orders(spark, sf).select(key().alias("k"), S.currency_of(text, "EUR").alias("currency"))


@query("y04_period", rf"""SELECT k, CASE WHEN regexp_matches(t, '/ ?(h|gio)\b|per hour') THEN 'HOUR' WHEN regexp_matches(t, '/ngay|moi ngay') THEN 'DAY' WHEN regexp_matches(t, '/tuan|per week') THEN 'WEEK' WHEN regexp_matches(t, '/nam|annual') THEN 'YEAR' ELSE 'MONTH' END AS period
 FROM (SELECT o_orderkey AS k, {pick_sql(PERIOD_TEXTS)} AS t FROM orders)""")
def y04(spark, sf):
    return orders(spark, sf).select(key().alias("k"), S.period_of(pick(PERIOD_TEXTS)).alias("period"))


_DECLARED = """d AS (SELECT o_orderkey AS k, o_orderkey % 6 AS kind, CAST(floor(o_totalprice) AS BIGINT) AS p, CASE o_orderkey % 3 WHEN 0 THEN 'MONTH' WHEN 1 THEN 'YEAR' ELSE 'DAY' END AS unit FROM orders),
b AS (SELECT k, kind, CASE WHEN kind IN (0, 1, 2) THEN unit ELSE 'MONTH' END AS period, CASE WHEN kind = 1 THEN 'USD' WHEN kind = 4 THEN 'VND' ELSE 'VND' END AS currency,
  CASE kind WHEN 0 THEN p * 100 WHEN 1 THEN p // 10 WHEN 2 THEN p * 50 WHEN 3 THEN p * 200 WHEN 4 THEN (k % 30 + 10) * 1000000 END AS lo,
  CASE kind WHEN 0 THEN p * 150 WHEN 1 THEN NULL WHEN 2 THEN p * 50 WHEN 3 THEN p * 200 WHEN 4 THEN (k % 30 + 20) * 1000000 END AS hi FROM d),
f AS (SELECT *, CASE period WHEN 'MONTH' THEN 1.0 WHEN 'YEAR' THEN 1.0 / 12 ELSE 22.0 END::DOUBLE * CASE currency WHEN 'USD' THEN 25400.0 ELSE 1.0 END::DOUBLE AS x FROM b),
v AS (SELECT k, kind, currency, period, CAST(floor(lo * x + 0.5) AS BIGINT) AS lo, CAST(floor(hi * x + 0.5) AS BIGINT) AS hi FROM f),
w AS (SELECT *, coalesce(lo NOT BETWEEN 1000000 AND 500000000, false) OR coalesce(hi NOT BETWEEN 1000000 AND 500000000, false) AS out_of_range FROM v)"""


def declared_pay(spark, sf):
    """(k, base): objects with bounds, one bound in dollars, a value, a bare value, written pay in a value, and nothing to read."""
    p = F.floor("o_totalprice").cast("long")
    unit = F.when(key() % 3 == 0, "MONTH").when(key() % 3 == 1, "YEAR").otherwise("day")
    n, more = (key() % 30 + 10).cast("string"), (key() % 30 + 20).cast("string")
    js = F.to_json
    kinds = [
        js(F.struct(F.lit("VND").alias("currency"), F.struct((p * 150).alias("minValue"), (p * 100).cast("string").alias("maxValue"), unit.alias("unitText")).alias("value"))),
        js(F.struct(F.lit("usd").alias("salaryCurrency"), F.struct(F.floor(p / 10).alias("minValue"), unit.alias("unitText")).alias("value"))),
        js(F.struct(F.lit("VND").alias("currency"), F.struct((p * 50).alias("value"), unit.alias("unitText")).alias("value"))),
        js(F.struct((p * 200).alias("value"))),
        js(F.struct(F.lit("USD").alias("currency"), F.struct(F.concat(n, F.lit(".000.000 - "), more, F.lit(".000.000đ")).alias("value")).alias("value"))),
        js(F.struct(F.struct(F.lit("Negotiable").alias("value")).alias("value"))),
    ]
    return orders(spark, sf).select(key().alias("k"), F.element_at(F.array(*kinds), (key() % 6 + 1).cast("int")).alias("base"))


@query("y06_declared_salary", f"WITH {_DECLARED} SELECT k, kind < 5 AS found, CASE WHEN kind < 5 AND NOT out_of_range THEN least(lo, coalesce(hi, lo)) END AS low, CASE WHEN kind < 5 AND NOT out_of_range AND hi IS NOT NULL THEN greatest(lo, hi) END AS high, CASE WHEN kind < 5 THEN currency END AS currency, CASE WHEN kind < 5 THEN period END AS period FROM w WHERE NOT (kind = 4 AND out_of_range)")
def y06(spark, sf):
    r = step(declared_pay(spark, sf), r=S.parse_salary_json(F.parse_json("base")))
    return r.select("k", F.col("r").isNotNull().alias("found"), F.col("r.min").alias("low"), F.col("r.max").alias("high"), "r.currency", "r.period")


RATES = ["26000", "abc", "-1", "", "0", "25000.5", "Infinity", "NaN"]


@query("y08_fx_rate", f"SELECT o_orderkey AS k, CASE WHEN isfinite(r) AND r > 0 THEN r ELSE 25400.0 END AS rate FROM (SELECT o_orderkey, coalesce(TRY_CAST({pick_sql(RATES)} AS DOUBLE), -1) AS r FROM orders)")
def y08(spark, sf):
    return orders(spark, sf).select(key().alias("k"), F.coalesce(S.fx_rate(pick(RATES)), F.lit(S.USD_VND)).alias("rate"))


@query("y09_salary_from_raw", f"""WITH {_DECLARED} SELECT k, CASE WHEN k % 7 = 0 THEN NULL WHEN kind = 5 THEN false ELSE NOT out_of_range END AS is_public, CASE WHEN k % 7 <> 0 AND kind < 5 AND NOT out_of_range THEN least(lo, coalesce(hi, lo)) END AS low
 FROM w WHERE k % 2 = 0 UNION ALL SELECT o_orderkey, true, (o_orderkey % 40 + 5) * 1000000 FROM orders WHERE o_orderkey % 2 = 1""")
def y09(spark, sf):
    raw = F.when(F.col("k") % 2 == 1, F.concat(F.lit("Từ "), (F.col("k") % 40 + 5).cast("string"), F.lit(" triệu"))).when(F.col("k") % 7 == 0, F.left("base", F.length("base") - 1)).otherwise(F.col("base"))
    return step(step(declared_pay(spark, sf), raw=raw), r=S.salary_from_raw(F.col("raw"))).select("k", "r.is_public", F.col("r.min").alias("low"))


PROBLEMS = ["thiếu title", f"{S.PROBLEM}: 5", f"thiếu title; {S.PROBLEM}: 900 triệu; thiếu description", "", f"{S.PROBLEM}: a; thiếu jobLocation"]


@query("y10_salary_problem", f"""SELECT o_orderkey AS k, nullif(array_to_string(list_concat(list_filter(string_split({pick_sql(PROBLEMS)}, '; '), lambda x: x <> '' AND NOT starts_with(x, '{S.PROBLEM}')),
 CASE WHEN o_orderkey % 2 = 0 THEN ['{S.PROBLEM}: ' || o_orderkey] ELSE [] END), '; '), '') AS problems FROM orders""")
def y10(spark, sf):
    return orders(spark, sf).select(key().alias("k"), S.replace_salary_problem(pick(PROBLEMS), S.salary_problem(key() % 2 == 0, key().cast("string"))).alias("problems"))


@query("y11_facet_value", f"WITH {M.POSTING_SQL} SELECT posting_id, CASE WHEN is_public THEN nullif(greatest(coalesce(salary_min, 0), coalesce(salary_max, 0)), 0) END AS value FROM posting")
def y11(spark, sf):
    return M.postings(spark, sf).select("posting_id", S.facet_value(F.col("is_public"), F.col("salary_min"), F.col("salary_max")).alias("value"))


@query("y12_stats_value", f"WITH {M.POSTING_SQL} SELECT posting_id, coalesce((salary_min + salary_max) / 2.0, salary_min, salary_max)::DOUBLE AS value FROM posting")
def y12(spark, sf):
    return M.postings(spark, sf).select("posting_id", S.stats_value(F.col("salary_min"), F.col("salary_max")).alias("value"))


@query("y13_least_pay_rank", f"WITH {M.POSTING_SQL}, r AS (SELECT source_id, salary_min, row_number() OVER (PARTITION BY source_id ORDER BY salary_min) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS n FROM posting WHERE salary_min IS NOT NULL) SELECT source_id, salary_min AS p75 FROM r WHERE i = least(floor(n * 0.75), n - 1)")
def y13(spark, sf):
    return O.nearest_rank(M.postings(spark, sf), "source_id", "salary_min", {"p75": 0.75}).select("source_id", "p75")
