"""Dictionary, skill, role, purchase and fit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import classify as C
from jobloom.operators import fit
from jobloom.plans.registry import query
from jobloom.sources import model as M

STRONG, GRAY, EXCLUDES = ["ring", "gear"], ["widget"], ["small", "old"]
T = f"WITH {M.TITLE_SQL}, t AS (SELECT posting_id, ' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS tk, ' ' || trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) AS dk FROM title)"
_N = lambda k, terms: " + ".join(f"CAST(contains({k}, ' {x}') AS INTEGER)" for x in terms)
_G = " + ".join(f"CAST(contains(tk, ' {x}') OR contains(dk, ' {x}') AS INTEGER)" for x in GRAY)
MATCH_SQL = f"""{T}, m AS (SELECT posting_id, {_N('tk', STRONG)} AS th, {_N('dk', STRONG)} AS dh, {_G} AS gh, CASE {' '.join(f"WHEN contains(tk, ' {x}') THEN '{x}'" for x in EXCLUDES)} END AS rejected_by FROM t)"""


@query("m02_field_match", f"""{MATCH_SQL} SELECT posting_id, CASE WHEN rejected_by IS NOT NULL THEN 'reject' WHEN th > 0 THEN 'strong' WHEN dh >= 2 THEN 'weak' ELSE 'reject' END AS verdict,
 CASE WHEN rejected_by IS NOT NULL THEN 0 WHEN th > 0 THEN th * 10 + gh * 2 + least(dh, 5) WHEN dh >= 2 THEN least(dh, 5) ELSE 0 END AS score, rejected_by FROM m""")
def m02(spark, sf):
    r = C.match_field(F.col("title"), F.col("description"), STRONG, GRAY, EXCLUDES)
    return M.posting_titles(spark, sf).select("posting_id", r.alias("r")).select("posting_id", "r.verdict", "r.score", "r.rejected_by")


@query("o04_strong_then_new", f"""{MATCH_SQL} SELECT posting_id FROM m JOIN orders ON posting_id = o_orderkey WHERE rejected_by IS NULL AND (th > 0 OR dh >= 2) ORDER BY th > 0 DESC, o_orderdate DESC, posting_id LIMIT 60""")
def o04(spark, sf):
    r = C.match_field(F.col("title"), F.col("description"), STRONG, GRAY, EXCLUDES)
    rows = M.posting_titles(spark, sf).select("posting_id", r.verdict.alias("verdict")).where("verdict <> 'reject'")
    o = M.table(spark, sf, "orders").select(F.col("o_orderkey").alias("posting_id"), "o_orderdate")
    return rows.join(o, "posting_id").orderBy(F.desc(F.col("verdict") == "strong"), F.desc("o_orderdate"), "posting_id").limit(60).select("posting_id")


CATALOGUE = {"ring": ["ring"], "bolt": ["bolt", "bolts"], "blue": ["blue", "navy blue"], "csharp": ["C#"]}


@query("m03_skills", f"{T} SELECT posting_id, concat_ws(',', CASE WHEN contains(dk || ' ', ' ring ') THEN 'ring' END, CASE WHEN contains(dk || ' ', ' bolt ') THEN 'bolt' END, CASE WHEN contains(dk || ' ', ' blue ') THEN 'blue' END) AS skills FROM t")
def m03(spark, sf):
    return M.posting_titles(spark, sf).select("posting_id", F.array_join(C.match_skills(F.col("description"), CATALOGUE), ",").alias("skills"))


TYPES = [("metal", ["brand#1"], ["bolt"]), ("jewel", ["brand#2"], ["ring"])]


@query("m05_purchase_type", """SELECT p_partkey, CASE WHEN contains(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')), 'brand 1') THEN 'metal' WHEN contains(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')), 'brand 2') THEN 'jewel' WHEN contains(' ' || p_name, ' bolt') THEN 'metal' WHEN contains(' ' || p_name, ' ring') THEN 'jewel' ELSE 'chua-ro' END AS slug,
 CASE WHEN contains(p_brand, '#1') OR contains(p_brand, '#2') THEN 'industry' WHEN contains(' ' || p_name, ' bolt') OR contains(' ' || p_name, ' ring') THEN 'keyword' ELSE 'none' END AS basis FROM part""")
def m05(spark, sf):
    r = C.purchase_type(F.col("p_brand"), F.col("p_name"), F.lit(""), TYPES)
    return M.table(spark, sf, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.slug", "r.basis")


@query("m06_software_role", "SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN 'dotnet-fullstack' WHEN 1 THEN 'dotnet-backend' WHEN 2 THEN 'mobile' WHEN 3 THEN 'fullstack-khac' WHEN 4 THEN 'react-frontend' WHEN 5 THEN 'devops' WHEN 6 THEN 'backend-khac' ELSE 'chua-ro' END AS role FROM orders")
def m06(spark, sf):
    cases = [("Full-stack .NET", ["csharp"]), ("Developer", ["dotnet", "sql"]), ("App dev", ["flutter"]), ("Dev", ["angular", "java"]), ("Dev", ["react"]), ("SRE", []), ("Back End Developer", []), ("Nhân viên", [])]
    i = (F.col("o_orderkey") % 8 + 1).cast("int")
    skills = F.element_at(F.array(*[F.array(*map(F.lit, s)).cast("array<string>") for _, s in cases]), i)
    return M.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), C.software_role(F.element_at(F.array(*[F.lit(t) for t, _ in cases]), i), skills).alias("role"))


@query("m07_fit_score", """SELECT k, CAST(round(greatest(0, least(100, p))) AS INTEGER) AS score, CASE WHEN yrs - 2 >= 3 THEN 'off' WHEN p >= 70 THEN 'great' WHEN p >= 50 THEN 'good' WHEN p >= 30 THEN 'stretch' ELSE 'off' END AS band FROM (
 SELECT k, yrs, CASE WHEN k % 2 = 0 THEN 35.0 ELSE 17.5 END + CASE WHEN k % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN k % 4 = 2 THEN 5 ELSE 0 END + CASE WHEN yrs IS NULL THEN 10 WHEN yrs <= 2 THEN 20 WHEN yrs = 3 THEN 14 ELSE 6 END AS p
 FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 9 AS INTEGER) END AS yrs FROM orders))""")
def m07(spark, sf):
    k = F.col("o_orderkey")
    profile = fit.Profile(years=2, core=[fit.Group(["csharp", "dotnet"], 35), fit.Group(["react"], 10)])
    row = M.table(spark, sf, "orders").select(
        k.alias("k"), F.when(k % 4 != 0, k % 9).cast("int").alias("years_min"), F.when(k % 4 == 2, "REMOTE").alias("work_mode"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("district"), F.lit("developer").alias("title_key"),
        F.when(k % 2 == 0, F.array(F.lit("csharp"))).otherwise(F.array().cast("array<string>")).alias("title_skills"), F.when(k % 3 == 0, F.array(F.lit("react"))).otherwise(F.array().cast("array<string>")).alias("declared"), F.array(F.lit("csharp")).alias("text_skills"),
    )
    r = fit.score(profile)
    return row.select("k", r.alias("r")).select("k", "r.score", "r.band")
