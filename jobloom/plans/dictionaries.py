"""Field dictionaries and their edits: each part's name makes a saved dictionary and a draft of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.operators import drafts as D
from jobloom.plans.registry import query
from jobloom.sources import model as M

#: Words of a part's name; gray ones are those of an even place in the saved dictionary, of a place beyond the first in the draft.
_BASE = """w AS (SELECT p_partkey AS k, list_filter(string_split(p_name, ' '), lambda x, i: list_position(string_split(p_name, ' '), x) = i) AS words, lower(p_brand) AS brand, lower(p_type) AS kind FROM part),
d AS (SELECT k, list_transform(words, lambda w, i: CASE WHEN i % 2 = 0 THEN '~' || w ELSE w END) AS saved, [kind] AS saved_ex, ['ha-noi', 'hue'] AS saved_pr, CASE WHEN k % 3 = 0 THEN 30 END AS saved_age,
  list_concat(CASE WHEN k % 2 = 0 THEN list_transform(words[1:1], lambda w: '~' || w) ELSE words[1:1] END, words[2:2], [brand]) AS draft, CASE WHEN k % 4 = 0 THEN [kind] ELSE [brand] END AS draft_ex, CASE WHEN k % 5 = 0 THEN ['hue', 'x'] ELSE ['hue', 'da-nang'] END AS draft_pr, CASE WHEN k % 2 = 0 THEN 30 END AS draft_age FROM w)"""
_J = lambda x: f"array_to_string({x}, '|')"


def drafts(spark, sf):
    """(k, words, saved, draft)."""
    words = F.array_distinct(F.split("p_name", " "))
    p = M.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), words.alias("words"), F.lower("p_brand").alias("brand"), F.lower("p_type").alias("kind"))
    k, texts = F.col("k"), lambda *xs: F.array(*map(F.lit, xs))
    first = F.slice("words", 1, 1)
    saved = F.struct(F.transform("words", lambda w, i: F.when(i % 2 == 1, F.concat(F.lit("~"), w)).otherwise(w)).alias("keywords"), F.array("kind").alias("excludes"), texts("ha-noi", "hue").alias("provinces"), F.when(k % 3 == 0, 30).alias("max_age_days"))
    keywords = F.concat(F.when(k % 2 == 0, F.transform(first, lambda w: F.concat(F.lit("~"), w))).otherwise(first), F.slice("words", 2, 1), F.array("brand"))
    draft = F.struct(keywords.alias("keywords"), F.when(k % 4 == 0, F.array("kind")).otherwise(F.array("brand")).alias("excludes"), F.when(k % 5 == 0, texts("hue", "x")).otherwise(texts("hue", "da-nang")).alias("provinces"), F.when(k % 2 == 0, 30).alias("max_age_days"))
    return p.select("k", "words", "brand", "kind", saved.alias("saved"), draft.alias("draft"))


def joined(c):
    return F.array_join(c, "|")


@query("m10_draft_diff", f"""WITH {_BASE} SELECT k, {_J("CASE WHEN list_contains(words, brand) THEN [] ELSE [brand] END")} AS add, {_J("CASE WHEN k % 2 = 0 THEN words[1:1] ELSE [] END")} AS add_gray,
 {_J("list_concat(list_filter(words[3:], lambda w: w <> brand), CASE WHEN k % 2 = 0 THEN words[1:1] ELSE [] END)")} AS remove, {_J("words[2:2]")} AS promote, {_J("list_filter(draft_ex, lambda x: NOT list_contains(saved_ex, x))")} AS add_exclude, {_J("list_filter(saved_ex, lambda x: NOT list_contains(draft_ex, x))")} AS remove_exclude,
 {_J("list_filter(draft_pr, lambda x: NOT list_contains(saved_pr, x))")} AS add_province, {_J("list_filter(saved_pr, lambda x: NOT list_contains(draft_pr, x))")} AS remove_province, saved_age IS DISTINCT FROM draft_age AS max_age_set
FROM (SELECT d.*, words, brand FROM d JOIN w USING (k))""")
def m10_diff(spark, sf):
    e = drafts(spark, sf).select("k", D.diff(F.col("saved"), F.col("draft")).alias("e"))
    return e.select("k", *[joined(F.col(f"e.{x}")).alias(x) for x in D.EDITS], "e.max_age_set")


@query("m10_draft_round_trip", f"""WITH {_BASE} SELECT k, {_J("list_sort(list_distinct(draft))")} AS keywords, {_J("list_sort(draft_ex)")} AS excludes, {_J("list_sort(draft_pr)")} AS provinces, draft_age AS max_age_days FROM d""")
def m10_round_trip(spark, sf):
    e = drafts(spark, sf).withColumn("e", D.diff(F.col("saved"), F.col("draft")))
    a = e.select("k", D.apply_edits(F.col("saved"), F.col("e")).alias("a"))
    return a.select("k", *[joined(F.array_sort(f"a.{c}")).alias(c) for c in ("keywords", "excludes", "provinces")], "a.max_age_days")


@query("m10_read_edits", f"""WITH {_BASE} SELECT k, {_J("[words[1], brand]")} AS add, CASE WHEN k % 4 = 0 THEN '' ELSE 'ha-noi' END AS add_province, k % 400 <= 365 AS max_age_set, CASE WHEN k % 400 BETWEEN 1 AND 365 THEN CAST(k % 400 AS INTEGER) END AS max_age_days, len(list_distinct([words[1], brand])) + CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END + CASE WHEN k % 400 <= 365 THEN 1 ELSE 0 END AS n_changes FROM w""")
def m10_read(spark, sf):
    p = drafts(spark, sf)
    value = lambda *xs: F.array(*xs)
    params = F.create_map(F.lit("add"), value(F.concat(F.lit("~ "), F.upper(F.get("words", F.lit(0)))), F.col("brand"), F.lit(" "), F.lit("x"), F.col("brand")), F.lit("add_province"), value(F.when(F.col("k") % 4 == 0, "Hà Nội!").otherwise("ha-noi")), F.lit("max_age_days"), value((F.col("k") % 400).cast("string")))
    e = p.select("k", D.read_edits(params).alias("e"))
    return e.select("k", joined(F.col("e.add")).alias("add"), joined(F.col("e.add_province")).alias("add_province"), "e.max_age_set", "e.max_age_days", F.size(D.entries(F.col("e"))).cast("long").alias("n_changes"))


@query("m11_saveable", f"""WITH {_BASE} SELECT k, k % 7 <> 0 AS saved, CASE WHEN k % 7 <> 0 THEN {_J("list_filter(draft_pr, lambda x: x <> 'x')")} END AS provinces FROM d""")
def m11(spark, sf):
    p = drafts(spark, sf)
    gray = F.transform("words", lambda w: F.concat(F.lit("~"), w))
    draft = F.when(F.col("k") % 7 == 0, F.col("draft").withField("keywords", gray)).otherwise(F.col("draft"))
    s = p.select("k", D.saveable(draft, F.array(*map(F.lit, ["ha-noi", "hue", "da-nang"]))).alias("s"))
    return s.select("k", F.col("s").isNotNull().alias("saved"), joined(F.col("s.provinces")).alias("provinces"))


@query("h18_term_helpers", f"""WITH {_BASE} SELECT k, saved[2] IS NOT NULL AS gray, words[2] AS label, true AS same, {_J("words")} AS once, regexp_full_match(brand, '[a-z0-9]+(-[a-z0-9]+)*') AS slug FROM (SELECT d.*, words, brand FROM d JOIN w USING (k)) WHERE len(words) > 1""")
def h18(spark, sf):
    p = drafts(spark, sf).where(F.size("words") > 1)
    second = F.get("saved.keywords", F.lit(1))
    return p.select("k", D.is_gray(second).alias("gray"), D.term_label(second).alias("label"), D.same_term(F.upper(F.get("words", F.lit(0))), F.get("words", F.lit(0))).alias("same"), joined(D.unique_terms(F.concat("words", F.transform("words", F.upper)))).alias("once"), D.is_slug(F.col("brand")).alias("slug"))


@query("h19_single_edits", f"""WITH {_BASE} SELECT k, {_J("saved[2:]")} AS without_keyword, {_J("list_concat(saved[1:1], words[2:2], saved[3:])")} AS promoted, '' AS without_exclude, 'ha-noi|hue|x' AS with_province, 'hue' AS without_province, 9 AS max_age FROM (SELECT d.*, words FROM d JOIN w USING (k))""")
def h19(spark, sf):
    p, s = drafts(spark, sf), F.col("saved")
    word = lambda i: F.upper(F.get("words", F.lit(i)))
    return p.select(
        "k", joined(D.without_keyword(s, word(0))["keywords"]).alias("without_keyword"), joined(D.with_promoted(s, F.coalesce(word(1), F.lit("")))["keywords"]).alias("promoted"), joined(D.without_exclude(s, F.upper("kind"))["excludes"]).alias("without_exclude"),
        joined(D.with_province(s, F.lit("x"), True)["provinces"]).alias("with_province"), joined(D.with_province(s, F.lit("ha-noi"), False)["provinces"]).alias("without_province"), D.with_max_age(s, F.lit(9))["max_age_days"].alias("max_age"),
    )
