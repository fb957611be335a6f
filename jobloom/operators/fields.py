"""Fields: postings in a field's scope, judged by its dictionary, filtered, counted and paged."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import classify as C
from jobloom.functions.salary import facet_value
from jobloom.functions.text import match_key
from jobloom.operators import facets, stats
from jobloom.operators.search import cut, page_start

PAGE = 30
FRESH_HOURS = 24


@dataclass
class Definition:
    """A field: its terms (gray ones behind '~'), and its scope; empty scopes hold everything."""

    slug: str
    keywords: list[str]
    excludes: list[str] = field(default_factory=list)
    provinces: list[str] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)
    max_age_days: int | None = None
    tech: bool = False

    def terms(self) -> tuple[list[str], list[str]]:
        """(strong, gray) terms."""
        return [t for t in self.keywords if not t.startswith("~")], [t[1:] for t in self.keywords if t.startswith("~")]

    def scope_key(self) -> str:
        """The same text for the same scope, in whatever order it is written: candidates can be kept under it."""
        return json.dumps({"provinces": sorted(self.provinces), "levels": sorted(self.levels), "maxAgeDays": self.max_age_days}, separators=(",", ":"))


@dataclass
class Request:
    """What a page asks for: chosen values by dimension (see `DIMENSIONS`), a text, whether weak matches and far places count."""

    chosen: dict[str, list[str]] = field(default_factory=dict)
    q: str = ""
    include_weak: bool = False
    strict: bool = False
    page: int | None = 1
    cumulative: bool = False


#: Dimensions with a value in a column of `judged`; skills are arrays and any of the chosen ones is enough.
DIMENSIONS = ["district", "saturday", "years", "pay", "work_mode", "level"]


def only_known(values: list[str], known: list[str]) -> list[str]:
    """Chosen values that are still offered: old links keep working."""
    return [v for v in values if v in known]


def in_scope(d: Definition, as_of: Column) -> Column:
    """Of rows (provinces: array, level, posted_at)."""
    tests = [F.arrays_overlap("provinces", F.array(*map(F.lit, d.provinces)))] if d.provinces else []
    tests += [F.col("level").isin(*d.levels)] if d.levels else []
    tests += [F.col("posted_at") >= as_of - F.expr(f"interval {d.max_age_days} days")] if d.max_age_days else []
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def match(d: Definition) -> Column:
    strong, gray = d.terms()
    return C.match_field(F.col("title"), F.col("description"), strong, gray, d.excludes, d.tech)


def is_in_field(verdict: Column) -> Column:
    return verdict != "reject"


def judge(rows: DataFrame, d: Definition, as_of: Column) -> DataFrame:
    """`rows` with in_scope, match and listed: in scope and a strong match."""
    out = rows.withColumns({"in_scope": in_scope(d, as_of), "match": match(d)})
    return out.withColumn("listed", F.col("in_scope") & (F.col("match.verdict") == "strong"))


def hits_text(q: str) -> Column:
    """Whether a folded text stands in a posting's title or company."""
    needle = match_key(F.lit(q))
    return match_key(F.col("title")).contains(needle) | match_key(F.col("company")).contains(needle)


def judged(candidates: DataFrame, d: Definition, r: Request) -> DataFrame:
    """Candidates with far, accepted, hit, weak and the dimensions' values: what all counts of a page come from.

    Candidates have (posting_id, title, description, company, source, posted_at, checked_at, level, years_min, work_mode, district, saturday, salary columns, places: array, skills: array).
    """
    far = ~C.is_narrow(F.col("places")) if r.strict else F.lit(False)
    pay = facet_value(F.col("is_public"), F.col("salary_min"), F.col("salary_max"))
    out = candidates.withColumns({"far": F.coalesce(far, F.lit(False)), "match": match(d), "pay_value": pay, "hit": hits_text(r.q) if r.q.strip() else F.lit(True)})
    accepted = ~F.col("far") & is_in_field(F.col("match.verdict"))
    return out.withColumns({"accepted": accepted, "weak": accepted & F.col("hit") & (F.col("match.verdict") == "weak"), "years": C.experience_band(F.col("years_min")), "pay": C.salary_band(F.col("pay_value"))}).withColumn("in_field", accepted & F.col("hit") & (~F.col("weak") | F.lit(r.include_weak)))


def skill_flag(r: Request) -> Column:
    wanted = r.chosen.get("skills", [])
    return F.coalesce(F.arrays_overlap("skills", F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else F.lit(True)


def _chosen(r: Request) -> dict[str, list[str]]:
    return {d: r.chosen.get(d, []) for d in DIMENSIONS}


def passes(r: Request, but: str | None = None) -> Column:
    """Whether a row passes all choices, or all but one dimension's."""
    flags = facets.flags(_chosen(r)) | {"skills": skill_flag(r)}
    return reduce(lambda a, b: a & b, [v for k, v in flags.items() if k != but], F.lit(True))


def counters(rows: DataFrame, r: Request, as_of: Column) -> DataFrame:
    """One row of figures over `judged` rows: what was scanned, dropped, accepted, hidden, is in the field, and what of it matches."""
    inside, final = F.col("in_field"), F.col("in_field") & passes(r)
    has = {"district": F.col("district"), "saturday": F.col("saturday"), "years": F.col("years_min"), "pay": F.col("pay_value"), "work_mode": F.col("work_mode"), "level": F.col("level")}
    return rows.agg(
        F.count("*").alias("scanned"), F.count_if("far").alias("dropped_far"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("weak") & ~inside).alias("weak_hidden"), F.count_if(inside).alias("in_field"), F.count_if(final).alias("total"),
        F.count_if(final & (F.col("match.verdict") == "strong")).alias("strong"), F.count_if(final & (F.col("checked_at") >= as_of - F.expr(f"interval {FRESH_HOURS} hours"))).alias("fresh"), F.count_if(final & (F.col("posted_at") >= as_of - F.expr("interval 24 hours"))).alias("posted_24h"),
        F.count(F.when(final, F.col("pay_value"))).alias("pay_sample"), stats.median(F.when(final, F.col("pay_value"))).alias("pay_median"), *[F.count(F.when(inside, c)).alias(f"with_{k}") for k, c in has.items()], F.count_if(inside & (F.size("skills") > 0)).alias("with_skills"),
    )


def facet_counts(rows: DataFrame, r: Request) -> DataFrame:
    """(dim, value, n) of all dimensions and skills, each under all other choices: one pass, one shuffle."""
    inside = rows.where("in_field")
    others = lambda d: passes(r, d)
    one = lambda d: F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d), F.lit(facets.NONE)).alias("value"))
    each = F.concat(F.array_compact(F.array(*[F.when(others(d), one(d)) for d in DIMENSIONS])), F.when(others("skills"), F.transform("skills", lambda s: F.struct(F.lit("skills").alias("dim"), s.alias("value")))).otherwise(F.array().cast("array<struct<dim:string,value:string>>")))
    return inside.select(F.explode(each).alias("f")).groupBy("f.dim", "f.value").agg(F.count("*").alias("n"))


def count_by(rows: DataFrame, key: Column, seq: Column) -> DataFrame:
    """(value, n, place): frequencies from the greatest, those that agree by where they were first seen; null keys don't count."""
    per = rows.where(key.isNotNull()).groupBy(key.alias("value")).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return per.orderBy(F.desc("n"), "first").select("value", "n", "first")


def items(rows: DataFrame, r: Request, size: int = PAGE) -> DataFrame:
    """A page of what is left: strong matches before weak ones, then the newest. A page beyond the last one, or None, is the last.

    What is left is kept, so that counting it and cutting the page from it judge the rows once.
    """
    final = rows.where(F.col("in_field") & passes(r)).persist()
    total, strong = final.count(), F.col("match.verdict") == "strong"
    start, ahead = page_start(r.page, total, size), [F.desc(strong), F.desc("posted_at"), F.asc("posting_id")]
    return final.orderBy(*ahead).limit(start + size) if r.cumulative else cut(final, total, start, size, ahead, [F.asc(strong), F.asc("posted_at"), F.desc("posting_id")])
