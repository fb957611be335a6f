"""Statistics over postings: DataFrame -> DataFrame, time always an argument."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.functions.salary import stats_value
from jobloom.sources.model import ALIVE
from jobloom.sources.store import shared_folder


def alive() -> Column:
    return F.col("status").isin(ALIVE)


def disclosed() -> Column:
    return F.col("is_public") & (F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull())


def value() -> Column:
    return stats_value(F.col("salary_min"), F.col("salary_max"))


def whole(c: Column) -> Column:
    """Rounded half to even, as a long."""
    return F.bround(c, 0).cast("long")


def quantile(q: float, c: Column) -> Column:
    return whole(F.percentile(c, q))


def overview(postings: DataFrame, as_of: Column) -> DataFrame:
    """All head figures in one pass. Posted today and by week count every status, the last 24 hours alive ones only."""
    days = lambda a, b: (F.col("posted_at") >= as_of - F.expr(f"interval {a} days")) & (F.col("posted_at") < as_of - F.expr(f"interval {b} days"))
    return postings.agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OPEN", "STALE", "EXPIRED", "CLOSED")], F.count_if(alive()).alias("alive"), F.count_if(alive() & disclosed()).alias("with_salary"),
        F.countDistinct(F.when(alive(), F.col("company_id"))).alias("companies"), F.countDistinct(F.when(alive(), F.col("source_id"))).alias("live_sources"),
        F.count_if(days(0, -1)).alias("posted_today"), F.count_if(alive() & days(1, 0)).alias("last_24h"), F.count_if(days(7, 0)).alias("last_7d"), F.count_if(days(14, 7)).alias("prev_7d"), F.max("checked_on").alias("last_check"),
    )


def daily_intake(postings: DataFrame, last_day: Column, span: int = 30) -> DataFrame:
    """Postings a day on a calendar without gaps; days are those of the +07:00 zone."""
    span = min(max(span, 1), 180)
    spine = postings.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last_day, span - 1), last_day)).alias("day"))
    per_day = postings.groupBy(F.to_date(F.col("posted_at") + F.expr("interval 7 hours")).alias("day")).agg(F.count("*").alias("n"))
    return spine.join(per_day, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def salary_by(postings: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Quartiles of disclosed pay per key with `least` values at least, beside all alive postings."""
    v = F.when(disclosed(), value())
    out = postings.where(alive() & F.col(key).isNotNull()).groupBy(key).agg(F.count(v).alias("sample"), F.count("*").alias("total"), *[quantile(q, v).alias(n) for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return out.where(F.col("sample") >= least)


def salary_overall(postings: DataFrame) -> DataFrame:
    v = F.when(disclosed(), value())
    return postings.where(alive()).agg(F.count(v).alias("sample"), *[quantile(q, v).alias(n) for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])


def salary_by_province(postings: DataFrame, locations: DataFrame, limit: int = 10, least: int = 3) -> DataFrame:
    """Provinces by alive postings, with the median of public pay. A posting counts in each of its places; a public one without bounds counts in the sample but has no value."""
    rows = postings.where(alive()).join(locations, "location_id")
    out = rows.groupBy("province").agg(F.count("*").alias("total"), F.count_if("is_public").alias("sample"), quantile(0.5, F.when(F.col("is_public"), value())).alias("p50"))
    return out.where(F.col("sample") >= least).orderBy(F.desc("total"), "province").limit(min(max(limit, 1), 34))


def salary_histogram(postings: DataFrame, step: int = 5_000_000, cap: int = 60_000_000) -> DataFrame:
    """Disclosed pay in steps up to the cap, empty steps kept."""
    v = value()
    buckets = postings.where(alive() & disclosed() & (v > 0)).groupBy(F.least(F.floor(v / step) * step, F.lit(cap)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    spine = postings.sparkSession.range(0, cap + 1, step).select(F.col("id").alias("bucket"))
    return spine.join(buckets, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def top(postings: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The keys with most alive postings, ties by key."""
    return postings.where(alive()).groupBy(key).agg(F.count("*").alias("n"), F.count_if(disclosed()).alias("with_salary")).orderBy(F.desc("n"), key).limit(min(max(limit, 1), 50))


def level_spread(postings: DataFrame) -> DataFrame:
    return postings.where(alive()).groupBy(F.coalesce("level", F.lit("UNKNOWN")).alias("level")).agg(F.count("*").alias("n"))


def source_health(postings: DataFrame, sources: DataFrame) -> DataFrame:
    """Figures of every source, those without postings too."""
    per = postings.groupBy("source_id").agg(F.count_if(alive()).alias("alive"), F.count("*").alias("total"), F.count_if(alive() & disclosed()).alias("with_salary"), F.count_if(F.col("parse_status") == "FAILED").alias("failed"), F.max("checked_on").alias("last_seen"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("alive", "total", "with_salary", "failed")}
    return sources.join(per, "source_id", "left").withColumns(zero).select("source_id", "source", "alive", "total", "with_salary", "failed", "last_seen")


def median(c: Column) -> Column:
    """Exact median, the mean of two middles rounded half up; null for none."""
    return F.floor(F.percentile(c, 0.5) + 0.5).cast("long")


def nearest_rank(rows: DataFrame, group: str, value: str, shares: dict[str, float], width: float = 1_000_000) -> DataFrame:
    """(group, n, a column for each share q): the value at index floor(n * q) of each group's ordered values, the last at most; null values don't count.

    Values are counted in buckets of `width`; only those in the buckets where the ranks fall are put in order, each
    distinct one once, so that a group of any size is neither collected nor sorted in one task.
    """
    v = rows.where(F.col(value).isNotNull()).select(group, F.col(value).alias("v"), F.floor(F.col(value) / width).cast("long").alias("b"))
    upto = lambda keys, by: F.sum("m").over(Window.partitionBy(*keys).orderBy(by))
    buckets = v.groupBy(group, "b").agg(F.count("*").alias("m")).withColumns({"end": upto([group], "b"), "n": F.sum("m").over(Window.partitionBy(group))})
    at = F.explode(F.array(*[F.struct(F.lit(name).alias("share"), F.least(F.floor(F.col("n") * q), F.col("n") - 1).alias("at")) for name, q in shares.items()]))
    wanted = buckets.select(group, "b", "n", (F.col("end") - F.col("m")).alias("before"), at.alias("w")).select(group, "b", "n", "before", "w.*").where((F.col("at") >= F.col("before")))
    wanted = wanted.groupBy(group, "share", "n", "at").agg(F.max_by(F.struct("b", "before"), "b").alias("x")).select(group, "share", "n", "at", "x.*")
    few = v.join(wanted.select(group, "b").distinct(), [group, "b"], "left_semi").groupBy(group, "b", "v").agg(F.count("*").alias("m")).withColumn("end", upto([group, "b"], "v"))
    hit = few.join(wanted, [group, "b"]).where((F.col("at") < F.col("before") + F.col("end")) & (F.col("at") >= F.col("before") + F.col("end") - F.col("m")))
    return hit.groupBy(group).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("share") == name, F.col("v"))).alias(name) for name in shares])


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], parts: int = 1024, least: int = 100_000) -> DataFrame:
    """(keys..., n, a double for each share q): exact percentiles of each group's values between ranks, n the non-null values; a group without one has null.

    The value at (n - 1) * q, between two neighbours in proportion. Values are counted in `parts` equal parts of the group's range; a
    part in which a wanted rank falls is divided again until it holds at most `least` distinct values (or one), and only then put in
    order, distinct values with their counts. A group of any size, with any number of distinct values, is thus counted, never collected.
    """
    v = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("v"))
    # Groups by one name, null keys included.
    names = [f"_k{i}" for i in range(len(keys))]
    v = v.select(F.struct(*names).alias("g") if names else F.struct(F.lit(1).alias("_k")).alias("g"), "v")
    groups = v.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    rank = lambda q: (F.col("n") - 1) * F.lit(float(q))
    wanted = F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(rank(q)), F.ceil(rank(q))) for q in shares.values()])))).alias("at")
    # (g, at, lo, hi, before): the value of rank `at` lies in [lo, hi], before which stand `before` values.
    open_ = groups.where("n > 0").select("g", wanted, "lo", "hi", F.lit(0).cast("long").alias("before"))
    own = v.where("v is not null")
    folder, found, spark = shared_folder(rows.sparkSession), None, rows.sparkSession
    for k in itertools.count():
        ranges = open_.select("g", "lo", "hi", "before").distinct()
        inside = own.join(ranges, "g").where("v >= lo and v <= hi")
        # Equal bounds are one value.
        part = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts), F.lit(parts - 1))).otherwise(0)
        cells = inside.groupBy("g", "lo", "hi", "before", part.alias("part")).agg(F.count("*").alias("m"), F.min("v").alias("a"), F.max("v").alias("b"), F.approx_count_distinct("v").alias("d"))
        upto = F.sum("m").over(Window.partitionBy("g", "lo", "hi", "before").orderBy("part"))
        cells = cells.withColumn("end", F.col("before") + upto).withColumn("start", F.col("end") - F.col("m")).select("g", "lo", "hi", "before", "start", "end", "a", "b", "d")
        hit = open_.join(cells, ["g", "lo", "hi", "before"]).where("at >= start and at < end").select("g", "at", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("start").alias("before"), "d")
        # Written, so that the next round begins here.
        hit.write.parquet(f"{folder}/{k}")
        hit = spark.read.schema(hit.schema).parquet(f"{folder}/{k}")
        ready = hit.where((F.col("d") <= least) | (F.col("lo") == F.col("hi")))
        few = own.join(ready.select("g", "lo", "hi", "before").distinct(), "g").where("v >= lo and v <= hi").groupBy("g", "lo", "hi", "before", "v").agg(F.count("*").alias("m"))
        few = few.withColumn("end", F.col("before") + F.sum("m").over(Window.partitionBy("g", "lo", "hi", "before").orderBy("v")))
        values = few.join(ready.select("g", "lo", "hi", "before", "at"), ["g", "lo", "hi", "before"]).where((F.col("at") < F.col("end")) & (F.col("at") >= F.col("end") - F.col("m"))).select("g", "at", "v")
        found = values if found is None else found.union(values)
        open_ = hit.where((F.col("d") > least) & (F.col("lo") < F.col("hi"))).select("g", "at", "lo", "hi", "before")
        if not open_.limit(1).count():
            break
    ranks = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("v"))

    def between(q: float) -> Column:
        low, high = F.try_element_at("v", F.floor(rank(q))), F.try_element_at("v", F.ceil(rank(q)))
        return low + (high - low) * (rank(q) - F.floor(rank(q)))

    out = groups.select("g", "n").join(ranks, "g", "left")
    return out.select(*[F.col(f"g._k{i}").alias(k) for i, k in enumerate(keys)], "n", *[between(q).alias(name) for name, q in shares.items()])


def salary_by_refined(postings: DataFrame, key: str, least: int = 3) -> DataFrame:
    """`salary_by` for groups of any number of distinct values."""
    rows = postings.where(alive() & F.col(key).isNotNull()).withColumn("_v", F.when(disclosed(), value()))
    q = quantiles(rows, [key], "_v", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    total = rows.groupBy(key).agg(F.count("*").alias("total"))
    return q.where(F.col("n") >= least).join(total, key).select(key, F.col("n").alias("sample"), "total", *[whole(F.col(c)).alias(c) for c in ("p25", "p50", "p75")])


def run_rollup(runs: DataFrame) -> DataFrame:
    """(run_id, ok boolean, seen, error) -> one row a run: FAILED if all parts failed, PARTIAL if any, else SUCCESS."""
    out = runs.groupBy("run_id").agg(F.sum("seen").alias("seen"), F.count_if(~F.col("ok")).alias("bad"), F.count("*").alias("parts"), F.array_join(F.array_sort(F.collect_list("error")), "\n").alias("errors"))
    return out.select("run_id", "seen", F.when(F.col("bad") == F.col("parts"), "FAILED").when(F.col("bad") > 0, "PARTIAL").otherwise("SUCCESS").alias("status"), "errors")


def median_by_skill(rows: DataFrame, least: int = 5, limit: int = 8) -> DataFrame:
    """(posting_id, skill, v) distinct -> skills by median pay: all postings, those with a value, and the median."""
    out = rows.groupBy("skill").agg(F.count("*").alias("n"), F.count("v").alias("sample"), median(F.col("v")).alias("median"))
    return out.where(F.col("sample") >= least).orderBy(F.desc("median"), "skill").limit(limit)


def recent(rows: DataFrame, key: str, at: Column, now: Column) -> DataFrame:
    """(key, last_24h, last_7d, prev_7d): rows in windows that end now."""
    back = lambda hours: at > now - F.expr(f"interval {hours} hours")
    return rows.groupBy(key).agg(F.count_if(back(24)).alias("last_24h"), F.count_if(back(168)).alias("last_7d"), F.count_if(back(336) & ~back(168)).alias("prev_7d"))
