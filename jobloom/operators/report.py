"""Reports: the state of a corpus in one table, nested run logs, rows spread evenly over an order, similar postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.operators import stats
from jobloom.sources.store import shared_folder

UNKNOWN = "(không rõ)"


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """`rows` with their number from 0 in a total order: dealt to ranges and sorted there, each range numbered by itself and moved by those before it.

    Rows that agree in `order` come in any order. The driver's part is a line a range.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    # Numbers say the range and the row's place in it; written, so that they stay.
    rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(f"{folder}/sorted")
    dealt = spark.read.parquet(f"{folder}/sorted").withColumn("_range", F.shiftright("_id", 33))
    counts, starts, at = sorted(tuple(r) for r in dealt.groupBy("_range").count().collect()), [], 0
    for k, n in counts:
        starts.append((k, at))
        at += n
    moved = dealt.join(F.broadcast(spark.createDataFrame(starts, "_range long, _start long")), "_range")
    return moved.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_start") + F.col("_id") - F.shiftleft("_range", 33)).alias(name))


def evenly(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """`n` rows at equal steps through an order, with their `place`; all of them if there are no more."""
    numbered = placed(rows, order)
    total = numbered.count()
    if total <= n:
        return numbered
    step = total / n
    wanted = rows.sparkSession.createDataFrame([(int(i * step),) for i in range(n)], "place long")
    return numbered.join(F.broadcast(wanted), "place")


def hit_sample(entries: DataFrame, url: str, pattern: str, order: list[Column], n: int) -> DataFrame:
    """(kept, url, place, of): of the URLs that fit a pattern and of the others `n` each, spread evenly over their order, and how many there are."""
    fits = F.coalesce(F.col(url).rlike(pattern), F.lit(False))
    parts = []
    for kept, rows in ((True, entries.where(fits)), (False, entries.where(~fits))):
        total = rows.count()
        parts.append(evenly(rows, order, n).select(F.lit(kept).alias("kept"), F.col(url).alias("url"), "place", F.lit(total).cast("long").alias("of")))
    return reduce(DataFrame.union, parts)


def inspect_report(postings: DataFrame, locations: DataFrame, provinces: int = 8, recent: int = 5) -> DataFrame:
    """(section, label, n, percent): totals, postings by source, level and province, pay at its quarters, the latest postings.

    percent is of all postings, rounded half up, where a share is meant. Pay is the least of public postings, by nearest rank. An
    empty table gives the totals, all 0.
    """
    total = postings.count()
    share = lambda n: F.floor(n * 100 / F.lit(max(total, 1)) + 0.5).cast("long")
    row = lambda section, label, n, percent=None: (F.lit(section).alias("section"), label.cast("string").alias("label"), n.cast("long").alias("n"), (F.lit(None) if percent is None else percent).cast("long").alias("percent"))
    heads = {"companies": F.countDistinct("company_id"), "public pay": F.count_if("is_public"), "places": F.count("location_id"), "raw": F.count("raw_key"), "partial": F.count_if(F.col("parse_status") == "PARTIAL"), "expired": F.count_if(F.col("status") == "EXPIRED")}
    all_ = postings.agg(F.count("*").alias("postings"), *[c.alias(k) for k, c in heads.items()])
    lines = F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"`{k}`").alias("n"), (F.lit(None).cast("long") if k in ("postings", "companies") else share(F.col(f"`{k}`"))).alias("percent")) for k in ("postings", *heads)])
    parts = [all_.select(F.inline(lines)).select(*row("total", F.col("label"), F.col("n"), F.col("percent")))]
    parts.append(postings.groupBy("source_id").count().select(*row("source", F.col("source_id"), F.col("count"))))
    parts.append(postings.groupBy(F.coalesce("level", F.lit(UNKNOWN)).alias("level")).count().select(*row("level", F.col("level"), F.col("count"), share(F.col("count")))))
    # Counted before names are looked up: a line a place.
    places = postings.where("location_id is not null").groupBy("location_id").count().join(locations.select("location_id", "province"), "location_id", "left")
    parts.append(places.orderBy(F.desc("count"), "province").limit(provinces).select(*row("province", F.coalesce("province", F.lit("?")), F.col("count"))))
    pay = stats.nearest_rank(postings.where("is_public and salary_min is not null").select(F.lit(1).alias("_g"), "salary_min"), "_g", "salary_min", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    quarters = F.array(*[F.struct(F.lit(q).alias("label"), F.col(q).alias("n")) for q in ("p25", "p50", "p75")])
    parts.append(pay.select(F.inline(quarters)).select(*row("pay", F.col("label"), F.col("n"))))
    last = postings.orderBy(F.desc("posted_at"), F.desc("posting_id")).limit(recent)
    parts.append(last.select(*row("recent", F.col("external_id"), F.col("salary_min"))))
    return reduce(DataFrame.union, parts)


def runs_with_sources(runs: DataFrame, run_sources: DataFrame, sources: DataFrame, limit: int = 10) -> DataFrame:
    """The latest `runs` (run_id, started_at, ...) by start, each with `sources`: an array of its parts (id, run_id, source_id, ...) by id, code and name of the source within.

    The runs are chosen first; only their parts are joined. A run without parts has an empty array, a source that is unknown null names.
    """
    last = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(max(1, min(50, limit)))
    parts = run_sources.join(last.select("run_id"), "run_id", "left_semi").join(sources.select("source_id", "code", "name"), "source_id", "left")
    own = [c for c in run_sources.columns if c not in ("id", "run_id")]
    nested = parts.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("id", *own, "code", "name"))).alias("sources"))
    return last.join(nested, "run_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast(nested.schema["sources"].dataType)))


def similar(items: DataFrame, mine: int, kind: str, order: list[Column], n: int = 3, id_col: str = "posting_id") -> DataFrame:
    """Up to `n` of a field's `items` beside the one with id `mine`: those of its `kind` (say, type of purchase) first, then as the list goes."""
    own = items.where(F.col(id_col) == mine).select(kind).limit(1).scalar()
    return items.where(F.col(id_col) != mine).orderBy(F.desc(F.col(kind).eqNullSafe(own)), *order).limit(n)


def in_label_order(facets: DataFrame, label: str = "label", language: str = "vi") -> list[Column]:
    """How facets (n, label) are ordered: most first, equal ones as a language orders words."""
    return [F.desc("n"), F.collate(F.col(label), language), F.col(label)]
