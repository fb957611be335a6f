"""Facets: each counted under all other filters, bands kept when empty, hints when nothing is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "__none"


def flags(chosen: dict[str, list[str]]) -> dict[str, Column]:
    """dimension -> whether a row passes its choice; no choice passes all, null counts as NONE."""
    return {d: F.coalesce(F.col(d), F.lit(NONE)).isin(values) if values else F.lit(True) for d, values in chosen.items()}


def self_excluding(rows: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """(dim, value, n): every facet's counts with all other filters applied, from one pass and one shuffle."""
    ok = flags(chosen)
    others = lambda d: reduce(lambda a, b: a & b, [v for k, v in ok.items() if k != d], F.lit(True))
    each = F.array(*[F.when(others(d), F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d), F.lit(NONE)).alias("value"))) for d in chosen])
    return rows.select(F.explode(F.array_compact(each)).alias("f")).groupBy("f.dim", "f.value").agg(F.count("*").alias("n"))


def kept(rows: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    return rows.where(reduce(lambda a, b: a & b, flags(chosen).values(), F.lit(True)))


def relax_hints(rows: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """(dim, n): what clearing each active choice would leave, where that is something and nothing is left now."""
    ok = flags(chosen)
    active = [d for d, values in chosen.items() if values]
    without = lambda d: reduce(lambda a, b: a & b, [v for k, v in ok.items() if k != d], F.lit(True))
    counts = rows.agg(F.count_if(reduce(lambda a, b: a & b, ok.values(), F.lit(True))).alias("total"), *[F.count_if(without(d)).alias(d) for d in active])
    return counts.where("total = 0").select(F.inline(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("n")) for d in active]))).where("n > 0")


def banded(rows: DataFrame, band: Column, order: list[str]) -> DataFrame:
    """(pos, band, n) in the given order, empty bands with zero."""
    spine = rows.sparkSession.createDataFrame(list(enumerate(order)), "pos int, band string")
    return spine.join(rows.groupBy(band.alias("band")).agg(F.count("*").alias("n")), "band", "left").select("pos", "band", F.coalesce("n", F.lit(0)).alias("n"))
