"""Numbers and running totals in key order, computed range by range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.llm.common import written

#: Kind of running total -> (aggregate, how a range's own is added to what stands before it).
KINDS = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], running: dict[str, str] | None = None) -> DataFrame:
    """`rows` with `place`, a number from 0 without gaps within each `by` in the order `order`, and running totals.

    `running` maps long columns to "sum" or "xor"; `<column>_to` is the total within `by` up to and with the row. Rows are dealt to
    ranges of (by, order), numbered within a range, and moved by what the ranges before hold: a group of any size is
    spread over tasks, and only a line per group and range comes together. Rows that agree in `by` and `order` are told apart by their
    place in the input, so `rows` should be a written table. `by` columns hold no nulls; nulls in `running` count as 0.
    """
    running = running or {}
    keys = [*map(F.col, by)]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, *order, F.col("_tie"))
    dealt = written(dealt.withColumns({"_range": F.spark_partition_id()} | {c: F.coalesce(c, F.lit(0).cast("long")) for c in running}))
    within = Window.partitionBy(*by, "_range").orderBy(*order, "_tie")
    up_to = within.rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({"place": F.row_number().over(within).cast("long") - 1} | {f"{c}_to": KINDS[k][0](c).over(up_to) for c, k in running.items()})
    # Without `by` this is one line a range.
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"), *[KINDS[k][0](c).alias(f"_{c}") for c, k in running.items()])
    zero = F.lit(0).cast("long")
    totals = totals.select(*by, "_range", F.coalesce(F.sum("_n").over(earlier), zero).alias("_n"), *[F.coalesce(KINDS[k][0](f"_{c}").over(earlier), zero).alias(f"_{c}") for c, k in running.items()])
    out = local.join(totals, [*by, "_range"])
    out = out.withColumns({"place": F.col("place") + F.col("_n")} | {f"{c}_to": KINDS[k][1](F.col(f"{c}_to"), F.col(f"_{c}")) for c, k in running.items()})
    return out.drop("_range", "_tie", "_n", *[f"_{c}" for c in running])
