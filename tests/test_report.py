"""Reports on small tables of our own."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from jobloom.operators import report as R


def test_places_over_ranges(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, *range(40)])) for k in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = R.placed(spark.createDataFrame(rows, "k int, v int").repartition(5), [F.col("v").asc_nulls_first(), F.col("k")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(500))
    assert R.placed(spark.range(0), [F.col("id")]).collect() == []


@pytest.mark.parametrize("total, n", [(0, 3), (2, 3), (3, 3), (10, 3), (97, 12)])
def test_even_samples(spark, total, n):
    got = sorted(r.id for r in R.evenly(spark.range(total), [F.col("id")], n).collect())
    assert got == (list(range(total)) if total <= n else [int(i * (total / n)) for i in range(n)])


def test_runs_with_their_sources(spark):
    runs = spark.createDataFrame([(1, "2026-01-01"), (2, "2026-01-03"), (3, "2026-01-02")], "run_id int, started_at string")
    parts = spark.createDataFrame([(12, 2, 7, 5), (11, 2, 8, 6), (13, 1, 7, 1), (14, 2, 99, 0)], "id int, run_id int, source_id int, jobs int")
    sources = spark.createDataFrame([(7, "a", "A"), (8, "b", "B")], "source_id int, code string, name string")
    got = R.runs_with_sources(runs, parts, sources, 2).orderBy(F.desc("started_at")).collect()
    assert [(r.run_id, [(s.id, s.jobs, s.code, s.name) for s in r.sources]) for r in got] == [(2, [(11, 6, "b", "B"), (12, 5, "a", "A"), (14, 0, None, None)]), (3, [])]


def test_similar_ones_of_the_same_kind_come_first(spark):
    items = spark.createDataFrame([(1, "a", 9), (2, "b", 8), (3, "a", 1), (4, None, 7), (5, "a", 2)], "posting_id int, kind string, day int")
    order = [F.desc("day")]
    assert [r.posting_id for r in R.similar(items, 1, "kind", order).collect()] == [5, 3, 2]
    assert [r.posting_id for r in R.similar(items, 4, "kind", order).collect()] == [1, 2, 5]
    assert [r.posting_id for r in R.similar(items, 77, "kind", order, 1).collect()] == [4]


def test_labels_in_vietnamese_order(spark):
    rows = [(1, x) for x in ("Đà", "Dung", "Em", "Ăn", "An", "Ân", "Bo")] + [(2, "Z")]
    got = [r.label for r in spark.createDataFrame(rows, "n int, label string").orderBy(*R.in_label_order(None)).collect()]
    assert got == ["Z", "An", "Ăn", "Ân", "Bo", "Dung", "Đà", "Em"]


def test_report_of_nothing(spark):
    empty = spark.createDataFrame([], "posting_id long, company_id long, location_id long, source_id long, external_id string, status string, level string, is_public boolean, salary_min long, posted_at timestamp, raw_key string, parse_status string")
    got = R.inspect_report(empty, spark.createDataFrame([], "location_id long, province string")).collect()
    assert {r.section for r in got} == {"total"} and all(r.n == 0 for r in got)
