"""Many terms, exact percentiles of large groups, and postings of every shape, against plain Python."""

from __future__ import annotations

import contextlib
import io
import json
import math
import random

import numpy as np
import pytest

from jobloom.operators import stats, terms
from jobloom.sources import postings_json as J


@pytest.mark.parametrize("whole", [False, True])
def test_terms_against_all_pairs(spark, whole):
    """Words of few letters, so that terms overlap and begin others; empty and null texts and terms; repeated rows."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    texts = [(k, " ".join(word() for _ in range(rng.randrange(12)))) for k in range(60)] + [(60, None), (61, ""), (62, " a  "), (5, "ab ab")]
    dictionary = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(120)}) + ["", None, "zzz"]
    got = sorted((r.k, r.term) for r in terms.find_terms(spark.createDataFrame(texts, "k int, key string"), spark.createDataFrame([(t, t) for t in dictionary], "term string, term_key string"), ["k"], whole=whole).collect())
    end = " " if whole else ""
    want = sorted((k, t) for k, x in texts for t in dictionary if x and t and f" {t}{end}" in f" {x.strip()} ")
    assert got == want and len(got) > 200


def test_no_terms(spark):
    none = terms.find_terms(spark.createDataFrame([(1, "a")], "k int, key string"), spark.createDataFrame([], "term string, term_key string"), ["k"])
    assert none.collect() == [] and none.columns == ["k", "term", "term_key"]


def test_the_plan_does_not_grow_with_the_terms(spark):
    texts = spark.createDataFrame([(1, "a b c")], "k int, key string")
    sizes = []
    for n in (10, 5000):
        dictionary = spark.range(n).selectExpr("lpad(cast(id as string), 4, '0') as term", "lpad(cast(id as string), 4, '0') as term_key")
        with contextlib.redirect_stdout(io.StringIO()) as out:
            terms.find_terms(texts, dictionary, ["k"]).explain()
        sizes.append(len(out.getvalue()))
    assert abs(sizes[0] - sizes[1]) < 50


def test_runs_are_joined_only_where_terms_begin(spark):
    """Beginnings of words come from heads of terms, not from every length that some term has; of runs that begin alike from one."""
    text = " ".join(f"x{k:04d}" for k in range(200)) + " gear gears gearing"
    kept = spark.createDataFrame([("x0001",), ("gea",), ("gearin",), *[("y" * n,) for n in range(1, 30)]], "_key string")
    shapes, few = terms._shapes(kept, False)
    grams = terms._grams(spark.createDataFrame([(1, text)], "k int, _text string"), ["k"], shapes, terms._heads(kept))
    got = sorted(r._key for r in grams.collect())
    assert few and got == sorted([f"x{k:04d}" for k in range(200)] + ["gea", "gearin"])


@pytest.mark.parametrize("parts, least", [(1024, 100_000), (50, 1), (20, 3)])
def test_percentiles(spark, parts, least):
    """Groups of one value, of equal values, of wide and of narrow ranges, null groups and values; ranges divided once or many times."""
    rng = random.Random(2)
    groups = {"one": [5.0], "same": [7.0] * 30, "wide": [rng.uniform(-1e9, 1e9) for _ in range(200)] + [1e15], "narrow": [1 + 1e-9 * rng.random() for _ in range(50)], None: [rng.randrange(10) * 1.0 for _ in range(99)], "two": [1.0, 2.0], "none": []}
    rows = [(g, h, v) for g, vs in groups.items() for h in (0, 1) for v in vs[h:]] + [("none", 0, None), ("two", 1, None)]
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {(r.g, r.h): r for r in stats.quantiles(spark.createDataFrame(rows, "g string, h int, v double"), ["g", "h"], "v", shares, parts, least).collect()}
    assert set(got) == {(g, h) for g, h, _ in rows}
    for (g, h), r in got.items():
        vs = groups[g][h:]
        assert r.n == len(vs)
        for name, q in shares.items():
            assert (r[name] is None) if not vs else math.isclose(r[name], float(np.quantile(vs, q)), rel_tol=1e-9), (g, h, name)


def test_percentiles_of_everything(spark):
    r = stats.quantiles(spark.range(1001), [], "id", {"p25": 0.25, "p50": 0.5}).collect()
    assert [tuple(x) for x in r] == [(1001, 250.0, 500.0)]
    assert stats.quantiles(spark.range(0), [], "id", {"p50": 0.5}).collect() == []


SHAPES = [
    {"@type": "JobPosting", "a": 1, "nested": {"@type": "JobPosting", "a": 2}}, [{"@type": "JobPosting", "a": 1}, {"@type": "Person"}, 5, None, {"@type": ["Thing", "x:JobPosting"], "a": 2}], {"@graph": [{"@type": "JobPosting", "a": 1}, {"@type": "Org"}]},
    {"@graph": {"@type": "JobPosting", "a": 1}}, {"items": [{"main": {"@type": "JobPosting", "a": 9}}]}, [[{"@type": "JobPosting", "a": 1}]], {"@type": "Person", "text": 'a "JobPosting" here'}, 5, "JobPosting", None, [], {}, {"@type": 7}, {"@type": ["JobPosting", 3]},
    {"@graph": [{"@type": "WebPage", "about": {"@type": "JobPosting", "a": 3}}, {"@type": "JobPosting", "a": 4}]},
]


def test_postings_of_every_shape(spark):
    """The native reading and the walk find the same nodes; plain ones need no Python."""
    rows = [(k, f'<script type="application/ld+json">{json.dumps(x)}</script>') for k, x in enumerate(SHAPES)] + [(98, '<script type="application/ld+json">{"@type":"JobPo\\u0073ting","a":1}</script><script type="application/ld+json">[{"x":{"@type":"\\u004aobPosting"}}]</script>'), (99, None)]
    df = spark.createDataFrame(rows, "page_id int, html string")
    key = lambda d: sorted((r.page_id, r.block, json.dumps(json.loads(r.posting), sort_keys=True)) for r in d.collect())
    assert key(J.all_postings(df)) == key(J.collect_postings(df))
    plain = J.plain_postings(df)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        plain.explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()
    assert {r.page_id for r in plain.collect()} >= {0, 1, 2, 13}
