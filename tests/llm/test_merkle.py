"""The Merkle manifest and numbers over ranges against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from jobloom.llm import merkle
from jobloom.llm.common import written
from jobloom.llm.ranking import numbered


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values) -> str:
    texts = [None if v is None else str(v) for v in values]
    return h(*("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def tree(nodes: list[str]) -> tuple[str, list[list[list[str]]]]:
    """The top, and each level's runs."""
    levels = []
    while len(nodes) > 1:
        runs = [nodes[i : i + merkle.FANOUT] for i in range(0, len(nodes), merkle.FANOUT)]
        levels.append(runs)
        nodes = [h(*r) for r in runs]
    return nodes[0], levels


def walk(levels, at: int, mine: str) -> tuple[str, list[str]]:
    """What `mine` in place of node `at` gives at the top, and the siblings on the way."""
    beside = []
    for runs in levels:
        run, k = list(runs[at // merkle.FANOUT]), at % merkle.FANOUT
        beside += run[:k] + run[k + 1 :]
        run[k] = mine
        mine, at = h(*run), at // merkle.FANOUT
    return mine, beside


def plain_manifest(rows) -> list[tuple]:
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        leaf = leaf_of((doc_id, source, lang, n_chars, text))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        changed = leaf_of((doc_id, source, lang, n_chars, None if text is None else text.translate({c: c + 32 for c in range(65, 91)}))) if hit else leaf
        by[source].append((doc_id is not None, doc_id or 0, leaf, doc_id, changed))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in by[s]])
    if not sources:
        return []
    root, over = tree([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (*_, leaf, doc_id, changed) in enumerate(by[s]):
            sub, beside = walk(trees[s][1], i, changed)
            folded, more = walk(over, k, sub)
            out.append((doc_id, leaf, trees[s][0], root, h(*beside, *more), folded, folded == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def ran(spark, rows, tmp_path, extra=()):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", *extra).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in merkle.op12_merkle(spark, str(tmp_path)).select(*COLUMNS).collect()]


def as_sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_trees_of_every_height(spark, tmp_path):
    """Sources of 1, 2, 16, 17, 256, 257 and 700 leaves, 40 lone ones, nulls in every column, long texts, repeated rows and ids."""
    rng = random.Random(3)
    rows = [(k, f"n{n:03d}", "en", k % 9, f"Text {k} of Some source") for n in (1, 2, 16, 17, 256, 257, 700) for k in rng.sample(range(5000), n)]
    rows += [(k, f"lone{k}", None, 1, "Ä and B") for k in range(40)]
    rows += [(None, None, None, None, None), (None, None, None, None, "x"), (7, "", "en", 0, ""), (7, "", "en", 0, ""), (7, "", "en", 0, "Other"), (8, "a:1", "-", -5, "LONG " * 40_000)]
    rows += [(9, "same", "en", 1, "The same row")] * 40
    rng.shuffle(rows)
    got = ran(spark, rows, tmp_path, ["1 as k", "'x' as hash", "2 as idx", "'l' as leaf", "0 as item"])
    assert as_sorted(got) == as_sorted(plain_manifest(rows))
    assert len({r[3] for r in got}) == 1 and not all(r[6] for r in got)


def test_one_source_one_row_and_none(spark, tmp_path):
    for k, rows in enumerate(([(1, "s", "en", 1, "A")], [(k, "s", "en", 1, f"A{k}") for k in range(20)], [])):
        assert as_sorted(ran(spark, rows, tmp_path / str(k))) == as_sorted(plain_manifest(rows))


def test_a_changed_leaf_never_folds_to_the_root(spark):
    """Real outputs: paths fold to the root from the leaf alone, from no other."""
    leaves = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    out = merkle.prove(leaves)
    good = merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")
    bad = merkle.fold(F.sha2("leaf", 256), F.col("path")) == F.col("root")
    assert out.agg(F.count_if(good), F.count_if(bad), F.max(F.size("path"))).first()[:] == (300, 0, 3)


def test_numbers_over_ranges(spark):
    """A group of half the rows lies in many ranges; numbers and totals go on from range to range."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(5)}", rng.choice([None, *range(50)]), rng.randrange(-(2**62), 2**62), rng.choice([None, 1, 2])) for _ in range(3000)]
    df = written(spark.createDataFrame(rows, "g string, o long, x long, s long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = numbered(df, ["g"], [F.col("o").asc_nulls_first()], {"x": "xor", "s": "sum"})
        got = sorted(out.collect(), key=lambda r: (r.g, r.place))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 3000
    before = None
    for r in got:
        new = before is None or before.g != r.g
        assert r.place == (0 if new else before.place + 1)
        assert new or (before.o is not None, before.o or 0) <= (r.o is not None, r.o or 0)
        assert r.x_to == (0 if new else before.x_to) ^ r.x
        assert r.s_to == (0 if new else before.s_to) + (r.s or 0)
        before = r
