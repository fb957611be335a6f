"""Merkle manifest of a dataset: levels of hashes built by grouping numbered nodes, and every leaf's proof."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import table, written
from jobloom.llm.ranking import numbered

#: So many consecutive nodes have one parent.
FANOUT = 16
#: The columns that a leaf's hash covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def joined(parts: Column) -> Column:
    """H of an array of strings: the lowercase hex sha256 of all of them in a row."""
    return F.sha2(F.array_join(parts, ""), 256)


def leaf_hash(fields: Sequence[Column]) -> Column:
    """H of a row's values, each `-` if null, else its UTF-8 byte count, `:` and the value."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the (before, after) siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x.before, h, x.after), 256))


def proof_hash(path: Column) -> Column:
    """H of a path's siblings, level by level, left to right."""
    return joined(F.transform(path, lambda x: F.concat(x.before, x.after)))


def _beside(hashes: Column, pos: Column) -> Column:
    """The siblings before and after place `pos` of a run."""
    before, after = F.slice(hashes, F.lit(1), pos), F.slice(hashes, pos + 2, F.lit(FANOUT))
    return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))


def _climb(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs by level, and every tree's top: (k, level, hash) at the level where one node remains.

    nodes: (k, idx, n, hash, item), n the nodes of tree k at this level, at most `most`. A run: (k, g, n, children, hash).
    """
    runs, tops, level = [], [], 0
    while True:
        tops.append(nodes.where("n = 1").select("k", F.lit(level).alias("level"), "hash"))
        if most <= 1:
            return runs, reduce(DataFrame.union, tops)
        child = F.struct("idx", "hash", *(["item"] if not level else []))
        run = nodes.where("n > 1").groupBy("k", F.expr(f"idx div {FANOUT}").alias("g"), "n").agg(F.array_sort(F.collect_list(child)).alias("children"))
        run = written(run.withColumn("hash", joined(F.transform("children", lambda x: x.hash))))
        runs.append(run)
        nodes = run.select("k", F.col("g").alias("idx"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), "hash")
        most, level = -(-most // FANOUT), level + 1


def _descend(nodes: DataFrame, runs: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(k, item, hash, crown, path) for all `nodes`; tops: (k, level, crown, path) gives what stands above each tree's top.

    From the highest level down, a run's path is its children's behind their siblings: an upper node's path is made
    once for all that stand below it.
    """
    at_top = lambda level: tops.where(F.col("level") == level).select("k", F.lit(0).cast("long").alias("g"), "crown", "path")
    below, above = None, at_top(len(runs))
    for level in reversed(range(len(runs))):
        both = runs[level].select("k", "g", "children").join(above, ["k", "g"])
        both = both.select("k", F.transform("children", lambda x: x.hash).alias("hashes"), F.posexplode("children").alias("pos", "child"), "crown", "path")
        below = both.select("k", "child", "crown", F.concat(F.array(_beside(F.col("hashes"), F.col("pos"))), F.col("path")).alias("path"))
        if level:
            above = below.select("k", F.col("child.idx").alias("g"), "crown", "path").union(at_top(level))
    lone = nodes.where("n = 1").join(at_top(0), "k").select("k", "item", "hash", "crown", "path")
    return lone if below is None else below.select("k", "child.item", "child.hash", "crown", "path").union(lone)


def prove(leaves: DataFrame, source_col: str = "source", order_col: str = "doc_id", leaf_col: str = "leaf") -> DataFrame:
    """(item, leaf, subroot, root, path), a row per row of `leaves`: item holds all its columns, path the siblings on the way to the root.

    A tree for each source, its leaves in the order of `order_col` (null first; equal ones by their hash, repeated rows by
    their place in the input); while several nodes remain, every FANOUT consecutive ones get a parent, even a last one alone. The
    subroots, in the order of their source (null first, bytewise), give the root in the same way. path: array of (before, after), the
    hashes left and right of the node at each level in a row; `fold` gives the root back from them. `leaves` is a table
    of small rows. Any source may hold any share of the rows; so may any one id. An empty table gives an empty result.
    """
    # '' stands for the null source, before all others.
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit(""))
    rows = written(leaves.select(key.alias("k"), F.col(f"`{order_col}`").alias("by"), F.col(f"`{leaf_col}`").alias("hash"), F.struct(*[F.col(f"`{c}`") for c in leaves.columns]).alias("item")))
    count = rows.groupBy("k").agg(F.count("*").alias("n"))
    most, trees = count.agg(F.max("n"), F.count("*")).first()
    placed = numbered(rows, ["k"], [F.col("by").asc_nulls_first(), F.col("hash")])
    nodes = written(placed.join(count, "k").select("k", F.col("place").alias("idx"), "n", "hash", "item"))
    runs, tops = _climb(nodes, most or 0)
    tops = written(tops)
    crowns = numbered(tops, [], [F.col("k")]).select(F.lit("").alias("k"), F.col("place").alias("idx"), F.lit(trees).cast("long").alias("n"), "hash", F.struct(F.col("k").alias("tree"), "level").alias("item"))
    crowns = written(crowns)
    over, top = _climb(crowns, trees)
    none = F.array().cast("array<struct<before:string,after:string>>")
    proven = _descend(crowns, over, top.select("k", "level", F.struct(F.col("hash").alias("root")).alias("crown"), none.alias("path")))
    tops = written(proven.select(F.col("item.tree").alias("k"), "item.level", F.struct(F.col("hash").alias("subroot"), "crown.root").alias("crown"), "path"))
    return _descend(nodes, runs, tops).select("item", F.col("hash").alias("leaf"), "crown.subroot", "crown.root", "path")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof; where 5 divides crc32(doc_id), the leaf that is folded is that of a changed text."""
    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = [*columns[:-1], F.translate("text", UPPER, LOWER)]
    leaf = leaf_hash(columns)
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(hit, leaf_hash(changed)).alias("changed"))
    out = prove(rows)
    folded = fold(F.coalesce("item.changed", "leaf"), F.col("path"))
    out = out.select("item.doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a string of ASCII characters, bit by bit."""
    bits = f"list_transform(range(8 * length({text})), lambda i: (ascii(substr({text}, CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INTEGER)) & 1)"
    return f"xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda x, bit: xor(x >> 1, 3988292384 * (xor(x, bit) & 1))))"


#: Levels that the SQL goes up: 16^6 leaves a source, as many sources.
_LEVELS = 6
_FIELD = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD(text if c == "text" else c) for c in FIELDS) + ")"


def _climb_sql(name: str) -> str:
    """{name}1 ... from {name}0 (k, idx, n, h): a level's nodes; where one remains it is carried on."""
    up = "SELECT k, idx // {f} AS idx, (n + {g}) // {f} AS n, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM {t} GROUP BY k, idx // {f}, n"
    return ",\n".join(f"{name}{i + 1} AS ({up.format(f=FANOUT, g=FANOUT - 1, t=f'{name}{i}')})" for i in range(_LEVELS))


def _walk_sql(name: str, start: str, proof: str, fold: str, keys: str) -> str:
    """{name}w1 ... from `start` (id, k, idx, proof, folded, ...): each level's siblings behind the proof, and the hash with them."""
    out = []
    for i in range(_LEVELS):
        t = f"{name}w{i}" if i else start
        out.append(
            f"{name}w{i + 1} AS (SELECT t.id, {keys} t.idx // {FANOUT} AS idx, CASE WHEN any_value(s.n) = 1 THEN t.{proof} ELSE t.{proof} || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (WHERE s.idx <> t.idx), '') END AS {proof}, "
            f"CASE WHEN any_value(s.n) = 1 THEN t.{fold} ELSE sha256(string_agg(CASE WHEN s.idx = t.idx THEN t.{fold} ELSE s.h END, '' ORDER BY s.idx)) END AS {fold} "
            f"FROM {t} t JOIN {name}{i} s ON s.k = t.k AND s.idx // {FANOUT} = t.idx // {FANOUT} GROUP BY t.id, {keys} t.idx, t.{proof}, t.{fold})"
        )
    return ",\n".join(out)


OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS src, {_LEAF("text")} AS leaf,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_LEAF(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed
  FROM documents),
a0 AS (SELECT id, src AS k, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY src) AS n, leaf AS h FROM d),
{_climb_sql("a")},
b0 AS (SELECT k AS src, '' AS k, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n, h FROM a{_LEVELS}),
{_climb_sql("b")},
s AS (SELECT a0.id, a0.k, a0.idx, '' AS proof, coalesce(d.changed, d.leaf) AS folded FROM a0 JOIN d USING (id)),
{_walk_sql("a", "s", "proof", "folded", "t.k,")},
u AS (SELECT w.id, b0.k, b0.idx, w.proof, w.folded FROM aw{_LEVELS} w JOIN b0 ON b0.src = w.k),
{_walk_sql("b", "u", "proof", "folded", "t.k,")}
SELECT d.doc_id, d.leaf, b0.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = r.h AS verified
FROM bw{_LEVELS} w JOIN d USING (id) JOIN b0 ON b0.src = d.src CROSS JOIN b{_LEVELS} r
"""
