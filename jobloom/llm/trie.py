"""Conversation prefix trie: nodes in preorder, subtrees as intervals, their figures as differences of running totals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import cut, table, written
from jobloom.llm.merkle import crc32_sql
from jobloom.llm.ranking import numbered

#: So many turns, or blocks of turns, are compared as one array when conversations are ranked.
BLOCK = 64
#: So many ids are joined in one piece before a node's ids are hashed in a row.
PIECE = 4096


def _zero() -> Column:
    return F.lit(0).cast("long")


def _digest(role: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, digest, bytes): every turn's place in its conversation from 0, 128 bits of the sha256 of role and text, the text's bytes.

    Turns go by `turn_col`, null first; equal ones by their digest, so that texts go no further than the scan. Null role or text is
    empty. Rows without a conversation id are no turns. Other columns are ignored. One conversation may hold any share of the rows.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    conv = F.col(f"`{conv_col}`")
    rows = cut(conversations.where(conv.isNotNull()).select(conv.cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), _digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes")))
    return cut(numbered(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")]).select("conv_id", "place", "digest", "bytes"))


def rebuilt(of: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another's turns: (turns, ids) for `turns` given.

    c takes the first h turns of c - c % family (all if it has fewer, none if there is none), then its own after its first h;
    h = crc32(c in decimal) % most, % as in SQL (the sign of c). ids (conv_id) has all conversations, also those that are left without a turn.
    """
    convs = of.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = cut(convs.select("conv_id", "own", (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")))
    # A base has fewer than 2 * family conversations, and gives each fewer than `most` turns.
    first = of.where((F.col("place") < most) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), "place", "digest", "bytes")
    taken = convs.join(first, "base").where("place < h").select("conv_id", "place", "digest", "bytes")
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    start = convs.join(lengths, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("of_base", _zero())).alias("from_base"))
    rest = of.join(start, "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("from_base")).alias("place"), "digest", "bytes")
    return taken.union(rest), convs.select("conv_id")


def _ranks(paths: DataFrame, most: int) -> DataFrame:
    """(conv_id, rank): from 1, equal turns equal ranks, in the lexicographic order of digests; paths: (conv_id, place, digest).

    BLOCK consecutive turns are one array; the distinct arrays' numbers are the turns of the next round, until a
    conversation is one number: the rounds grow with the logarithm of the longest one, and no array is longer than BLOCK.
    """
    parts = paths.select("conv_id", "place", F.col("digest").alias("v"))
    while True:
        blocks = parts.groupBy("conv_id", F.expr(f"place div {BLOCK}").alias("place")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x.v).alias("block"))
        blocks = written(blocks)
        distinct = numbered(written(blocks.select("block").distinct()), [], [F.col("block")]).select("block", (F.col("place") + 1).alias("v"))
        parts = cut(blocks.join(distinct, "block").select("conv_id", "place", "v"))
        most = -(-most // BLOCK)
        if most <= 1:
            return parts.select("conv_id", F.col("v").alias("rank"))


def _ends(members: DataFrame) -> DataFrame:
    """(p1, p2, depth, ends_sha256): the hash of each node's ids in a row; members: (conv_id, p1, p2, depth).

    Ids are numbered within their node and joined in pieces; a hash has to read them in order, so one task reads a node's
    pieces, one piece at a time.
    """
    placed = numbered(cut(members), ["p1", "p2", "depth"], [F.col("conv_id")])
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = placed.groupBy("p1", "p2", "depth", F.expr(f"place div {PIECE}").alias("piece")).agg(piece.alias("ids"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, running = None, None
        for batch in batches:
            out = []
            *keys, _, ids = (c.to_pylist() for c in batch.columns)
            for key, text in zip(zip(*keys), ids):
                if key != held:
                    if held:
                        out.append((*held, running.hexdigest()))
                    held, running = key, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*held, running.hexdigest())))], schema)

    names = ["p1", "p2", "depth", "ends_sha256"]
    schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    pieces = pieces.select("p1", "p2", "depth", "piece", "ids").repartition("p1", "p2", "depth").sortWithinPartitions("p1", "p2", "depth", "piece")
    return pieces.mapInArrow(of, "p1 long, p2 long, depth long, ends_sha256 string")


def prefix_trie(of: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, pos, end.

    of: conversations' `turns`; ids (conv_id) may add some without a turn. A node is a distinct sequence of first turns, told by a 128-bit
    digest of turns and places; the textless root is at depth 0, the smallest member stands for a node. pos is the node's place
    in preorder, children in the order of their digests; its subtree is the nodes from pos to end, so that its leaves and its saved bytes
    (members but one times the bytes of the last text) are differences of totals that run over all nodes. Ties and
    repeated conversations meet in a node; no conversation gives no node.
    """
    of = cut(of.select("conv_id", "place", F.xxhash64(F.lit(1), "place", "digest").alias("x1"), F.xxhash64(F.lit(2), "place", "digest").alias("x2"), "digest", "bytes"))
    ids = cut((of.select("conv_id") if ids is None else ids.select("conv_id").union(of.select("conv_id"))).distinct())
    most = of.agg(F.max("place")).first()[0]
    # A node's name is the exclusive-or of its turns' digests, salted with their places; its parent's lacks the last.
    paths = numbered(of, ["conv_id"], [F.col("place")], {"x1": "xor", "x2": "xor"})
    paths = written(paths.select("conv_id", "place", "digest", "bytes", "x1", "x2", F.col("x1_to").alias("p1"), F.col("x2_to").alias("p2")))
    ranks = ids.withColumn("rank", _zero()) if most is None else ids.join(_ranks(paths, most + 1), "conv_id", "left").select("conv_id", F.coalesce("rank", _zero()).alias("rank"))
    ranks = cut(ranks)
    root = ranks.select("conv_id", "rank", _zero().alias("p1"), _zero().alias("p2"), _zero().alias("depth"), _zero().alias("bytes"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
    steps = paths.join(ranks, "conv_id").select("conv_id", "rank", "p1", "p2", (F.col("place") + 1).alias("depth"), "bytes", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"))
    name = ["p1", "p2", "depth"]
    nodes = root.union(steps).groupBy(*name).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.max("bytes").alias("bytes"), F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    nodes = written(nodes)
    children = nodes.where("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(children, name, "left").join(parents, ["q1", "q2", "depth"], "left").withColumn("n_children", F.coalesce("n_children", _zero()))
    whole = written(whole.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}))
    # In preorder a node comes where the first of the ranked conversations passes it; its subtree ends with the last one's nodes.
    placed = written(numbered(whole, [], [F.col("first"), F.col("depth")], {"leaf": "sum", "saved": "sum"}))
    ends = placed.groupBy(F.col("first").alias("last")).agg(F.max("place").alias("end"), F.max("leaf_to").alias("leaf_end"), F.max("saved_to").alias("saved_end"))
    out = placed.join(ends, "last")
    out = out.withColumns({"n_leaves": F.col("leaf_end") - F.col("leaf_to") + F.col("leaf"), "saved_tokens": F.col("saved_end") - F.col("saved_to") + F.col("saved")})
    last = paths.groupBy("conv_id").agg(F.max("place").alias("place"))
    stops = paths.join(last, ["conv_id", "place"]).select("conv_id", "p1", "p2", (F.col("place") + 1).alias("depth"))
    stops = stops.union(ids.join(last, "conv_id", "left_anti").select("conv_id", _zero(), _zero(), _zero()))
    out = out.join(_ends(stops), name, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", F.col("place").alias("pos"), "end")


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """`nodes` of a trie over `conversations` (conv_id, turn, role, text) as they are, each with the digest, role and text of its last turn (root: null)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), _digest(text("role"), text("text")).alias("digest"), text("role").alias("role"), text("text").alias("text")).dropDuplicates(["conv_id", "digest"])
    at = turns(conversations).select("conv_id", (F.col("place") + 1).alias("depth"), "digest")
    return nodes.join(at, ["conv_id", "depth"], "left").join(said, ["conv_id", "digest"], "left")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(turns(table(spark, sf_dir, "conversations")))).drop("pos", "end")


OP11_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, 1, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, text,
         string_agg(sha256(strlen(role) || ':' || role || text), '' ORDER BY part, i) OVER (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING) AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
m AS (SELECT conv_id, 0 AS depth, '' AS text, '' AS path FROM c UNION ALL SELECT * FROM p),
l AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
n AS (
  SELECT m.path, m.depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(strlen(m.text)) AS saved,
         sha256(coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (WHERE l.depth = m.depth), '')) AS ends_sha256
  FROM m JOIN l USING (conv_id) GROUP BY m.path, m.depth),
k AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
x AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.path = n.path),
s AS (SELECT left(path, CAST(64 * d AS BIGINT)) AS path, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT path, n_children, saved, unnest(range(0, depth + 1)) AS d FROM x) GROUP BY 1)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN s ON s.path = x.path LEFT JOIN n u ON x.depth > 0 AND u.path = left(x.path, CAST(64 * (x.depth - 1) AS BIGINT))
"""
