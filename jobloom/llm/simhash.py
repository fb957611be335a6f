"""SimHash near-duplicates: fingerprints compared exactly, tile against tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import as_bytes, bounds_of, cut, groups_of, null_to_low, private, small_batches, table, written
from jobloom.llm.components import connected_components

SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """The XXH64 hashes of all `width`-word shingles, repeats included; fewer words are one shingle, none have none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero without any."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        h = np.ascontiguousarray(hashes[at : at + CHUNK], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int) -> int:
    """64-bit majority vote of the shingles' hashes."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, th, fp): one row per row of `docs`; th is the text's hash, fp the fingerprint's bits as a signed long.

    Words are runs without ASCII white space, A-Z lower-cased. Null and empty texts, and texts without
    a word, have fingerprint zero; texts of fewer than `width` words are one shingle.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = np.array([fingerprint(t, width) for t in as_bytes(batch.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["id", "th", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of, "id long, th long, fp long")


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within `radius` bits in `a`, or between `a` and `b`: a spanning forest.

    Values are ordered by population count and cut into tiles; a pair of tiles is skipped if their population
    counts differ beyond the radius, else compared by exclusive-or and bit counts.
    """
    x = a if b is None else np.concatenate([a, b])
    side = np.zeros(len(x), dtype=bool)
    side[len(a) :] = True
    pops = np.bitwise_count(x)
    order = np.argsort(pops, kind="stable")
    x, side, pops = x[order], side[order], pops[order]
    label = np.arange(len(x))
    left, right = [], []
    for i in range(0, len(x), tile):
        for j in range(i, len(x), tile):
            if int(pops[j]) - int(pops[min(i + tile, len(x)) - 1]) > radius:
                break
            near = np.bitwise_count(x[i : i + tile, None] ^ x[None, j : j + tile]) <= radius
            if b is not None:
                near &= side[i : i + tile, None] != side[None, j : j + tile]
            p, q = np.nonzero(near)
            p, q = p + i, q + j
            while len(p := p[keep := label[p] != label[q]]):
                q = q[keep]
                left.append(x[p[0]])
                right.append(x[q[0]])
                label[label == label[q[0]]] = label[p[0]]
    return np.array(left, dtype=np.uint64), np.array(right, dtype=np.uint64)


def link_fingerprints(fps: DataFrame, radius: int = 4, tile_rows: int = 2048) -> DataFrame:
    """(u, v): links between the distinct fingerprints of `fps` (fp) that connect all pairs within `radius` bits.

    Two fingerprints within `radius` bits agree on one of radius + 1 segments of their bits at least, so tiles are
    formed among those that share a segment: one tile for up to `tile_rows`, else tiles of one population count
    each, dealt by hash. Pairs of tiles whose population counts differ beyond the radius never meet;
    the others are compared whole. A segment that many share becomes many pairs of tiles of bounded size.
    Each pair of tiles gives a spanning forest of its links, not all pairs.
    """
    n, cuts = radius + 1, [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    pop = F.bit_count("fp").cast("int")
    segments = F.array(*[F.struct(F.lit(k).alias("seg"), F.shiftrightunsigned("fp", cuts[k]).bitwiseAND((1 << (cuts[k + 1] - cuts[k])) - 1).alias("val")) for k in range(n)])
    rows = fps.select("fp", pop.alias("pop"), F.explode(segments).alias("s")).select("s.seg", "s.val", "fp", "pop")
    per_pop = rows.groupBy("seg", "val", "pop").agg(F.count("*").alias("n"))
    blocks = per_pop.groupBy("seg", "val").agg(F.sum("n").alias("total"), F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile_rows).cast("long").alias("parts"))).alias("cells")).where("total > 1")
    met = rows.join(blocks, ["seg", "val"])
    own_parts = F.expr("filter(cells, c -> c.pop = pop)[0].parts")
    tile_of = F.col("pop") * F.lit(1 << 32) + F.pmod(F.xxhash64("fp", F.lit("tile")), own_parts)
    others = F.expr(f"flatten(transform(filter(cells, c -> abs(c.pop - pop) <= {radius}), c -> transform(sequence(0L, c.parts - 1), k -> c.pop * {1 << 32}L + k)))")
    met = met.select("seg", "val", "fp", F.when(F.col("total") <= tile_rows, F.lit(0)).otherwise(tile_of).cast("long").alias("tile"), F.when(F.col("total") <= tile_rows, F.array(F.lit(0).cast("long"))).otherwise(others).alias("others"))
    met = met.select("seg", "val", "fp", "tile", F.explode("others").alias("other")).select("seg", "val", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), (F.col("tile") > F.col("other")).alias("second"), "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, ["seg", "val", "lo", "hi"]):
            c = [t.column(k).to_numpy() for k in ("seg", "val", "lo", "hi")]
            fp, second = t.column("fp").to_numpy().view(np.uint64), np.asarray(t.column("second"))
            left, right = [], []
            b = bounds_of(c)
            for s, e in zip(b[:-1], b[1:]):
                if e - s > 1:
                    x, y = fp[s:e], second[s:e]
                    u, v = tile_links(x[~y], x[y] if c[2][s] != c[3][s] else None, radius)
                    left.append(u)
                    right.append(v)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(k).view(np.int64)) for k in (left, right)], ["u", "v"])

    keys = ["seg", "val", "lo", "hi"]
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "u long, v long")


def components_of(sig: DataFrame, radius: int = 4, tile_rows: int = 2048) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of `sig` (id, fp): its group, and the group's smallest id."""
    nodes = cut(sig.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(link_fingerprints(nodes.select("fp"), radius, tile_rows))
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written, so that the join deals both sides anew: one that adaptive execution can split where a component is large.
    comps = written(nodes.groupBy("root").agg(F.min("least").alias("component_id")))
    return nodes.join(comps, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, tile_rows: int = 2048) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id): the connected groups of rows whose fingerprints link.

    One row per row of `docs`, whatever other columns it has. component_id is the smallest id reachable, the
    row's own included; null ids count only if nothing else is there, then it is null. Rows without
    words share fingerprint zero and link like any others; repeated rows fall in one group. An empty table gives an
    empty result.
    """
    sig = cut(fingerprints(docs, id_col, text_col, width))
    named = components_of(sig, radius, tile_rows).select("fp", "component_id")
    return sig.join(named, "fp").select(F.col("id").alias("doc_id"), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """`docs` with one row of each near-duplicate group: the smallest (id, text hash), null ids first. Columns unchanged.

    Of rows that agree in id and text one stays, whichever.
    """
    sig = cut(fingerprints(docs, id_col, text_col, width))
    named = components_of(sig, radius)
    best = sig.join(named, "fp").groupBy("root").agg(F.min(F.struct(null_to_low(F.col("id")).alias("id"), "th")).alias("best")).select(F.col("best.id").alias("__id"), F.col("best.th").alias("__th"))
    i, h = private(docs, "id"), private(docs, "th")
    keyed = docs.withColumns({i: null_to_low(F.col(f"`{id_col}`")), h: F.xxhash64(F.col(f"`{text_col}`"))})
    best = best.select(F.col("__id").alias(i), F.col("__th").alias(h))
    return keyed.join(best, [i, h], "left_semi").dropDuplicates([i, h]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
