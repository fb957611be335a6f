"""Near copies of five-word similarity 0.8: SimHash tiles among texts that share a rare shingle, whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import as_bytes, bounds_of, groups_of, null_to_low, private, release, small_batches, written
from jobloom.llm.components import connected_components
from jobloom.llm.simhash import SEED, majority, shingle_hashes

#: Words in a shingle.
WIDTH = 5
#: Least Jaccard similarity, as a fraction of whole numbers.
NUM, DEN = 4, 5
#: Bits in which fingerprints of near copies may differ. At similarity 0.8 they differ in 9.7 of 64, standard deviation 2.9: one pair in ten million is beyond.
RADIUS = 24
#: Longs of the wide fingerprint that pairs are held against before their texts are fetched, and bits in which they may differ: 38.8 of 256 at 0.8, standard deviation 5.7.
WIDE, WIDE_RADIUS = 4, 68
#: Texts of fewer shingles are compared whatever their fingerprints.
FEW = 32
#: Rows (id, hash) of texts to fetch that are sent to all executors; more are joined by shuffling the texts.
SENT = 500_000
#: One text in so many is counted to find the shingles that many texts hold; these come last in the order of shingles.
SAMPLE = 32
#: Texts of the sample that make a shingle common, and how many common shingles are kept. Neither changes the result.
COMMON, MOST_COMMON = 4, 1 << 17
#: Texts with one shingle in common that are compared at once.
TILE = 2048
#: Bits of a shingle's hash that are shuffled; shingles that agree in them only propose more pairs.
_TOKEN_BITS = (1 << 48) - 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct XXH64 hashes of a text's WIDTH-word shingles in order; fewer words are one shingle, none have none."""
    return np.unique(shingle_hashes(text, WIDTH))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of NUM / DEN or more."""
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return DEN * common >= NUM * (len(both) - common)


def common_shingles(rows: DataFrame) -> np.ndarray:
    """Shingles that many of the sampled texts of `rows` (th, text) hold."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [shingles(t) for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["token"])

    sample = rows.where(F.pmod("th", F.lit(SAMPLE)) == 0).groupBy("th").agg(F.first("text").alias("text")).select("text")
    found = sample.mapInArrow(of, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    # At most MOST_COMMON numbers.
    return np.sort(np.array([r.token for r in found.orderBy(F.desc("n"), "token").limit(MOST_COMMON).collect()], dtype=np.int64).view(np.uint64))


def wide_fingerprint(s: np.ndarray) -> list[int]:
    """SimHash of WIDE * 64 bits of a set of hashes, as WIDE numbers: the first by the hashes themselves, the others by hashes of these."""
    out = [majority(s)]
    for _ in range(WIDE - 1):
        s = (s ^ s >> np.uint64(31)) * _MIX
        s ^= s >> np.uint64(29)
        out.append(majority(s))
    return out


def signatures(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """(id, th, key, n, fp, wide, prefix): key stands for the text's set of n shingles, fp and wide are its SimHash, prefix has its first shingles, common ones last.

    Whatever the order, two sets of similarity NUM / DEN share a shingle among the first n - ceil(n * NUM / DEN) + 1 of each.
    """
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in small_batches(batches):
            keys, sizes, fps, prefixes = [], [], [], []
            for text in as_bytes(batch.column(2)):
                s = shingles(text)
                keys.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(len(s))
                fps.append(wide_fingerprint(s))
                last = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s if len(late) else np.zeros(len(s), dtype=bool)
                prefixes.append(np.concatenate([s[~last], s[last]])[: len(s) - -(-len(s) * NUM // DEN) + 1 if len(s) else 0])
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes).view(np.int64) & _TOKEN_BITS))
            key, bits = (np.array(x, dtype=np.uint64).view(np.int64) for x in (keys, fps))
            bits = bits.reshape(-1, WIDE)
            wide = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * (WIDE - 1)), pa.array(bits[:, 1:].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key), pa.array(sizes, pa.int32()), pa.array(bits[:, 0]), wide, lists], ["id", "th", "key", "n", "fp", "wide", "prefix"])

    return rows.select("id", "th", "text").mapInArrow(of, "id long, th long, key long, n int, fp long, wide array<long>, prefix array<long>")


def _fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of columns (key, n, at, fp, comp) may be similar: by what may still be common after their places, by components and fingerprints."""
    near = (NUM + DEN) * np.minimum(x[1] - x[2], y[1] - y[2]) >= NUM * (x[1] + y[1])
    near &= (x[0] != y[0]) & (x[4] != y[4])
    return near & ((np.bitwise_count((x[3] ^ y[3]).view(np.uint64)) <= RADIUS) | (np.minimum(x[1], y[1]) < FEW))


def _emit(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    u, v = np.concatenate(left), np.concatenate(right)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])


def _tiles(g: np.ndarray, second: np.ndarray | None, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of keys that fit in `g`, or between its two sides: tiles in order of population count, pairs of tiles beyond RADIUS passed over."""
    pops = np.where(g[1] < FEW, -1, np.bitwise_count(g[3].view(np.uint64)).astype(np.int64))
    order = np.argsort(pops, kind="stable")
    g, pops = g[:, order], pops[order]
    side = None if second is None else second[order]
    for i in range(0, g.shape[1], step):
        low, high = pops[i], pops[min(i + step, g.shape[1]) - 1]
        for j in range(i, g.shape[1], step):
            if low >= 0 and pops[j] - high > RADIUS:
                break
            x, y = g[:, i : i + step, None], g[:, None, j : j + step]
            near = _fits(x, y)
            if side is not None:
                near &= side[i : i + step, None] != side[None, j : j + step]
            k, m = np.nonzero(np.triu(near, 1) if i == j else near)
            if len(k):
                yield g[0, i + k], g[0, j + m]


def _first_pairs(g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of keys that fit among neighbours by size in `g`, and with its middle: the fingerprint nearest to the majority of all, as the text has that others were made from."""
    g = g[:, np.lexsort((g[0], g[1]))]
    if g.shape[1] > 2:
        far = np.bitwise_count(g[3].view(np.uint64) ^ np.uint64(majority(g[3].view(np.uint64))))
        hub = g[:, [np.lexsort((g[0], far))[0]]]
        near = _fits(hub, g)
        yield np.repeat(hub[0], int(near.sum())), g[0][near]
    near = _fits(g[:, :-1], g[:, 1:])
    yield g[0, :-1][near], g[0, 1:][near]


def hub_pairs(hot: DataFrame) -> DataFrame:
    """(u, v): pairs of each key with the middle one of those that hold a token, for tokens that too many hold for one task."""
    ones = [F.sum(F.shiftrightunsigned("fp", k).bitwiseAND(1)).alias(f"b{k}") for k in range(64)]
    majority_of = F.lit(0).cast("long")
    for k in range(64):
        majority_of = majority_of.bitwiseOR(F.when(2 * F.col(f"b{k}") > F.col("of"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    middle = hot.groupBy("token").agg(F.count("*").alias("of"), *ones).select("token", majority_of.alias("m"))
    own = F.struct("key", "n", "at", "fp")
    hub = hot.join(middle, "token").groupBy("token").agg(F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("m"))).alias("far"), F.col("key").alias("k"), own.alias("hub"))).hub.alias("hub"))
    y = F.col("hub")
    both = hot.join(hub, "token").where(F.col("key") != F.col("hub.key"))
    fits = (NUM + DEN) * F.least(F.col("n") - F.col("at"), y.n - y["at"]) >= NUM * (F.col("n") + y.n)
    fits &= (F.bit_count(F.col("fp").bitwiseXOR(y.fp)) <= RADIUS) | (F.least(F.col("n"), y.n) < FEW)
    return both.where(fits).select(F.least("key", "hub.key").alias("u"), F.greatest("key", "hub.key").alias("v")).distinct()


def candidates(met: DataFrame, chain: bool) -> DataFrame:
    """(u, v): pairs of keys of different `comp` that share a shingle of their prefixes and may be similar, each once.

    `met` has (token, key, n, at, fp, comp, block, second). Rows of one token and block are compared with one another, those
    of two sides of a block (second: false, true; null for none) only across. With `chain` only neighbours by size are paired,
    and all with the middle one.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, held = [], [], 0
        for t in groups_of(batches, ["token", "block"]):
            values = np.stack([t.column(k).to_numpy().astype(np.int64) for k in ("key", "n", "at", "fp", "comp")])
            second = t.column("second").to_numpy()
            b = bounds_of([t.column(k).to_numpy() for k in ("token", "block")])
            for s, e in zip(b[:-1], b[1:]):
                g = values[:, s:e]
                if e - s < 2 or g[4].min() == g[4].max():
                    continue
                if chain:
                    found = _first_pairs(g)
                else:
                    sides = second[s:e]
                    found = _tiles(g, sides.astype(bool) if sides[0] >= 0 else None)
                for u, v in found:
                    left.append(u)
                    right.append(v)
                    held += len(u)
                    if held > 1 << 16:
                        yield _emit(left, right)
                        left, right, held = [], [], 0
        if left:
            yield _emit(left, right)

    keys = ["token", "block"]
    rows = met.select("token", "block", F.coalesce(F.col("second").cast("int"), F.lit(-1)).alias("second"), "key", "n", "at", "fp", "comp")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(pairs, "u long, v long").distinct()


def _in_blocks(hot: DataFrame) -> DataFrame:
    """Rows of tokens that more than TILE keys hold, with blocks of bounded size in which every two that may be similar meet.

    Sizes are cut into classes of factor DEN / NUM: similar sets are of one class or of neighbours, so they meet in the band of
    the greater one. A band's keys are dealt over tiles by hash; every two tiles of a band are a block.
    """
    mixed = hot.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("token")
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM))).cast("int")
    banded = hot.join(mixed, "token").select("*", F.explode(F.array(size, size + 1)).alias("band"))
    parts = banded.groupBy("token", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    tile = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    rows = banded.join(parts, ["token", "band"]).withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = F.xxhash64("band", F.least("tile", "other"), F.greatest("tile", "other"))
    return rows.withColumn("block", block).withColumn("second", F.when(F.col("tile") != F.col("other"), F.col("tile") > F.col("other")))


def confirmed(pairs: DataFrame, names: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are similar; names has (key, id, th, n, fp, wide), rows (id, th, text).

    Pairs whose wide fingerprints differ too much are out; the texts of the others are fetched and compared.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets: dict[int, np.ndarray] = {}
            keep = []
            for u, v, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 1)), as_bytes(batch.column(2)), as_bytes(batch.column(3))):
                for k, t in ((u, a), (v, b)):
                    if k not in sets:
                        sets[k] = shingles(t)
                keep.append(similar(sets[u], sets[v]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    end = lambda k: names.select(F.col("key").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("id", "th", "n", "fp", "wide")])
    differ = F.bit_count(F.col("u_fp").bitwiseXOR(F.col("v_fp")))
    for k in range(WIDE - 1):
        differ += F.bit_count(F.get("u_wide", F.lit(k)).bitwiseXOR(F.get("v_wide", F.lit(k))))
    ends = pairs.join(end("u"), "u").join(end("v"), "v").where((differ <= WIDE_RADIUS) | (F.least("u_n", "v_n") < FEW))
    pairs = written(ends.select("u", "v", "u_id", "u_th", "v_id", "v_th"))
    wanted = pairs.select(F.explode(F.array(*[F.struct(F.col(f"{k}_id").alias("id"), F.col(f"{k}_th").alias("th")) for k in "uv"])).alias("w")).select("w.*").distinct()
    if 2 * pairs.count() <= SENT:
        wanted = F.broadcast(wanted)
    # Written, so that the joins deal both sides anew: a text that many are paired with is one that can be split.
    texts = written(rows.join(wanted, ["id", "th"], "left_semi").groupBy("id", "th").agg(F.first("text").alias("text")))
    text = lambda k: texts.select(F.col("id").alias(f"{k}_id"), F.col("th").alias(f"{k}_th"), F.col("text").alias(f"{k}_text"))
    both = pairs.join(text("u"), ["u_id", "u_th"]).join(text("v"), ["v_id", "v_th"])
    return both.select("u", "v", "u_text", "v_text").mapInArrow(of, "u long, v long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, root), a row per row of `docs`: root is the same for rows that a chain of near copies connects.

    Near copies are texts whose sets of five-word shingles (A-Z lower-cased, white space ignored) have a similarity of 0.8 or
    more. Texts that share a shingle of their prefixes, as all such pairs do, meet; their fingerprints are compared tile
    against tile, and whole sets confirm what is within RADIUS bits. Texts without words are copies of one another. Ids are
    those of `null_to_low`, th is the text's hash. Neighbours in a shared shingle are compared first, and all that share it with
    the middle one of them, then all pairs not yet connected.
    """
    spark = docs.sparkSession
    rows = docs.select(null_to_low(F.col(id_col)).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    sig = written(signatures(rows, common_shingles(rows)))
    names = sig.groupBy("key").agg(F.min(F.struct("id", "th")).alias("m"), *[F.any_value(c).alias(c) for c in ("n", "fp")], F.min("wide").alias("wide")).select("key", "m.*", "n", "fp", "wide")
    tokens = sig.join(names.select("id", "th").hint("shuffle_hash"), ["id", "th"], "left_semi").select(F.posexplode("prefix").alias("at", "token"), "key", "n", "fp")
    shared = tokens.groupBy("token").agg(F.count("*").alias("of")).where("of > 1")
    met = written(tokens.join(shared, "token"))
    members = written(sig.select("id", "th", "key"))
    names = written(names)
    release(spark, sig)

    none = F.lit(None).cast("boolean")
    tile = F.pmod(F.xxhash64("key"), F.ceil(F.col("of") / TILE))
    first = candidates(met.select("token", tile.alias("block"), none.alias("second"), "key", "n", "at", "fp", F.col("key").alias("comp")), True)
    first = written(first.union(hub_pairs(met.where(F.col("of") > TILE))).distinct())
    links = written(confirmed(first, names, rows))
    roots = connected_components(links)
    rest = met.where("of > 2").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root")
    usual = rest.where(F.col("of") <= TILE).select("*", F.lit(0).cast("long").alias("block"), none.alias("second"))
    columns = ["token", "block", "second", "key", "n", "at", "fp", "comp"]
    more = candidates(usual.select(columns).union(_in_blocks(rest.where(F.col("of") > TILE)).select(columns)), False)
    more = written(more.join(first, ["u", "v"], "left_anti"))
    if not more.isEmpty():
        roots = connected_components(links.union(written(confirmed(more, names, rows))))
    release(spark, met, first)
    return members.join(roots.withColumnRenamed("node", "key"), "key", "left").select("id", "th", F.coalesce("root", "key").alias("root"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of near copies: the smallest (id, text hash), null ids first. Columns unchanged.

    Of rows that agree in id and text one stays, whichever. Null texts and texts without a word are one group. An empty table
    gives an empty result.
    """
    best = groups(docs, id_col, text_col).groupBy("root").agg(F.min(F.struct("id", "th")).alias("best"))
    return kept_rows(docs, best.select("best.*"), id_col, text_col)


def kept_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of `docs` for each (id, th) of `kept`, columns unchanged, whatever their names."""
    i, h = private(docs, "id"), private(docs, "th")
    keyed = docs.withColumns({i: null_to_low(F.col(f"`{id_col}`")), h: F.xxhash64(F.col(f"`{text_col}`"))})
    kept = kept.select(F.col("id").alias(i), F.col("th").alias(h))
    return keyed.join(kept, [i, h], "left_semi").dropDuplicates([i, h]).select(*[F.col(f"`{c}`") for c in docs.columns])
