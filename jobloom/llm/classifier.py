"""Quality classifier: overlapping heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import as_bytes, release, small_batches, table, written

#: Rows that the scorers are fitted on at most: those of the least hashes.
TRAIN_ROWS = 12_000
#: Features are hashed to so many weights.
DIM = 1 << 18
#: A row is kept if both scores are at least this.
CUTOFF = 0.5
#: Distinct words remembered with their features by a worker; emptied when full.
CACHE = 20_000

# English insults: what someone is called, and how something is called.
INSULTS = frozenset(b"bastard clown creep fool idiot imbecile jerk loser moron scum trash vermin".split())
SCORN = frozenset(b"disgusting dumb pathetic stupid worthless".split())
#: The words are English: their absence says something only of texts with this share of English function words.
ENGLISH, ENGLISH_SHARE = frozenset(b"the of and to is in that for it with as was on by".split()), 0.08
_SYMBOLS, _CAPITALS, _MARKS = b"#*$%&|<>", bytes(range(65, 91)), b"!#*$%&|<>+=~^_{}[]@\\/0123456789"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not 97 <= c <= 122 else c for c in range(256))
GOOD, BAD, NONE = 2, 1, 0


def _side(value: float, good: float, bad: float) -> int:
    """GOOD up to `good`, BAD from `bad` on, no vote between."""
    return GOOD if value <= good else BAD if value >= bad else NONE


#: Labellers of quality and of abuse; annotations are one more of either.
N_QUALITY, N_ABUSE = 6, 2


def votes(text: bytes, words: list[bytes]) -> tuple[list[int], list[int]]:
    """What the labellers say of a text: of its quality, and of whether it is free of abuse."""
    n, size = len(words), max(len(text), 1)
    if not n:
        return [BAD, *[NONE] * (N_QUALITY - 1)], [NONE] * N_ABUSE
    less = lambda drop: (len(text) - len(text.translate(None, drop))) / size
    three = 1 - len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 20 else None
    quality = [
        _side(less(_SYMBOLS), 0.005, 0.03),
        _side(less(_CAPITALS), 0.1, 0.3),
        _side(less(_MARKS), 0.02, 0.1),
        NONE if n < 8 else _side(1 - len(set(words)) / n, 0.45, 0.65),
        NONE if three is None else _side(three, 0.05, 0.25),
        NONE if n < 8 else _side(sum(a == b for a, b in zip(words, words[1:])) / n, 0.05, 0.2),
    ]
    plain = text.translate(_LOWER).split()
    fine = GOOD if sum(w in ENGLISH for w in plain) >= ENGLISH_SHARE * len(plain) else NONE
    found = [sum(w in lexicon for w in plain) for lexicon in (INSULTS, SCORN)]
    return quality, [fine if not k else BAD if k > 1 else NONE for k in found]


class Featurizer:
    """Distinct words, their beginnings, and the votes, hashed."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, int]:
        """(features, votes in base 3): the bits of features are indices below DIM."""
        text = text or b""
        words = text.split()
        quality, abuse = votes(text, words)
        code = 0
        for v in quality + abuse:
            code = code * 3 + v
        if len(self.known) > CACHE:
            self.known.clear()
        out = {zlib.crc32(b"vote %d %d" % (k, v)) % DIM for k, v in enumerate(quality + abuse)}
        known = self.known
        for w in set(text.translate(_LOWER).split()):
            f = known.get(w)
            if f is None:
                f = known[w] = tuple(zlib.crc32(w[:k] + b"-" * (k < len(w))) % DIM for k in (64, *(k for k in (4, 5, 6, 7, 9) if k < len(w))))
            out.update(f)
        return np.fromiter(out, dtype=np.int32, count=len(out)), code


def split_code(code: np.ndarray) -> np.ndarray:
    """Votes of codes, one column for each labeller."""
    return np.stack([code // 3**k % 3 for k in range(N_QUALITY + N_ABUSE - 1, -1, -1)], axis=1)


def fit_labellers(votes: np.ndarray, count: np.ndarray, rounds: int = 50) -> np.ndarray:
    """P(good) of each pattern of votes (rows; 0 none, 1 bad, 2 good) that stands for `count` rows.

    Two-class latent model: each labeller, where it votes, is right with a probability for either class, estimated by
    expectation-maximisation from the patterns' counts over all rows with a smoothing of one row; it starts from the majority.
    """
    p = np.clip(0.5 + 0.15 * ((votes == GOOD).sum(axis=1) - 2.0 * (votes == BAD).sum(axis=1)), 0.05, 0.95)
    for _ in range(rounds):
        prior = ((count * p).sum() + 1) / (count.sum() + 2)
        odds = np.full(len(votes), np.log(prior / (1 - prior)))
        for k in range(votes.shape[1]):
            says = [(votes[:, k] == v) for v in (BAD, GOOD)]
            share = np.array([[(count * c)[v].sum() + 1 for v in says] for c in (1 - p, p)])
            share /= share.sum(axis=1, keepdims=True)
            odds += np.concatenate([[0.0], np.log(share[1] / share[0])])[votes[:, k]]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p


#: Multipliers of the hashes whose least values tell near copies.
_MULTS = (np.random.default_rng(1).integers(1 << 31, 1 << 32, 4).astype(np.uint64) | np.uint64(1)).tolist()


def least_hashes(features: np.ndarray) -> bytes:
    """The least of each of four hashes of a row's features: rows that agree in them are near copies."""
    x = features.astype(np.uint64)
    return b"".join(int((x * np.uint64(m) & np.uint64(0xFFFFFFFF)).min()).to_bytes(4, "big") for m in _MULTS)


#: Soft labels are counted in parts of this, so that sums don't depend on their order.
UNIT = 1 << 20


def telling(df: np.ndarray, bad: np.ndarray, rows: int, all_bad: int, least_z: float = 5.0) -> np.ndarray:
    """Which features get a weight: those whose share of bad rows (`bad`, in UNITs, of `df` rows) differs from the overall one by `least_z` standard errors."""
    share = np.clip(all_bad / UNIT / max(rows, 1), 1e-3, 1 - 1e-3)
    return np.abs(bad / UNIT - df * share) >= least_z * np.sqrt(np.maximum(df, 1) * share * (1 - share))


def fit_scorer(rows: list[np.ndarray], target: np.ndarray, epochs: int = 12, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer (the last is the bias) for soft targets, by Adagrad over rows of telling features in a fixed random order; other features get none."""
    w, g2 = np.zeros(DIM + 1), np.full(DIM + 1, 1e-3)
    rows = [np.append(r, np.int32(DIM)) for r in rows]
    rng = np.random.default_rng(0)
    for _ in range(epochs if rows else 0):
        for i in rng.permutation(len(rows)):
            f = rows[i]
            e = 1 / (1 + np.exp(-np.clip(w[f].sum(), -30, 30))) - target[i]
            g = e + decay * w[f]
            g2[f] += g * g
            w[f] -= rate * g / np.sqrt(g2[f])
    return w.astype(np.float32)


class QualityModel:
    """Weights of the two scorers."""

    def __init__(self, quality: np.ndarray, abuse: np.ndarray):
        self.quality, self.abuse = quality, abuse

    def scores(self, features: np.ndarray) -> tuple[float, float]:
        z = [float(w[features].sum() + w[DIM]) for w in (self.quality, self.abuse)]
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """The model for `docs`; `labels` (doc_id, quality, toxic) are annotations of some rows, if there are any.

    Votes are taken on every whole text; annotations are the votes of one more labeller, which errs like the others. The
    patterns of votes (at most 3^8 times 9) are counted over all rows, and all labellers' accuracies estimated from these counts.
    The `train_rows` rows of the least hashes then fit the scorers to the posterior labels, near copies once: the same rows whatever their
    order or partitions. Their features are counted in Spark, and the driver gets of each row those that tell good from bad. Null text counts as empty; null or missing annotations as no vote; of several the worst counts. Rows that agree in
    id and text are fitted once. An empty table gives a model that scores 0.5.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            codes = []
            for text in as_bytes(batch.column(2)):
                text = text or b""
                code = 0
                for v in sum(votes(text, text.split()), []):
                    code = code * 3 + v
                codes.append(code)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.int32())], ["id", "th", "code"])

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    rows = keyed.mapInArrow(of, "id long, th long, code int")
    if labels is not None:
        good = lambda c: F.when(c, F.lit(GOOD)).when(~c, F.lit(BAD)).otherwise(F.lit(NONE))
        notes = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(good(F.min("quality") >= 1).alias("q"), good(F.max("toxic") < 1).alias("t"))
        rows = rows.join(notes, "id", "left")
    else:
        rows = rows.withColumns({"q": F.lit(NONE), "t": F.lit(NONE)})
    # Written, not checkpointed: a checkpoint would take the votes twice.
    rows = written(rows.select("id", "th", "code", F.coalesce("q", F.lit(NONE)).alias("q"), F.coalesce("t", F.lit(NONE)).alias("t")))
    patterns = sorted(rows.groupBy("code", "q", "t").count().collect())
    if not patterns:
        return QualityModel(np.zeros(DIM + 1, np.float32), np.zeros(DIM + 1, np.float32))
    code, q, t, n = np.array([tuple(r) for r in patterns], dtype=np.int64).T
    said, split = split_code(code), N_QUALITY
    patterns_of = lambda said, q, t: (np.column_stack([said[:, :split], q]), np.column_stack([said[:, split:], t]))
    good = [fit_labellers(v, n) for v in patterns_of(said, q, t)]
    posterior = dict(zip(zip(code.tolist(), q.tolist(), t.tolist()), zip(*good)))
    # Bounded by train_rows.
    drawn = rows.dropDuplicates(["id", "th"]).orderBy(F.xxhash64("id", "th"), "id", "th").limit(train_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_text = Featurizer()
        for batch in small_batches(batches):
            found = [np.sort(of_text(x)[0]) for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("code", "q", "t")), pa.array([xxhash.xxh3_128_digest(f.tobytes()) for f in found], pa.binary()), pa.array(map(least_hashes, found), pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())], ["code", "q", "t", "key", "least", "f"])

    drawn = drawn.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "code", "q", "t")
    sample = keyed.join(F.broadcast(drawn), keyed.id.eqNullSafe(F.col("_id")) & (keyed.th == F.col("_th"))).select("code", "q", "t", "text")
    name = ["code", "q", "t", "key"]
    sample = written(sample.mapInArrow(features, "code int, q int, t int, key binary, least binary, f binary").dropDuplicates(name))
    # A short line for each drawn row, however long its text.
    lines = sorted(sample.select("key", "least", "code", "q", "t").collect())
    once, seen = [], set()
    for r in lines:
        if r.least not in seen:
            seen.add(r.least)
            once.append(r)
    target = np.array([posterior[r.code, r.q, r.t] for r in once]).reshape(-1, 2)
    code, q, t = np.array([(r.code, r.q, r.t) for r in once], dtype=np.int64).reshape(-1, 3).T
    # Only rows of which some labeller says something teach a scorer.
    told = np.stack([(v > 0).any(axis=1) for v in patterns_of(split_code(code), q, t)], axis=1).reshape(-1, 2)
    bad = np.rint((1 - target) * UNIT).astype(np.int64)
    taught = docs.sparkSession.createDataFrame([(*(r[c] for c in name), *map(bool, told[i]), *map(int, bad[i])) for i, r in enumerate(once)], "code int, q int, t int, key binary, told0 boolean, told1 boolean, bad0 long, bad1 long")
    chosen = sample.join(F.broadcast(taught), name)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, DIM), dtype=np.int64)
        for batch in batches:
            for f, *of_row in zip(*(batch.column(c).to_pylist() for c in ("f", "told0", "told1", "bad0", "bad1"))):
                at = np.frombuffer(f, dtype=np.int32)  # a row's features are distinct
                for k in (0, 1):
                    if of_row[k]:
                        total[2 * k, at] += 1
                        total[2 * k + 1, at] += of_row[2 + k]
        there = np.flatnonzero(total[0] | total[2])
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *map(pa.array, total[:, there])], ["feature", "df0", "bad0", "df1", "bad1"])

    counts = chosen.select("f", "told0", "told1", "bad0", "bad1").mapInArrow(count, "feature int, df0 long, bad0 long, df1 long, bad1 long")
    totals = np.zeros((4, DIM), dtype=np.int64)
    # At most a row for each of DIM features.
    for r in counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("df0", "bad0", "df1", "bad1")]).toLocalIterator():
        totals[:, r.feature] = r[1:]
    used = [telling(totals[2 * k], totals[2 * k + 1], int(told[:, k].sum()), int(bad[told[:, k], k].sum())) for k in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast(used[0] | used[1])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(x := np.frombuffer(f, dtype=np.int32))[shared.value[x]].tobytes() for f in batch.column("f").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in name), pa.array(kept, pa.binary())], [*name, "f"])

    found = {tuple(r[c] for c in name): np.frombuffer(r.f, dtype=np.int32) for r in chosen.select(*name, "f").mapInArrow(tell, "code int, q int, t int, key binary, f binary").collect()}
    ordered = [found[tuple(r[c] for c in name)] for r in once]
    release(docs.sparkSession, sample)
    return QualityModel(*(fit_scorer([f[used[k][f]] for f, w in zip(ordered, told[:, k]) if w], target[told[:, k], k]) for k in (0, 1)))


def classify(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, quality, clean, kept), a row per row of `docs`: scores from 0 to 1, kept if both reach `cutoff`.

    Repeated rows and null ids are answered row by row; null text counts as empty; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer()
        for batch in small_batches(batches):
            s = np.array([shared.value.scores(features(t)[0]) for t in as_bytes(batch.column(1))]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array((s >= cutoff).all(axis=1))], ["doc_id", "quality", "clean", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of, "doc_id long, quality double, clean double, kept boolean")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of `docs` that the model keeps, all columns unchanged, whatever their names.

    Null text counts as empty; repeated rows are all kept or all dropped; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer()
        for batch in small_batches(batches):
            keep = [min(shared.value.scores(features(t)[0])) >= cutoff for t in as_bytes(batch.column(text_col))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(of, docs.schema)


def op1_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
