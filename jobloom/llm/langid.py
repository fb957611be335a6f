"""Language of words and documents: a linear-chain conditional random field over affixes, n-grams and a lexicon."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import small_batches, table

#: Affixes and n-grams are hashed to so many weights a language.
BITS = 18
DIM = 1 << BITS
#: The field is fitted on pieces of about PIECE bytes, drawn from anywhere in the labelled texts, TRAIN_BYTES of each language (all, if it has less).
PIECE, TRAIN_BYTES = 160, 400_000
#: So many pieces, of whatever languages, in a row are one training chain: what transitions are learnt from.
IN_CHAIN = 3
#: Words found so often among the pieces, more than half of them in one language, are its lexicon; the most frequent ones count.
LEAST, LEXICON = 4, 20_000
UNKNOWN = "und"

_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_BASE_BACK = pow(_BASE, -1, 1 << 64)


def _powers(of: int, n: int) -> np.ndarray:
    out = np.full(n, of, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _hashed(x: np.ndarray, salt: int) -> np.ndarray:
    return (((x ^ np.uint64(salt)) * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Words:
    """The words of a buffer of lower-cased text: byte positions, hashes, and their features as rows of the weights."""

    first: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    letter_start: np.ndarray
    grams: list[np.ndarray]
    affixes: list[np.ndarray]


def words_of(b: np.ndarray) -> Words:
    """Runs of letters (ASCII letters, and all beyond ASCII but its common punctuation) in a buffer that ends with a separator.

    n-grams: three bytes about each byte and four from the one before it, a blank where the word ends; affixes: its first and last five bytes.
    """
    letter = _LETTER[b]
    at = np.flatnonzero(b == 0xC2)
    at = at[~np.isin(b[at + 1], (0xAA, 0xB5, 0xBA))] if len(at) else at
    letter[at] = letter[at + 1] = False
    at = np.flatnonzero(b[:-2] == 0xE2)
    at = at[b[at + 1] == 0x80]
    letter[at] = letter[at + 1] = letter[at + 2] = False
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    s = np.full(len(b) + 8, 32, dtype=np.uint64)
    s[4 : 4 + len(b)][letter] = b[letter]
    inside = np.flatnonzero(letter)
    p = inside + 4
    x0, x1, x2 = s[p], s[p + 1], s[p + 2]
    three = (s[p - 1] << np.uint64(16)) | (x0 << np.uint64(8)) | x1
    four = _hashed((three << np.uint64(8)) | x2, 0x2222222222)
    # The last byte of a word has no four: its row has no weight.
    four[x1 == 32] = DIM
    n, k = end - first, np.arange(5, dtype=np.uint64)
    near = lambda at, step: sum(np.where(i < n, s[4 + at + step * i], np.uint64(32)) << np.uint64(8 * i) for i in range(5))
    affixes = [_hashed(near(first, 1), 0x3333333333), _hashed(near(end - 1, -1), 0x4444444444)] if len(n) else [np.zeros(0, np.int32)] * 2
    up, down = _powers(_BASE, len(b) + 1), _powers(_BASE_BACK, len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s[4 : 4 + len(b)] * up[:-1], dtype=np.uint64)])
    word = (total[end] - total[first]) * down[first] + n.astype(np.uint64)
    return Words(first, end, word, np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else np.zeros(0, np.int64), [_hashed(three, 0x1111111111), four], affixes)


@dataclass
class LanguageField:
    """Weights (features x languages: hashed ones, a zero row, one row per lexicon and one for words in none), transitions, first states."""

    langs: list[str]
    weights: np.ndarray
    steps: np.ndarray
    start: np.ndarray
    known: np.ndarray
    known_as: np.ndarray

    def lexicon(self, w: Words) -> np.ndarray:
        """The row of each word's lexicon."""
        none = DIM + 1 + len(self.langs)
        if not len(self.known):
            return np.full(len(w.hash), none, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.known, w.hash), len(self.known) - 1)
        return np.where(self.known[at] == w.hash, DIM + 1 + self.known_as[at], none).astype(np.int32)

    def emissions(self, w: Words) -> np.ndarray:
        if not len(w.first):
            return np.zeros((0, len(self.langs)))
        grams = self.weights[w.grams[0]]
        grams += self.weights[w.grams[1]]
        out = np.add.reduceat(grams, w.letter_start, axis=0)
        for f in (*w.affixes, self.lexicon(w)):
            out += self.weights[f]
        return out.astype(np.float64)


def forward_backward(emit: np.ndarray, steps: np.ndarray, start: np.ndarray, chain_start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's distribution over states; with `pairs` also the expected transitions (states x states) and (states) beginnings.

    Chains are the words from one of `chain_start` to the next. All chains take a step at once, the longest first, so a step
    is a few operations on arrays.
    """
    n, k = emit.shape
    gamma, between, begin = np.zeros((n, k)), np.zeros((k, k)), np.zeros(k)
    if not n:
        return gamma, between, begin
    length = np.diff(np.append(chain_start, n))
    order = np.argsort(-length, kind="stable")
    first, length = chain_start[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0]), "left")
    x = np.exp(emit - emit.max(axis=1, keepdims=True)) + 1e-30
    t_, s_ = np.exp(steps), np.exp(start)
    alpha = np.empty((n, k))
    a = x[first] * s_
    a /= a.sum(axis=1, keepdims=True)
    alpha[first] = a
    for t in range(1, len(active)):
        at = first[: active[t]] + t
        a = (a[: active[t]] @ t_) * x[at]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    b = np.ones((active[-1], k))
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        if len(b) < m:
            b = np.concatenate([b, np.ones((m - len(b), k))])
        at = first[:m] + t
        g = alpha[at] * b
        g /= g.sum(axis=1, keepdims=True)
        gamma[at] = g
        if not t:
            break
        right = x[at] * b
        if pairs:
            left = alpha[at - 1]
            weight = 1 / np.einsum("ni,ij,nj->n", left, t_, right)
            between += t_ * (left.T @ (right * weight[:, None]))
        b = right @ t_.T
        b /= b.sum(axis=1, keepdims=True)
    return gamma, between, gamma[chain_start].sum(axis=0)


def fit_field(pieces: list[tuple[str, bytes]], epochs: int = 5, rate: float = 0.3, decay: float = 1e-5, in_batch: int = 128) -> LanguageField:
    """The field for labelled pieces of lower-cased text: the likelihood of the words' labels, by Adagrad over chains in a fixed random order.

    A piece's words have its label; IN_CHAIN pieces in a row make a chain of switched languages.
    """
    langs = sorted({x for x, _ in pieces})
    k = len(langs)
    rng = np.random.default_rng(0)
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    w = words_of(np.frombuffer(b"".join(p + b"\n" for _, p in pieces) or b"\n", dtype=np.uint8))
    piece_end = np.cumsum([len(p) + 1 for _, p in pieces])
    piece = np.searchsorted(piece_end, w.first, "right")
    label = np.array([langs.index(x) for x, _ in pieces], dtype=np.int64)[piece] if len(pieces) else np.zeros(0, np.int64)
    distinct, which = np.unique(w.hash, return_inverse=True)
    counts = np.bincount(which * k + label, minlength=len(distinct) * k).reshape(-1, k) if k else np.zeros((0, 0))
    often = counts.sum(axis=1)
    lexical = np.flatnonzero((often >= LEAST) & (2 * counts.max(axis=1, initial=0) > often))
    lexical = np.sort(lexical[np.argsort(-often[lexical], kind="stable")][:LEXICON])
    field = LanguageField(langs, np.zeros((DIM + 2 + k, k), dtype=np.float32), np.zeros((k, k)), np.zeros(k), distinct[lexical], counts[lexical].argmax(axis=1) if len(lexical) else np.zeros(0, np.int64))
    if k < 2 or not len(label):
        return field
    # A lexicon word's own count would tell its label: what stands in the lexicon for its sake alone teaches too much, so LEAST is over 1.
    features = [*w.grams, *w.affixes, field.lexicon(w)]
    used, index = np.unique(np.concatenate(features), return_inverse=True)
    index = np.split(index, np.cumsum([len(f) for f in features])[:-1])
    zero = np.flatnonzero(used == DIM)
    weights, seen = np.zeros((len(used), k)), np.full((len(used), k), 1e-2)
    seen_steps, seen_start = np.full((k, k), 1e-2), np.full(k, 1e-2)
    letter_end = np.append(w.letter_start, len(w.grams[0]))
    chain = piece // IN_CHAIN
    chain_start = np.flatnonzero(np.diff(chain, prepend=-1))
    bounds = np.append(chain_start, len(label))
    groups = [(bounds[i], bounds[min(i + in_batch, len(chain_start))], chain_start[i : i + in_batch]) for i in range(0, len(chain_start), in_batch)]
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            lo, hi, starts = groups[g]
            la, lb = letter_end[lo], letter_end[hi]
            letters, own = [x[la:lb] for x in index[:2]], [x[lo:hi] for x in index[2:]]
            emit = np.add.reduceat(weights[letters[0]] + weights[letters[1]], w.letter_start[lo:hi] - la, axis=0) + sum(weights[x] for x in own)
            gamma, between, begin = forward_backward(emit, field.steps, field.start, starts - lo, pairs=True)
            y = label[lo:hi]
            gamma[np.arange(hi - lo), y] -= 1
            wide = np.repeat(gamma, np.diff(letter_end[lo : hi + 1]), axis=0)
            grad = np.stack([sum(np.bincount(x, v[:, j], len(used)) for x, v in ((letters[0], wide), (letters[1], wide), *((x, gamma) for x in own))) for j in range(k)], axis=1)
            follows = np.setdiff1d(np.arange(1, hi - lo), starts - lo)
            between -= np.bincount(y[follows - 1] * k + y[follows], minlength=k * k).reshape(k, k)
            begin -= np.bincount(y[starts - lo], minlength=k)
            for value, total, d in ((weights, seen, grad), (field.steps, seen_steps, between), (field.start, seen_start, begin)):
                d = d + decay * value
                total += d * d
                value -= rate * d / np.sqrt(total)
            weights[zero] = 0
    field.weights[used] = weights
    return field


def _lowered(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in pc.cast(pc.utf8_lower(pc.cast(column, pa.large_string())), pa.large_binary()).to_pylist()]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_bytes: int = TRAIN_BYTES) -> LanguageField:
    """The field learnt from texts and non-null languages of documents whose crc32(id) mod 3 is not 1; those without an id teach nothing.

    Every language gives pieces of its texts, each equally likely wherever it stands, `train_bytes` in all as expected: what the driver
    holds is bounded by that and the number of languages. Which pieces depends on the texts alone, not on order or partitions, and
    copies give theirs once. Null and empty texts give none; other columns are ignored; an empty table gives a field without languages.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & (F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 != 1)).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), text.alias("text"), F.octet_length(text).alias("n")).where("n > 0")
    # A row for each language.
    share = {r.lang: min(1.0, train_bytes / r.total) for r in rows.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    if not share:
        return fit_field([])
    rates = docs.sparkSession.createDataFrame(list(share.items()), "lang string, rate double")
    u = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    drawn = rows.join(F.broadcast(rates), "lang").withColumn("h", F.xxhash64(F.lit(7), "text")).withColumn("take", F.floor(F.col("rate") * F.ceil(F.col("n") / PIECE) + u).cast("int"))
    drawn = drawn.where("take > 0").select("lang", "text", "h", "take")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            langs, out = [], []
            for lang, text, h, take in zip(batch.column("lang").to_pylist(), _lowered(batch.column("text")), batch.column("h").to_pylist(), batch.column("take").to_pylist()):
                n = -(-len(text) // PIECE)
                for i in np.random.default_rng(h & (2**63 - 1)).choice(n, min(take, n), replace=False).tolist():
                    # From blank to blank, so that words stay whole.
                    lo = 0 if not i else text.find(b" ", i * PIECE - 1) + 1 or len(text)
                    hi = text.find(b" ", (i + 1) * PIECE - 1)
                    langs.append(lang)
                    out.append(text[lo : hi if hi >= 0 else len(text)])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "piece"])

    # Bounded by train_bytes a language.
    found = drawn.mapInArrow(of, "lang string, piece binary").distinct().collect()
    return fit_field(sorted((r.lang, bytes(r.piece)) for r in found))


def _labelled(texts: pa.Array, field: LanguageField) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words, np.ndarray]:
    """The buffer, where each text ends in it, each word's text, the words, and their distributions. A line is a chain."""
    parts = _lowered(texts)
    b = np.frombuffer(b"".join(p + b"\n" for p in parts), dtype=np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    w = words_of(b)
    line = np.cumsum(b == 10)[w.first] if len(w.first) else np.zeros(0, np.int64)
    gamma, *_ = forward_backward(field.emissions(w), field.steps, field.start, np.flatnonzero(np.diff(line, prepend=-1)))
    return b, ends, np.searchsorted(ends, w.first, "right"), w, gamma


def _batch_bytes(field: LanguageField) -> int:
    return max(1 << 16, (12 << 20) // max(4, len(field.langs)))


def predict(docs: DataFrame, field: LanguageField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_words, n_switches), a row per row of `docs`, from its whole text alone.

    lang_pred has the largest sum of the words' probabilities (of equals the first by name), score is its mean. Texts that are
    null or without a letter are UNKNOWN with score 0, and all are if the field has no languages. n_switches counts
    neighbouring words in a line whose likeliest languages differ. Memory grows with the longest text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.when(text.rlike(r"\p{L}"), text).alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        k = len(field.langs)
        for batch in small_batches(batches, _batch_bytes(field)):
            n = batch.num_rows
            if k:
                b, _, doc, w, gamma = _labelled(batch.column("text"), field)
                total = np.stack([np.bincount(doc, gamma[:, j], n) for j in range(k)], axis=1)
                count = np.bincount(doc, minlength=n)
                best, line = gamma.argmax(axis=1), np.cumsum(b == 10)[w.first] if len(w.first) else np.zeros(0, np.int64)
                switch = np.append((best[1:] != best[:-1]) & (line[1:] == line[:-1]), False)[: len(doc)]
                switches = np.bincount(doc, switch, n).astype(np.int64)
                pred = [field.langs[i] if c else UNKNOWN for i, c in zip(total.argmax(axis=1).tolist(), count.tolist())]
                score = np.where(count > 0, np.minimum(total.max(axis=1) / np.maximum(count, 1), 1.0), 0.0)
            else:
                pred, score, count, switches = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(count, pa.int64()), pa.array(switches, pa.int64())], ["doc_id", "lang_pred", "score", "n_words", "n_switches"])

    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, n_words long, n_switches long")


def spans(docs: DataFrame, field: LanguageField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans), a row per row of `docs`: runs of words of one language in a line, as (start, end, lang, score) in code points of the text.

    score is the mean probability of the language in the run. Null texts, texts without letters and a field without languages have no spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("score", pa.float64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in small_batches(batches, _batch_bytes(field)):
            out = [[] for _ in range(batch.num_rows)]
            if field.langs:
                b, ends, doc, w, gamma = _labelled(batch.column("text"), field)
                if len(doc):
                    best, line = gamma.argmax(axis=1), np.cumsum(b == 10)[w.first]
                    run = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (line[1:] != line[:-1])))
                    # Lower-casing keeps the number of code points.
                    point = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
                    base = point[np.concatenate([[0], ends[:-1]])]
                    size = np.diff(np.append(run, len(doc)))
                    score = np.add.reduceat(gamma[np.arange(len(doc)), best], run) / size
                    for r, s, v in zip(run.tolist(), size.tolist(), score.tolist()):
                        d = int(doc[r])
                        out[d].append({"start": int(point[w.first[r]] - base[d]), "end": int(point[w.end[r + s - 1]] - base[d]), "lang": field.langs[best[r]], "score": min(v, 1.0)})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:long,end:long,lang:string,score:double>>")


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return predict(docs, fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
