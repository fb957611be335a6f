"""Benchmark decontamination by the q-gram lemma over diagonal bands, and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import as_bytes, small_batches, table

#: Letters in a gram: 8 to 16.
Q = 12
#: Edits allowed, as a share of an item's length.
RATE = 0.07
#: Characters of items indexed, and so broadcast, at once; more items take more passes over the documents.
BLOCK_CHARS = 4 << 20
#: Bytes of texts that are looked through together.
BUFFER = 256 << 10

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Stands between texts; no item holds it.
_GAP = b"\n"


def folded(text: bytes | None) -> bytes:
    """A-Z lower-cased, runs of other ASCII characters than letters and digits as one space, ends trimmed."""
    return b" ".join((text or b"").translate(_FOLD).split())


def grams(a: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code of every q-gram: exact for 8 letters, a hash of two halves for more."""
    if len(a) < q:
        return np.zeros(0, dtype=np.uint64)
    c = a.astype(np.uint64)
    for k in (1, 2, 4):
        c = c[:-k] | c[k:] << np.uint64(8 * k)
    return c if q == 8 else c[: len(a) - q + 1] * _SPREAD ^ c[q - 8 :]


def best_alignment(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """(edits, end) of the best alignment of the whole item within `text`, on diagonals low..high (text place less item place)."""
    width = high - low + 1
    padded = np.full(len(item) + width, 10, dtype=np.uint8)
    first, last = max(low, 0), min(len(text), len(item) + high)
    if last > first:
        padded[first - low : last - low] = text[first:last]
    steps = np.arange(width)
    cost = np.zeros(width, dtype=np.int64)
    for i, letter in enumerate(item):
        now = cost + (padded[i : i + width] != letter)
        now[:-1] = np.minimum(now[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(now - steps) + steps
    k = int(cost.argmin())
    return int(cost[k]), len(item) + low + k


class GramIndex:
    """Postings of all q-grams of some items, and what each item needs for a match."""

    def __init__(self, items: list[tuple[int, bytes]], q: int, rate: float):
        self.q, self.ids = q, [i for i, _ in items]
        self.letters = [np.frombuffer(t, dtype=np.uint8) for _, t in items]
        size = np.array([len(t) for _, t in items], dtype=np.int64)
        #: As many edits as the rate gives, and as leave one shared gram at least.
        self.edits = np.maximum(0, np.minimum((size * rate).astype(np.int64), (size - q) // q))
        self.least = size - q + 1 - q * self.edits
        self.short = [k for k, n in enumerate(size) if n < q]
        codes = [grams(x, q) for x in self.letters]
        code = np.concatenate([np.zeros(0, dtype=np.uint64), *codes])
        order = np.argsort(code, kind="stable")
        self.item = np.repeat(np.arange(len(items)), [len(c) for c in codes])[order]
        self.place = np.concatenate([np.zeros(0, dtype=np.int64), *[np.arange(len(c)) for c in codes]])[order].astype(np.int64)
        self.code, self.begin = np.unique(code[order], return_index=True)
        self.end = np.append(self.begin[1:], len(code)).astype(np.int64)
        self.bits = np.uint64(64 - min(26, max(16, int(np.log2(len(code) + 1)) + 6)))
        self.there = np.zeros(1 << (64 - int(self.bits)), dtype=bool)
        self.there[self.code * _SPREAD >> self.bits] = True

    def matches(self, buffer: bytes) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) in `buffer`, texts with gaps between them: one for each item and band that aligns."""
        a = np.frombuffer(buffer, dtype=np.uint8)
        found = []
        for k in self.short:
            at, word = -1, bytes(self.letters[k])
            while (at := buffer.find(word, at + 1)) >= 0:
                if buffer[at - 1 : at] in (b"", b" ", _GAP) and buffer[at + len(word) : at + len(word) + 1] in (b"", b" ", _GAP):
                    found.append((k, 0, at, at + len(word)))
        code = grams(a, self.q)
        at = np.flatnonzero(self.there[code * _SPREAD >> self.bits]) if len(self.code) else np.zeros(0, dtype=np.int64)
        slot = np.minimum(np.searchsorted(self.code, code[at]), max(len(self.code) - 1, 0))
        same = self.code[slot] == code[at] if len(at) else np.zeros(0, dtype=bool)
        at, slot = at[same], slot[same]
        count = self.end[slot] - self.begin[slot]
        if not len(at):
            return found
        post = np.repeat(self.begin[slot] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        item = self.item[post]
        step = self.edits[item] + 1
        # A match's diagonals differ by its edits at most, so they lie within one of the bands of two steps that begin at every step.
        off = max(len(x) for x in self.letters) + 2
        band = (np.repeat(at, count) - self.place[post]) // step + off
        span = np.int64(len(a) + 2 * off)
        key, shared = np.unique(np.concatenate([item * span + band, item * span + band - 1]), return_counts=True)
        near = key // span
        enough = shared >= self.least[near]
        for k, b in zip(near[enough].tolist(), (key - near * span - off)[enough].tolist()):
            x, e = self.letters[k], int(self.edits[k])
            low, high = b * (e + 1), (b + 2) * (e + 1) - 1
            edits, end = best_alignment(x, a, low, high)
            if edits <= e:
                back, length = best_alignment(x[::-1], a[max(0, end - len(x) - e) : end][::-1], -e, e)
                found.append((k, edits, end - length if back == edits else end - len(x), end))
        return found


    def best_matches(self, texts: list[bytes | None]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(row, item) -> (edits, start, length) of the best match of each item in each text."""
        texts = [folded(t) for t in texts]
        begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k, edits, start, end in self.matches(_GAP.join(texts)):
            row = int(np.searchsorted(begins, end - 1, side="right")) - 1
            place = (edits, max(0, start - int(begins[row])), end - start)
            best[row, k] = min(best.get((row, k), place), place)
        return best


def benchmark_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, n_edits, start, length): for each text and item, the best place where the text holds the item.

    Texts are folded (see `folded`); start and length count bytes of the folded text. An item of m letters
    may differ by rate * m edits, fewer if less than one shared q-gram were left; items shorter than q match whole
    words exactly. Shared q-grams are counted in overlapping diagonal bands; by the q-gram lemma a band with a match
    holds m - q + 1 - q * edits of them at least, and those that do are aligned. Nothing is sampled or capped: items are
    indexed in blocks of bounded size, each run over all texts. Null and empty texts and items match nothing.
    Repeated rows each give their rows; extra columns are ignored; an empty table on either side gives an empty result.
    """
    schema = "doc_id long, item_id long, n_edits int, start long, length long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = None
    for block in _blocks(items.select(item_id_col, item_text_col)):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def of(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = GramIndex(shared.value, q, rate)
            for batch in small_batches(batches, BUFFER):
                best = index.best_matches(as_bytes(batch.column(1)))
                ids = batch.column(0).to_pylist()
                out = [(ids[row], index.ids[k], *v) for (row, k), v in best.items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "n_edits", "start", "length"])

        part = rows.mapInArrow(of, schema)
        parts = part if parts is None else parts.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if parts is None else parts


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The folded items in blocks of at most BLOCK_CHARS bytes (or one item), fetched a partition at a time."""
    block, size = [], 0
    for i, text in items.distinct().toLocalIterator():
        if word := folded((text or "").encode()):
            if block and size + len(word) > BLOCK_CHARS:
                yield block
                block, size = [], 0
            block.append((i, word))
            size += len(word)
    if block:
        yield block


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """`docs` without the rows whose text holds a benchmark item (see `benchmark_matches`); columns unchanged, whatever their names.

    Null and empty texts hold nothing; null and empty items are held by nothing; repeated rows stay or go together; equal items
    count once. Without items all rows stay; an empty table gives an empty result.
    """
    kept = docs
    for block in _blocks(items.select(item_id_col, item_text_col)):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def of(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = GramIndex(shared.value, q, rate)
            for batch in small_batches(batches, BUFFER):
                hit = {row for row, _ in index.best_matches(as_bytes(batch.column(text_col)))}
                yield batch.filter(pa.array([row not in hit for row in range(batch.num_rows)], pa.bool_()))

        kept = kept.mapInArrow(of, docs.schema)
    return kept


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
