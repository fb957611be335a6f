"""Sum-of-squares packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import small_batches, table

#: Closes every document.
END_ID = 2
#: The vocabulary's splitting rule.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Ids:
    """Token ids of whole texts, as the `tokenizers` file gives them.

    With the same vocabulary as ranks, `tiktoken` finds the same ids in a sixth of the time; texts that hold a special
    token's string, and all texts without such a file, go through `tokenizers` itself. Tests hold one against the other on whole
    documents and on strings of letters, marks, digits, signs and spaces of many scripts.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=())


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt): every document's ids and the end id, longer ones cut.

    Only documents of more than `length` ids are cut, into pieces of `length`; the first piece takes what is over.
    Null text counts as empty: one piece, the end id.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen = Ids(tokenizer_path, ranks_path), 0
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in small_batches(batches):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = ids(text or "").astype("<u4", copy=False).tobytes() + end
                n = len(data) // 4
                at, size, seen = 0, n % length or min(n, length), seen + 1
                for k in range((n + length - 1) // length):
                    out.append((doc, k, at, size, zlib.crc32(data[4 * at : 4 * (at + size)]), seen))
                    at, size = at + size, length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


def sum_of_squares(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, largest first, placed where the sum of squared counts of open bins per gap is least.

    counts[g] is the number of open bins with gap g. An item of size s goes into a bin of gap g, which then has gap
    g - s; full bins are closed and count nothing. Ties go to the smallest gap. A new bin is opened only if none has
    room: with a thousand gaps and sizes of all kinds, leaving that to the squares too opens 2 % more.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    made = 0
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[k]
        # Moving a bin from gap g to g - s changes the sum of squares by 2 (counts[g - s] - counts[g] + 1); to gap 0, by 1 - 2 counts[g].
        after = 2 * (counts[: capacity - s + 1] - counts[s:] + 1)
        after[0] = 1 - 2 * counts[s]
        after[counts[s:] == 0] = np.iinfo(np.int64).max
        best = int(after.argmin())
        if counts[best + s]:
            b, used = bins[best + s].pop()
            counts[best + s] -= 1
        else:
            b, used, best, made = made, 0, capacity - s, made + 1
        placed[k] = (b, used)
        if best:
            bins[best].append((b, used + s))
            counts[best] += 1
    return placed


def pack(parts: DataFrame, n_docs: int, length: int = 1024, per_task: int = 50_000) -> DataFrame:
    """`parts` with sequence_id and offset.

    Pieces of full length are sequences of their own. The others, at most one a document, are dealt by a hash over
    tasks of about `per_task` each and packed there; a task can leave a few sequences part-filled, so that
    waste doesn't grow with the input. Rows of one id are dealt apart by their place in their task. Ties in length are packed in the
    order in which they come; repeated rows are packed one by one; an empty table gives an empty result.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, rest, made = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            size = batch.column("length").to_numpy()
            full = np.flatnonzero(size == length)
            if len(full):
                t = batch.take(pa.array(full)).drop_columns(["salt"])
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(base + made + np.arange(len(full))), pa.array(np.zeros(len(full), dtype=np.int64))], names)
                made += len(full)
            if len(full) < len(size):
                rest.append(batch.take(pa.array(np.flatnonzero(size < length))).drop_columns(["salt"]))
        if rest:
            t = pa.Table.from_batches(rest).combine_chunks()
            placed = np.array(sum_of_squares(t.column("length").to_pylist(), length), dtype=np.int64)
            t = t.append_column("sequence_id", pa.array(base + made + placed[:, 0])).append_column("offset", pa.array(placed[:, 1]))
            yield from t.to_batches(max_chunksize=10_000)

    names = [*(c for c in parts.columns if c != "salt"), "sequence_id", "offset"]
    tasks = max(1, round(n_docs / per_task))
    dealt = parts.repartition(tasks, F.xxhash64("doc_id", "salt", "ids_crc32", "piece"))
    return dealt.mapInArrow(of, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents packed into sequences of `length` ids.

    Null and empty texts are packed as the end id alone; repeated rows and null ids are packed row by row; other
    columns are ignored. An empty table gives an empty result. Every sequence's offsets run without gaps from 0.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path, ranks_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack(pieces(docs, tokenizer_path, ranks_path, id_col, text_col, length), docs.count(), length)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
