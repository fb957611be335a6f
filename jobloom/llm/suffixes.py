"""Exact dedup of repeated byte strings: sparse suffix sorting, deep-shallow, over anchors that equal strings share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import as_bytes, bounds_of, cut, groups_of, null_to_low, small_batches, table

#: Letters of an anchor's gram.
GRAM = 24
#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 16
#: Suffixes sorted in one task; groups with more are divided by what blocks of their strings share.
HOT = 20_000
#: Offsets in a block: a group is divided into blocks of the first width, then of the next; a block of one is one string.
WIDTHS = (11, 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit polynomial hash of every run of k bytes, mixed; by doubling."""
    if len(a) < k:
        return np.zeros(0, dtype=np.uint64)
    power, size, base = a.astype(np.uint64) + np.uint64(1), 1, int(_BASE)
    out, done = None, 0
    while True:
        if k & size:
            if out is None:
                out = power[: len(a) - size + 1]
            else:
                n = len(a) - (done + size) + 1
                out = out[:n] * np.uint64(base) + power[done : done + n]
            done += size
        if done == k:
            break
        n = len(power) - size
        power = power[:n] * np.uint64(base) + power[size : size + n]
        base, size = base * base % (1 << 64), size * 2
    out = (out ^ out >> np.uint64(32)) * _MIX
    return out ^ out >> np.uint64(29)


def anchors(a: np.ndarray, begins: np.ndarray, sizes: np.ndarray, k: int, length: int) -> tuple[np.ndarray, ...]:
    """(place, gram's hash, first start, last start): chosen grams, and the starts of the `length`-byte strings they stand for.

    `a` holds texts one after the other; no string crosses a text's end. Every string is stood for by the gram
    of least hash in it, the last of equals. The choice depends on the string alone, so equal strings have equal anchors at
    the same offset.
    """
    h, w = gram_hashes(a, k), length - k + 1
    if len(h) < w:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    low = np.uint64((1 << 24) - 1)
    key, size = h & ~low | low - np.arange(len(h), dtype=np.uint64), 1
    while 2 * size <= w:
        key, size = np.minimum(key[: len(key) - size], key[size:]), 2 * size
    n = len(h) - w + 1
    least = np.minimum(key[:n], key[w - size : w - size + n])
    inside = np.zeros(len(a) + 1, dtype=np.int64)
    long = sizes >= length
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, begins[long] + sizes[long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[:n] > 0)
    if not len(starts):
        return starts, starts.astype(np.uint64), starts, starts
    place = (low - (least[starts] & low)).astype(np.int64)
    cut_at = np.flatnonzero((np.diff(place) != 0) | (np.diff(starts) != 1)) + 1
    first, last = np.concatenate([[0], cut_at]), np.concatenate([cut_at, [len(starts)]]) - 1
    place = place[first]
    return place, h[place], starts[first], starts[last]


def blind_trie(strings: list[bytes], depth: int) -> list[int]:
    """Indices of `strings`, which agree in `depth` bytes, in order: a trie that keeps branching depths and letters only.

    A string goes down by the letters at branching depths, is compared with the leaf it meets, and hangs where the two part.
    """
    letter = lambda i, d: strings[i][d] if d < len(strings[i]) else -1
    root: list = [None, [0]]  # a node: [depth, {letter: node}]; a leaf: [None, indices of equal strings]
    for i in range(1, len(strings)):
        path, node = [], root
        while node[0] is not None:
            path.append(node)
            x = letter(i, node[0])
            node = node[1][x] if x in node[1] else next(iter(node[1].values()))
        s, t = strings[i], strings[node[1][0]]
        d = shared_prefix(s, t, depth)
        if d == len(s) == len(t):
            node[1].append(i)
            continue
        parent = None
        for p in path:
            if p[0] > d:
                break
            parent = p
        if parent is not None and parent[0] == d:
            parent[1][letter(i, d)] = [None, [i]]
            continue
        below = root if parent is None else parent[1][letter(i, parent[0])]
        made = [d, {letter(i, d): [None, [i]], (t[d] if d < len(t) else -1): below}]
        if parent is None:
            root = made
        else:
            parent[1][letter(i, parent[0])] = made
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            order += node[1]
        else:
            stack += [node[1][x] for x in sorted(node[1], reverse=True)]
    return order


def shared_prefix(s: bytes, t: bytes, known: int = 0) -> int:
    """Length of the longest common prefix, at least `known`."""
    n = min(len(s), len(t))
    lo, hi = known, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if s[lo:mid] == t[lo:mid] else (lo, mid - 1)
    return lo


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(order, lcp) of the strings: multikey quicksort down to `shallow` bytes beyond what all share, then blind tries.

    lcp[k] is the common prefix of the k-th string in order and the one before.
    """
    if not strings:
        return [], []
    common = shared_prefix(min(strings), max(strings))
    order: list[int] = []
    stack = [(list(range(len(strings))), common)]
    while stack:
        part, d = stack.pop()
        if len(part) < 2 or d >= common + shallow:
            order += part if len(part) < 2 else [part[i] for i in blind_trie([strings[i] for i in part], d)]
            continue
        at = lambda i, d=d: strings[i][d] if d < len(strings[i]) else -1
        pivot = sorted((at(part[0]), at(part[len(part) // 2]), at(part[-1])))[1]
        low, same, high = [], [], []
        for i in part:
            x = at(i)
            (low if x < pivot else same if x == pivot else high).append(i)
        stack.append((high, d))
        if pivot < 0:
            stack.append((low, d))
            order += same  # ended strings come first: nothing is lower
        else:
            stack.append((same, d + 1))
            stack.append((low, d))
    return order, [0] + [shared_prefix(strings[i], strings[j]) for i, j in zip(order, order[1:])]


def repeats_of_gram(contexts: list[bytes], near: list[int], far: list[int], length: int) -> list[tuple[int, int, int]]:
    """(member, from, to): runs of offsets at which a member's string stands in an earlier member too.

    Members share a gram and come in text order. A member's strings start `near` to `far` bytes before its gram; its context
    runs from the first one's start to the last one's end.
    """
    order, lcp = deep_shallow([c[f:] for c, f in zip(contexts, far)])
    # Of neighbours in order that agree in all their bytes the earliest stands for the others.
    first: dict[tuple[bytes, int], int] = {}
    out, own, least = [], [], length
    for o, common in zip(order, lcp):
        least = min(least, common)
        if common < len(contexts[o]) - far[o]:
            first = {}
        i = first.setdefault((contexts[o], far[o]), o)
        if i == o:
            own.append((o, least))
            least = length
        else:
            out.append((o, near[o], far[o]))
    if len(own) < 2:
        return out
    order, lcp = [o for o, _ in own], [n for _, n in own]
    own = order
    left = {i: contexts[i][: far[i]] for i in own}
    hit: dict[int, list[int]] = {}
    for j in range(min(near[i] for i in own), max(far[i] for i in own) + 1):
        seen: dict[bytes, list[int]] = {}
        least, groups = length, [seen]
        for i, common in zip(order, lcp):
            least = min(least, common)
            if near[i] <= j <= far[i]:
                if least < length - j:
                    seen = {}
                    groups.append(seen)
                seen.setdefault(left[i][far[i] - j :], []).append(i)
                least = length
        for g in groups:
            for same in g.values():
                if len(same) > 1:
                    earliest = min(same)
                    for i in same:
                        if i != earliest:
                            hit.setdefault(i, []).append(j)
    for i, js in hit.items():
        a = b = js[0]
        for j in js[1:]:
            if j != b + 1:
                out.append((i, a, b))
                a = j
            b = j
        out.append((i, a, b))
    return out


#: Bits of a gram's hash that are shuffled; grams that agree in them are told apart by the sort.
_GRAM_BITS = (1 << 48) - 1


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(gram, id, th, place, span) of every anchor of `texts` (id, th, text); span packs the offsets far * 128 + near."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256 << 10):
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts, rows, moved = [], [], []
            for r, t in enumerate(as_bytes(batch.column(2))):
                step = 8 << 20
                for at in range(0, max(1, len(t or b"") - length + 1), step):
                    parts.append((t or b"")[at : at + step + length - 1])
                    rows.append(r)
                    moved.append(at)
            # Buffers stay below the 2^24 places that anchors() can tell apart.
            at = 0
            while at < len(parts):
                n, size = at + 1, len(parts[at])
                while n < len(parts) and size + len(parts[n]) < 1 << 20:
                    size, n = size + len(parts[n]), n + 1
                sizes = np.array([len(x) for x in parts[at:n]], dtype=np.int64)
                begins = np.cumsum(sizes) - sizes
                place, gram, first, last = anchors(np.frombuffer(b"".join(parts[at:n]), dtype=np.uint8), begins, sizes, GRAM, length)
                k = np.searchsorted(begins, first, "right") - 1
                row, offset = np.array(rows[at:n])[k], np.array(moved[at:n])[k] - begins[k]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram.view(np.int64) & _GRAM_BITS, ids[row], ths[row], (place + offset).astype(np.int32), ((place - first) * 128 + place - last).astype(np.int32))], ["gram", "id", "th", "place", "span"])
                at = n

    return texts.mapInArrow(of, "gram long, id long, th long, place int, span int")


def repeated_runs(texts: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """(id, th, runs): for each of the texts (id, th, text; rows that repeat one in all three count once), the byte runs [from, to) that earlier strings cover.

    Anchors (about one in 39 bytes) whose gram is alone are dropped; counts are combined before the shuffle. The rest get
    the bytes around them, and each gram's suffixes are sorted and compared in one task. A gram with more than `hot`
    suffixes is divided: of those that agree in all their bytes the earliest, a minimum combined before the shuffle, stands
    for the others; the rest fall into blocks of strings at neighbouring offsets, each by all the bytes that they share, so
    that what falls together is equal but for a few bytes at its ends, and is sorted. What still has more is divided by
    single offsets, where a group is one string, of which the earliest place is a minimum again.
    """
    rows = _anchor_rows(texts, length)
    counts = rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    # The key isn't the one that is grouped by, so the join deals both sides anew, and a gram that many hold can be split.
    met = rows.join(counts.select(F.abs("gram").alias("gram"), "n"), "gram")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 20):
            lists = batch.column("at")
            each = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            place, span = each.field("place").to_numpy(), each.field("span").to_numpy()
            texts = as_bytes(batch.column("text"))
            begin, end = place - span // 128, place - span % 128 + length
            found = [texts[r][b:e] for r, b, e in zip(row.tolist(), begin.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([each.field("gram"), batch.column("id").take(pa.array(row)), batch.column("th").take(pa.array(row)), each.field("place"), each.field("span"), pa.array(found, pa.binary())], ["gram", "id", "th", "place", "span", "context"])

    def around(some: DataFrame) -> DataFrame:
        by_text = some.groupBy("id", "th").agg(F.collect_set(F.struct("gram", "place", "span")).alias("at"))
        return texts.join(by_text, ["id", "th"]).select("id", "th", "text", "at").mapInArrow(contexts, "gram long, id long, th long, place int, span int, context binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, ["gram"]):
            again = np.concatenate([[False], np.all([(v := t.column(c).to_numpy())[1:] == v[:-1] for c in ("gram", "id", "th", "place")], axis=0)])
            t = t.filter(pa.array(~again))
            gram, ids, ths, place, span = (t.column(c).to_numpy() for c in ("gram", "id", "th", "place", "span"))
            context = t.column("context").to_pylist()
            far, near = (span // 128).tolist(), (span % 128).tolist()
            b = bounds_of([gram])
            out = []
            for s, e in zip(b[:-1].tolist(), b[1:].tolist()):
                if e - s > 1:
                    out += [(s + i, lo, hi) for i, lo, hi in repeats_of_gram(context[s:e], near[s:e], far[s:e], length)]
            if out:
                i, lo, hi = np.array(out, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in ((ids[i], np.int64), (ths[i], np.int64), (place[i] - hi, np.int32), (place[i] - lo + length, np.int32))], ["id", "th", "from", "to"])

    def sorted_runs(some: DataFrame) -> DataFrame:
        return some.repartition("gram").sortWithinPartitions("gram", "id", "th", "place").mapInArrow(compare, "id long, th long, from int, to int")

    def divided(some: DataFrame, width: int) -> DataFrame:
        """The rows of `some`, one for each block of `width` offsets: gram stands for the block and what its strings share."""
        near, far = F.col("span").bitwiseAND(127), F.shiftright("span", 7)
        blocks = some.select("*", F.explode(F.sequence(F.floor(near / width).cast("int"), F.floor(far / width).cast("int"))).alias("b"))
        low, high = F.col("b") * width, F.col("b") * width + (width - 1)
        shared = F.substring("context", far - low + 1, F.lit(length) - high + low)
        own_near, own_far = F.greatest(near, low), F.least(far, high)
        return blocks.select(F.xxhash64("gram", "b", shared).alias("gram"), "id", "th", "place", (own_far * 128 + own_near).alias("span"), F.substring("context", far - own_far + 1, own_far - own_near + length).alias("context"))

    found = sorted_runs(around(met.where(F.col("n") <= hot)))
    more = around(met.where(F.col("n") > hot))
    place = F.struct("id", "th", "place")
    firsts = more.groupBy("gram", "span", "context").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    # Here too the keys aren't the ones that are grouped by: equal contexts of many texts can be split.
    copies = more.join(firsts.where("n > 1").select(F.abs("gram").alias("gram"), "span", "context", "first"), ["gram", "span", "context"]).where(place > F.col("first"))
    found = found.union(copies.select("id", "th", (F.col("place") - F.shiftright("span", 7)).alias("from"), (F.col("place") - F.col("span").bitwiseAND(127) + length).alias("to")))
    more = firsts.select("gram", "first.*", "span", "context")
    for width in WIDTHS:
        more = divided(more, width)
        if width > 1:
            n = more.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
            more = more.join(n, "gram")
            found = found.union(sorted_runs(more.where(F.col("n") <= hot).drop("n")))
            more = more.where(F.col("n") > hot).drop("n")
    string = more.select("id", "th", (F.col("place") - F.shiftright("span", 7)).alias("from"), "context")
    earliest = string.groupBy("context").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "from")).alias("first")).where("n > 1").select(F.substring("context", 1, length).alias("context"), "first")
    later = string.join(earliest, "context").where(F.struct("id", "th", "from") > F.col("first")).select("id", "th", "from", (F.col("from") + length).alias("to"))
    return found.union(later).groupBy("id", "th").agg(F.collect_list(F.struct("from", "to")).alias("runs"))


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), a row per row of `docs`: bytes as UTF-8, kept binary.

    Every byte of a `length`-byte string that also starts earlier (smaller id, null first; or same text, earlier
    start) goes, judged on the input; no string crosses texts. Equal texts are sorted once: all but those of the least id go
    whole. Rows of one id and text are one text, neither earlier; rows of one id and other text are ordered by its hash.
    Null text counts as empty. Other columns are ignored; an empty table gives an empty result.
    """
    # A null id is the least of all from here on. All joins of texts are on (id, th): one exchange of the texts serves them.
    rows = docs.select(null_to_low(F.col(id_col)).alias("id"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # A text is named by two hashes and its size; of equal ones the least id is sorted.
    mark = F.struct(F.xxhash64("text", F.lit(1)).alias("x"), F.octet_length("text").alias("n"))
    lone = cut(rows.select("id", "th", mark.alias("mark")).groupBy("th", "mark").agg(F.min("id").alias("id")).select("id", "th"))
    texts = rows.join(lone.hint("shuffle_hash"), ["id", "th"])
    runs = repeated_runs(texts, length, hot)
    state = lone.join(runs, ["id", "th"], "left").select("id", "th", "runs", F.lit(True).alias("own"))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    def digest(text: pd.Series, own: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for t, mine, found in zip(text, own, runs):
            data = t.encode()
            if mine is not True:
                found = [{"from": 0, "to": len(data)}] if len(data) >= length else []
            parts, at, spans = [], 0, 0
            for b, e in sorted((r["from"], r["to"]) for r in (found if found is not None else [])):
                if b > at or not spans:
                    parts.append(data[at:b])
                    spans += 1
                at = max(at, e)
            kept = b"".join([*parts, data[at:]])
            out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    doc_id = F.when(F.col("id") > F.lit(-(2**63)), F.col("id")).alias("doc_id")
    return rows.join(state, ["id", "th"], "left").select(doc_id, digest("text", "own", "runs").alias("d")).select("doc_id", "d.*")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")
