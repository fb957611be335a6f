"""Operators whose results are fixed, each against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from jobloom.llm import components, licenses, linededup, packing, sharding, simhash, suffixes
from jobloom.llm.common import table
from jobloom.llm.queries import QUERIES, SQL
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), SQL[name], sf)


# --- repeated byte strings -------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    """Removed flags per text: every byte of a string of `length` that also starts earlier."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            s = data[at : at + length]
            if s in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def repeats_corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(3)]
        if i % 2:
            p = rng.choice(passages)
            a = rng.randint(0, 40)
            parts.insert(1, p[a : a + rng.randint(60, 200)])
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "x" * 500), (103, "x" * 350), (104, "ab" * 300), (105, None), (106, ""), (107, passages[0] + passages[0])]
    return rows


@pytest.mark.parametrize("hot", [100_000, 5, 1])
def test_repeated_bytes(docs, hot):
    rows = repeats_corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeated_bytes(docs(rows), hot=hot).drop("kept").collect()}
    assert got == brute_repeats(rows, 100)


def test_deep_shallow_sorts():
    rng = random.Random(3)
    for n in (0, 1, 2, 50, 300):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))).encode() for _ in range(n)]
        order, lcp = suffixes.deep_shallow(strings, 4)
        assert sorted(order) == list(range(n))
        assert [strings[i] for i in order] == sorted(strings)
        assert lcp[1:] == [suffixes.shared_prefix(strings[i], strings[j]) for i, j in zip(order, order[1:])]


# --- fingerprints ----------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [words[k : k + 4] for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("tile_rows", [2048, 4])
def test_near_duplicates(docs, tile_rows):
    rng = random.Random(11)
    vocabulary = ["w%d" % k for k in range(400)]
    rows = [(0, ""), (1, None), (2, "one Two")]
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(200)]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(200)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(t)))
    fps = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(rows), tile_rows=tile_rows).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    kept = {r.doc_id for r in simhash.one_of_each_group(docs(rows)).collect()}
    assert kept == set(want.values())


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)] + [(7, 7)]
    root = {}
    for a, b in pairs:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: root[x] for x in linked}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- lines -----------------------------------------------------------------------------------------------------


def test_line_windows(docs):
    rng = random.Random(2)
    lines = [f"line {k}" for k in range(12)]
    rows = [(i, "\n".join(rng.choice([*lines, "", "  "]) for _ in range(rng.randint(0, 30)))) for i in range(40)]
    seen, want = set(), {}
    for i, t in rows:
        every = t.split("\n")
        full = [k for k, x in enumerate(every) if x.strip()]
        gone = set()
        for k in range(len(full) - 2):
            w = tuple(every[full[k + d]].strip() for d in range(3))
            if w in seen:
                gone |= {full[k + d] for d in range(3)}
            seen.add(w)
        want[i] = ("\n".join(x for k, x in enumerate(every) if k not in gone), len(gone))
    got = {r.doc_id: (r.text, r._removed) for r in linededup.remove_repeated_lines(docs(rows)).collect()}
    assert got == want


# --- shards ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("range_bytes", [sharding.RANGE_BYTES, 500])
def test_shards(docs, range_bytes):
    rng = random.Random(1)
    rows = [(i // 2, "é" * rng.randint(0, 200)) for i in range(900)] + [(7, "same id " + str(k)) for k in range(600)] + [(None, None)] * 20
    out = sharding.shard(docs(rows), 10, range_bytes=range_bytes).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in out:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(10)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in out)
    keys = sorted((r.shard, -1 if r.doc_id is None else r.doc_id) for r in out)
    assert [k for _, k in keys] == sorted(k for _, k in keys)


def test_shards_end_where_all_rows_in_order_say(docs):
    """Against all rows in key order: a shard ends at the row's end that is nearest to its part of all bytes."""
    rng = random.Random(5)
    rows = [(i, "x" * rng.choice([0, 5, 60, 400, 3000])) for i in rng.sample(range(5000), 700)]
    out = {r.doc_id: r for r in sharding.shard(docs(rows), 8, range_bytes=2000).collect()}
    sizes = [(i, len(t) + 16) for i, t in sorted(rows)]
    total, at, ends = sum(n for _, n in sizes), 0, [0]
    for _, n in sizes:
        at += n
        ends.append(at)
    for k in range(1, 8):
        first = min(j for j, (i, _) in enumerate(sizes) if out[i].shard >= k)
        assert abs(ends[first] - k * total / 8) == min(abs(e - k * total / 8) for e in ends)
    for k in range(8):
        own = [i for i, _ in sizes if out[i].shard == k]
        assert [out[i].slot for i in own] == list(range(len(own)))


# --- packing ---------------------------------------------------------------------------------------------------


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "Naïve", "don't", "42", "\n\n", "  ", "你好", "#x"]) for _ in range(rng.choice([0, 3, 80, 400, 1500])))) for i in range(60)] + [(60, None), (61, "")]
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    out = packing.packed_documents(docs(rows)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, ids in want.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(by_doc[i])):
            assert (piece, start) == (k, at) and (len(ids) > 1024 or length == len(ids)) and (k == 0 or length == 1024)
            at += length
        assert at == len(ids)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(map(len, want.values()))
    assert len(by_seq) <= total / 1024 * 1.05 + 1


def odd_strings():
    rng = random.Random(8)
    letters = ["a", "Z", "é", "ß", "ñ", "đ", "́", "‍", "你", "好", "한", "ا", "א", "ก", "्", "न", "𝔸", "😀", "👩‍🚀", "Ⅷ", "²", "½", "٣", "0", "9", "'s", "'T", "'re", "’s", "_", "-", "—", ".", "...", "$", "#", "\\", "\"", "<", "|", "\x00", "\x1c", "\x85", "\ufeff"]
    spaces = [" ", "  ", "\t", "\n", "\r\n", "\u00a0", "\u2003", "\u3000", "\u200b", "\u2028"]
    out = ["", " ", "\n\n", "  a", "a  ", "a\n", "can't won't I'LL", "x'S", "1234567890", "a1b2", "  \n  b", "\u00a0\u00a0x", "don''t"]
    out += ["".join(rng.choice(letters if rng.random() < 0.7 else spaces) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    return out


def test_fast_ids_are_those_of_tokenizers(spark):
    import public_tokenizers

    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = odd_strings() + [r.text or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    for t in texts:
        want = ids.tokenizer.encode(t, add_special_tokens=False).ids
        assert list(ids(t)) == want, repr(t)[:200]


def plain_sum_of_squares(sizes, capacity):
    """The same rule, every open bin tried for every item."""
    bins, placed = [], [None] * len(sizes)
    square = lambda gaps: sum(n * n for g, n in Counter(gaps).items() if g)
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        gaps = [capacity - b for b in bins]
        tries = [(square([*gaps[:i], gaps[i] - sizes[k], *gaps[i + 1 :]]), gaps[i] - sizes[k]) for i in range(len(bins)) if gaps[i] >= sizes[k]]
        if not tries:
            placed[k] = (capacity, 0)
            bins.append(sizes[k])
            continue
        best = min(tries)
        i = next(i for i in range(len(bins)) if gaps[i] - sizes[k] == best[1])
        placed[k] = (gaps[i], bins[i])
        bins[i] += sizes[k]
    return placed, sorted(bins)


def test_sum_of_squares_against_all_bins():
    rng = random.Random(12)
    for capacity in (10, 37, 64):
        for _ in range(20):
            sizes = [rng.randint(1, capacity - 1) for _ in range(rng.randint(0, 60))]
            got = packing.sum_of_squares(sizes, capacity)
            placed, bins = plain_sum_of_squares(sizes, capacity)
            assert [offset for _, offset in got] == [offset for _, offset in placed]
            filled = Counter()
            for (b, _), s in zip(got, sizes):
                filled[b] += s
            assert sorted(filled.values()) == bins


# --- licences --------------------------------------------------------------------------------------------------


def test_license_base(docs):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    rng = random.Random(9)
    words = "mit license apache general public LICENSE the é Éa 4 of-the".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(200, None)]
    for r in licenses.scan_licenses(docs(rows)).collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), dict(rows)[r.doc_id] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert {x for _, x in at} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_templates(docs):
    rows = [(1, "Some prose. This work is licensed under CC BY-SA 4.0, see below."), (2, "Released under the MIT License by us."), (3, "a license to operate heavy machinery was granted free of charge"), (4, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:")]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs(rows)).collect()}
    assert got == {1: "cc-by-sa", 2: "mit", 3: "", 4: "bsd"}


def brute_labels(words):
    """Labels of all templates that stand anywhere, every start tried."""
    out = set()
    for label, text, must in licenses.TEMPLATES:
        t = text.split()
        for start in range(-len(t), len(words)):
            got = sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(t)) / len(t)
            window = words[max(0, start - 2) : start + len(t) + 2] if start + len(t) + 2 > 0 else []
            if got >= licenses.LEAST and all(any(window[k : k + len(p.split())] == p.split() for k in range(len(window))) for p in must):
                out.add(label)
    return out


def by_all_places(index, words):
    """label -> best share, every template tried at every place."""
    out = {}
    for label, template, must in index.templates:
        for start in range(-len(template), len(words)):
            got = sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(template)) / len(template)
            window = words[max(0, start - 2) : max(0, start + len(template) + 2)]
            if got >= max(licenses.LEAST, out.get(label, 0)) and all(any(window[k : k + len(p)] == p for k in range(len(window) - len(p) + 1)) for p in must):
                out[label] = got
    return out


def test_license_whole_texts_and_spdx_lines(docs):
    whole = [(label, text) for label, text, _ in licenses.FULL_TEXTS]
    rows = [(i, "Copyright 2020 someone\n" + text) for i, (_, text) in enumerate(whole)] + [(100 + i, f"// SPDX-License-Identifier: {name}\nint main() {{}}") for i, name in enumerate(licenses.SPDX)]
    rows += [(200, "an SPDX license identifier names a licence"), (201, "# SPDX-License-Identifier: GPL-3.0-or-later")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(docs(rows)).collect()}
    assert [got[i] for i in range(len(whole))] == [(label, 1.0) for label, _ in whole]
    assert [got[100 + i][0] for i in range(len(licenses.SPDX))] == list(licenses.SPDX.values())
    assert got[200] == ("", 0.0) and got[201] == ("gpl", 1.0)


def test_license_index_of_a_thousand_templates():
    rng = random.Random(3)
    common = [f"c{i}" for i in range(30)]
    templates = [(f"t{t}", " ".join(own := [*rng.choices(common, k=12), f"own{t}", f"name{t // 2}", *rng.choices(common, k=6)]), [f"own{t} name{t // 2}"]) for t in range(1000)]
    df = {w.encode(): 10_000 for w in common}
    few, many = (licenses.LicenseIndex(templates[:n], df, 20_000) for n in (10, 1000))
    for _ in range(60):
        words = rng.choices(common, k=80)
        for t in rng.sample(range(1000), 2):
            at, own = rng.randrange(len(words)), templates[t][1].split()
            words[at:at] = [w if rng.random() < 0.8 else "x" for w in own]
        words = [w.encode() for w in words]
        there = set(words)
        # What a file enters, and so its cost, doesn't grow with the templates.
        assert len(many.entered(there)) <= 4
        assert set(few.entered(there)) <= set(many.entered(there))
        near = [t for t in many.templates if there.issuperset(w for p in t[2] for w in p)]
        small = licenses.LicenseIndex([])
        small.templates = near
        assert many.scan(words, there) == by_all_places(small, words)


def test_license_files_with_several_notices(docs):
    """Any two templates, all of them, and damaged ones among prose: nothing that stands there is lost."""
    rng = random.Random(3)
    texts = [t for _, t, _ in licenses.TEMPLATES]
    rows = [f"{a} then {b}" for k, a in enumerate(texts) for b in texts[k + 1 :]] + [" and ".join(texts)]
    for _ in range(200):
        words = " of the work ".join(rng.sample(texts, rng.randint(1, 4))).split()
        for _ in range(rng.randint(0, len(words) // 3)):
            words[rng.randrange(len(words))] = rng.choice("the other software and license".split())
        rows.append(" ".join(words))
    base = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = {i: brute_labels(t.split()) | {label for p, label in base.items() if f" {p} " in f" {t} "} for i, t in enumerate(rows)}
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.scan_licenses(docs(list(enumerate(rows)))).collect()}
    assert got == want
