"""The pipeline's near-duplicate stage against brute force: every pair of five-word similarity 0.8 is found."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from jobloom.llm import neardup
from jobloom.llm.common import table


def brute(rows):
    """Smallest id of each text's group, all pairs compared."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset(" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()
    root = {i: i for i in sets}
    ids, links, linked = sorted(sets), 0, []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links += 1
                linked.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root, links


@pytest.mark.parametrize(("tile", "sample", "common"), [(2048, 32, 4), (3, 1, 2)])
def test_every_near_copy_is_found(spark, docs, sf, monkeypatch, tile, sample, common):
    """Edits on either side of 0.8, short texts, shared passages and tiles of three; common shingles last or none."""
    for name, value in (("TILE", tile), ("SAMPLE", sample), ("COMMON", common)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = [(0, ""), (1, None), (2, "one Two"), (3, "ONE  two"), (4, "one two three")]
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((8, 30, 60, 150)))] + (passage if g % 3 == 0 else [])
        for _ in range(rng.randint(1, 7)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 30))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(t)))
    root, links = brute(rows)
    assert links > 50
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs(rows), sf).collect()}
    assert kept == set(root.values())


def test_recall_on_documents(spark, sf):
    """The stage on the whole table of documents: it keeps what comparing all pairs keeps."""
    d = table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    root, links = brute(rows)
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, d, sf).collect()}
    assert links > 0 and kept == set(root.values())
