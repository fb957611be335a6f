"""The prefix trie against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from jobloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(convs: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, cs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(cs) - 1) * len(path[-1][1].encode()) if path else 0
    out = set()
    for path, cs in members.items():
        ends = ",".join(str(c) for c in cs if len(convs[c]) == len(path))
        out.add((cs[0], len(path), members[path[:-1]][0] if path else None, len(cs), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def ordered(rows) -> dict[int, list[tuple[str, str]]]:
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in by.items()}


def rebuild(of: dict) -> dict:
    out = {}
    for c, own in of.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = of.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])
        out[c] = base[:h] + own[h:]
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def awkward_rows():
    """Long and short conversations, gaps in ids, copies, ties, nulls in every column, negative ids, empty texts."""
    rng = random.Random(11)
    words = ["yes", "no", "", "Ä ö", "maybe\n", "ok"]
    rows = []
    for c in [*range(-12, 40), 103, 104, 205]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for t in range(rng.choice([0, 1, 2, 9, 12]))]
    rows += [(c, t, "user" if t % 2 else "assistant", f"turn {t}") for c in range(300, 330) for t in range(10)]
    rows += [(c, t, "user", f"t{t % 7}") for c, n in ((400, 200), (401, 130), (500, 64), (505, 65), (510, 129)) for t in range(n)]
    rows += [(50, None, "user", "first"), (50, None, None, None), (50, 1, "user", "tie"), (50, 1, "assistant", "tie"), (50, 1, "user", "tie"), (None, 0, "user", "nobody"), (51, 0, None, None), (52, 0, "", "")]
    rng.shuffle(rows)
    return rows


def test_trie_of_rebuilt_conversations(spark, tmp_path):
    rows = awkward_rows()
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as place", "'x' as digest", "0 as depth", "2 as bytes").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in trie.op11_trie(spark, str(tmp_path)).select(*COLUMNS).collect()}
    assert got == plain_trie(rebuild(ordered(rows)))


def test_trie_of_conversations_as_they_are(spark):
    """Preorder: a node's subtree is the interval from pos to end; its last turn's text comes back."""
    rows = awkward_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = trie.prefix_trie(trie.turns(df))
    convs = ordered(rows)
    out = trie.with_turns(nodes, df).collect()
    assert {tuple(r[c] for c in COLUMNS) for r in out} == plain_trie(convs)
    path = {r.pos: tuple(convs[r.conv_id][: r.depth]) for r in out}
    assert sorted(path) == list(range(len(out)))
    for r in out:
        assert (r.role, r.text) == (path[r.pos][-1] if r.depth else (None, None))
        assert [p for p in path if path[p][: r.depth] == path[r.pos]] == [p for p in path if r.pos <= p <= r.end]


def test_one_common_conversation_in_many_copies(spark, monkeypatch):
    """Thousands of members of one node are hashed in pieces."""
    monkeypatch.setattr(trie, "PIECE", 100)
    rows = [(c, t, "user", f"t{t}") for c in range(3000) for t in range(2)] + [(5000, 0, "user", "t0")]
    got = {tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(trie.turns(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == plain_trie(ordered(rows))


def test_no_conversations(spark):
    empty = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert trie.prefix_trie(trie.turns(empty)).collect() == []
    assert trie.prefix_trie(*trie.rebuilt(trie.turns(empty.limit(0)))).collect() == []
