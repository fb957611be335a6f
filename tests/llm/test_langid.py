"""The language field: exact marginals, held-out accuracy, switched texts, awkward tables."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import langid
from jobloom.llm.common import table

SF = "/root/testdata/sf0.01"


def test_marginals_against_all_paths():
    """Chains of different lengths, three states: every path's weight summed."""
    rng = np.random.default_rng(1)
    lengths, k = [4, 1, 6, 2, 5], 3
    emit, steps, start = rng.normal(size=(sum(lengths), k)) * 2, rng.normal(size=(k, k)), rng.normal(size=k)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    gamma, between, first = langid.forward_backward(emit, steps, start, begin, pairs=True)
    want, pairs = np.zeros_like(gamma), np.zeros((k, k))
    for b, n in zip(begin, lengths):
        paths = list(itertools.product(range(k), repeat=n))
        score = np.array([start[p[0]] + sum(emit[b + t, s] for t, s in enumerate(p)) + sum(steps[x, y] for x, y in zip(p, p[1:])) for p in paths])
        share = np.exp(score - score.max())
        share /= share.sum()
        for p, v in zip(paths, share):
            for t, s in enumerate(p):
                want[b + t, s] += v
            for x, y in zip(p, p[1:]):
                pairs[x, y] += v
    assert np.allclose(gamma, want) and np.allclose(between, pairs) and np.allclose(first, want[begin].sum(axis=0))


def test_words_and_their_hashes():
    text = "été, l'aïeul — «oui» don’t x1y\nmañana ªº".lower()
    w = langid.words_of(np.frombuffer(text.encode() + b"\n", dtype=np.uint8))
    raw = text.encode()
    assert [raw[a:b].decode() for a, b in zip(w.first, w.end)] == ["été", "l", "aïeul", "oui", "don", "t", "x", "y", "mañana", "ªº"]
    again = langid.words_of(np.frombuffer(b"zz oui mes x \n", dtype=np.uint8))
    assert again.hash[1] == w.hash[3] and again.hash[3] == w.hash[6] and len({*w.hash.tolist()}) == 10
    assert [f[1] for f in again.affixes] == [f[3] for f in w.affixes]


@pytest.fixture(scope="module")
def field(spark):
    return langid.fit(table(spark, SF, "documents"))


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    out = langid.op13_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.99
    assert all(0 <= r.score <= 1 for r in out)


def test_nothing_is_learnt_from_held_out_documents(spark, field):
    docs = table(spark, SF, "documents")
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit("xx")).otherwise(F.col("lang")))
    other = langid.fit(wrong.repartition(7))
    assert other.langs == field.langs and np.array_equal(other.weights, field.weights) and np.array_equal(other.steps, field.steps)


def test_switched_texts(spark, field):
    """Words of lines made of runs of held-out texts in two languages are labelled as the run they come from."""
    docs = [r for r in table(spark, SF, "documents").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and not any(c in r.text for c in "#|=<&$%") and len(r.text) > 400 and r.text != r.text.upper()]
    rng, made, truth = random.Random(4), [], {}
    for k in range(120):
        parts, at = [], 0
        for d in rng.sample(docs, 3):
            words = d.text.split()
            i = rng.randrange(max(1, len(words) - 12))
            run = " ".join(words[i : i + 12])
            truth.setdefault(k, []).append((at, at + len(run), d.lang))
            parts.append(run)
            at += len(run) + 1
        made.append((k, " ".join(parts)))
    right = total = 0
    for r in langid.spans(spark.createDataFrame(made, "doc_id long, text string"), field).collect():
        text = made[r.doc_id][1]
        for s in r.spans:
            assert text[s.start : s.end].strip() == text[s.start : s.end] and 0 <= s.score <= 1
            for a, b, lang in truth[r.doc_id]:
                both = max(0, min(b, s.end) - max(a, s.start))
                right, total = right + both * (lang == s.lang), total + both
    assert right / total > 0.9
    assert len({tuple(p) for p in np.sign(field.steps).tolist()}) > 1  # staying is likelier than switching
    assert (np.diag(field.steps) > field.steps - np.eye(len(field.langs)) * 99).all()


def test_awkward_rows(spark, awkward, field):
    got = [tuple(r) for r in langid.predict(awkward, field).collect()]
    assert len(got) == awkward.count()
    by = {(r[0], r[1]) for r in got}
    assert {(None, "und"), (2, "und"), (3, "und"), (4, "und"), (1, "en")} <= by
    assert all((p == "und") == (n == 0) for _, p, _, n, _ in got) and all(s == 0 for _, p, s, *_ in got if p == "und")
    assert {r.doc_id: r.spans for r in langid.spans(awkward, field).collect()}[3] == []
    texts = [(0, "12 34 … — !"), (1, "你好 世界"), (2, "É"), (3, "ª"), (4, "x" * 300_000), (5, "the of and " * 60_000), (6, "İSTANBUL the of and İS")]
    out = {r.doc_id: r for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), field).collect()}
    assert out[0].lang_pred == "und" and all(out[k].lang_pred in field.langs for k in range(1, 7)) and out[5].lang_pred == "en"
    s = {r.doc_id: r.spans for r in langid.spans(spark.createDataFrame(texts, "doc_id long, text string"), field).collect()}
    assert s[6][0].start == 0 and s[6][-1].end == len(texts[6][1])


def test_fits_from_little(spark):
    """No table, no language, one language, and documents without an id: a field that answers."""
    schema = "doc_id long, text string, lang string"
    none = langid.fit(spark.createDataFrame([], schema))
    rows = [(0, "the end", "en"), (None, "la fin", "fr"), (2, None, "de"), (3, "", "de"), (5, "no language", None)]
    one = langid.fit(spark.createDataFrame(rows, schema))
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    assert none.langs == [] and one.langs == ["en"]
    assert [r[1] for r in langid.predict(df, none).orderBy("doc_id").collect()] == ["und", "und"]
    assert [r[1] for r in langid.predict(df, one).orderBy("doc_id").collect()] == ["en", "und"]
    assert langid.predict(df.limit(0), one).collect() == []
