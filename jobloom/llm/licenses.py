"""License scans over a positional index of templates, entered by their rarest words."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import as_bytes, small_batches, table
from jobloom.llm.license_texts import FULL_TEXTS, SPDX

# Phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Fixed values: (label, notice as usually worded, phrases that must stand in it).
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["gnu general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "licensed under the bsd license", ["bsd license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]
#: Share of a template's words that must stand at their relative places.
LEAST = 0.6

_TO_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; words are runs of ASCII letters and digits and of all other characters beyond ASCII."""
    return (text or b"").translate(_TO_SPACE).split()


def in_words(text: str) -> str:
    return b" ".join(words_of(text.encode())).decode()


#: Notices, whole texts and SPDX lines, in words.
TEMPLATES = [
    *NOTICES,
    *((label, in_words(text), must) for label, text, must in FULL_TEXTS),
    *((label, line, [line]) for name, label in SPDX.items() for line in [in_words(f"SPDX-License-Identifier: {name}")]),
]


class LicenseIndex:
    """Positional postings of the templates' rarest words, by the words' inverse document frequencies.

    A file enters a template by the template's entry word, the rarest of its mandatory phrases: the cost of a file grows with the
    templates whose entry word it holds, not with the templates that there are.
    """

    def __init__(self, templates: list[tuple[str, str, list[str]]], df: dict[bytes, int] | None = None, n_docs: int = 0):
        self.templates = [(label, text.encode().split(), [p.encode().split() for p in must]) for label, text, must in templates]
        self.vocabulary = frozenset(w for _, words, must in self.templates for part in (words, *must) for w in part)
        self.idf = {w: math.log((n_docs + 1) / ((df or {}).get(w, 0) + 1)) for w in self.vocabulary}
        rarest = lambda w: (-self.idf[w], w)
        #: Entry word -> its templates.
        self.entries: dict[bytes, list[int]] = defaultdict(list)
        #: A template's rarest (word, place)s, and how many of them stand wherever LEAST of its words do.
        self.postings: list[tuple[list[tuple[bytes, int]], int]] = []
        for t, (_, words, must) in enumerate(self.templates):
            self.entries[min((w for p in must or [words] for w in p), key=rarest)].append(t)
            needed = next(c for c in range(len(words) + 1) if c >= LEAST * len(words) or c / len(words) >= LEAST)
            agree = min(needed, max(2, needed // 2))
            places = sorted(range(len(words)), key=lambda k: (*rarest(words[k]), k))[: len(words) - needed + agree]
            self.postings.append(([(words[k], k) for k in places], agree))
        self.entry_words = frozenset(self.entries)

    def entered(self, there: set[bytes]) -> list[int]:
        """The templates whose entry word is among a file's words."""
        return [t for w in self.entry_words.intersection(there) for t in self.entries[w]]

    def scan(self, words: list[bytes], there: set[bytes]) -> dict[str, float]:
        """label -> share of the best template's words found at their relative places, mandatory phrases verified."""
        wanted: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t in self.entered(there):
            for w, place in self.postings[t][0]:
                if w in there:
                    wanted[w].append((t, place))
        hits: Counter[tuple[int, int]] = Counter()
        for at, w in enumerate(words if wanted else ()):
            if w in wanted:
                hits.update([(t, at - place) for t, place in wanted[w]])
        out: dict[str, float] = {}
        for (t, start), n in hits.items():
            label, template, must = self.templates[t]
            if n < self.postings[t][1]:
                continue
            got = sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(template)) / len(template)
            if got >= max(LEAST, out.get(label, 0)):
                window = words[max(0, start - 2) : start + len(template) + 2]
                if all(any(window[k : k + len(p)] == p for k in range(len(window) - len(p) + 1)) for p in must):
                    out[label] = got
        return out


def base_places(words: list[bytes], there: set[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(place, label) wherever a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases:
        if all(w in there for w in phrase):
            at = -1
            try:
                while True:
                    at = words.index(phrase[0], at + 1)
                    if words[at : at + len(phrase)] == phrase:
                        out.append((at, label))
            except ValueError:
                pass
    return out


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many of all texts each word of the templates stands, and how many texts there are."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0
        for batch in small_batches(batches):
            for text in as_bytes(batch.column(0)):
                counts.update(vocabulary.intersection(words_of(text)))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([*counts, b""], pa.binary()), pa.array([*counts.values(), n], pa.int64())], ["word", "n"])

    found = {bytes(r.word): r.n for r in docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(of, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop(b"", 0)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, list[str]]] = TEMPLATES, base: dict[str, str] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of `docs`.

    Base phrases are counted at all places; first_word and last_word are their smallest and largest start, null
    without any. Templates: a file's words enter those whose rarest mandatory word (by IDF over
    all documents) it holds; the postings of their rarest words, as many as none can stand without, that agree on where the template
    would begin give candidates; one stands if LEAST of its words are at their places and its mandatory phrases in or two words around it. score is the best share, 0.5 for base phrases
    alone, 0 for nothing. Null and empty texts have no words, labels of '' and score 0. Repeated rows and null ids are
    answered row by row; other columns are ignored; an empty table gives an empty result.
    """
    df, n_docs = document_frequencies(docs, text_col, LicenseIndex(templates).vocabulary)
    phrases = [(p.encode().split(), label) for p, label in base.items()]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenseIndex(templates, df, n_docs)
        for batch in small_batches(batches):
            out = []
            for text in as_bytes(batch.column(1)):
                words = words_of(text)
                there = set(words)
                places = base_places(words, there, phrases)
                found = index.scan(words, there)
                labels = {x for _, x in places}
                out.append((len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted(labels)), ",".join(sorted(labels | found.keys())), max(found.values(), default=0.5 if places else 0.0)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
