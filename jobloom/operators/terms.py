"""Dictionaries as tables: many terms against many texts by an equi-join on n-grams of words, whatever the number of terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Terms that take no more bytes than this, as reckoned from their number and length, are sent to all tasks; more are shuffled.
BROADCAST_BYTES, BYTES_A_TERM = 128 << 20, 64


def _shapes(terms: DataFrame, whole: bool) -> tuple[list[tuple[int, int]], bool]:
    """(Distinct (words, letters of the last word) of the terms, whether these are few enough to be sent to all tasks); letters are 0 where whole words count. A line a shape, whatever the number of terms."""
    words = F.split("_key", " ")
    last = F.lit(0) if whole else F.length(F.element_at(words, -1))
    found = terms.groupBy(F.size(words).alias("k"), last.alias("letters")).agg((F.count("*") * BYTES_A_TERM + 2 * F.sum(F.octet_length("_key"))).alias("bytes")).collect()
    return sorted((r.k, r.letters) for r in found), sum(r.bytes for r in found) <= BROADCAST_BYTES


def _runs(key: Column, k: int) -> Column:
    """Distinct runs of k words of a match key, in order of their bytes. The pattern takes no letters, so that runs overlap."""
    rest = rf"(?: [^ ]+){{{k - 1}}}" if k > 1 else ""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(key, F.lit(rf"(?<![^ ])(?=([^ ]+{rest}))"), F.lit(1))))


def _heads(terms: DataFrame) -> DataFrame:
    """(_head, _letters): all of a term but its last word's letters behind the first, and how many letters of that word the terms have that begin so; a row a head."""
    last = F.length(F.substring_index("_key", " ", -1))
    return terms.groupBy(F.left("_key", F.length("_key") - last + 1).alias("_head")).agg(F.collect_set(last).alias("_letters"))


def _grams(texts: DataFrame, id_cols: list[str], shapes: list[tuple[int, int]], heads: DataFrame) -> DataFrame:
    """(id_cols..., _key): every run of words in the shape of a term, once a text: all but the last whole, of the last as many letters as terms with its head have.

    Runs that begin alike stand side by side, so that a beginning is given by the first of them only.
    """
    parts = []
    for k in sorted({k for k, _ in shapes}):
        if (k, 0) in shapes:
            parts.append(texts.select(*id_cols, F.explode(_runs(F.col("_text"), k)).alias("_key")))
            continue
        runs = texts.select(*id_cols, _runs(F.col("_text"), k).alias("_runs"))
        each = runs.select(*id_cols, F.inline(F.arrays_zip(F.col("_runs").alias("_run"), F.concat(F.array(F.lit("")), F.slice("_runs", 1, F.greatest(F.size("_runs") - 1, F.lit(0)))).alias("_before"))))
        each = each.withColumn("_kept", F.length("_run") - F.length(F.substring_index("_run", " ", -1))).withColumn("_head", F.left("_run", F.col("_kept") + 1))
        begun = each.join(heads, "_head").select(*id_cols, "_run", "_before", "_kept", F.explode("_letters").alias("_n")).where(F.col("_kept") + F.col("_n") <= F.length("_run"))
        parts.append(begun.select(*id_cols, "_before", F.left("_run", F.col("_kept") + F.col("_n")).alias("_key")).where(~F.col("_before").startswith(F.col("_key"))).drop("_before"))
    return reduce(DataFrame.unionAll, parts)


def find_terms(texts: DataFrame, terms: DataFrame, id_cols: list[str], key_col: str = "key", term_key_col: str = "term_key", whole: bool = False) -> DataFrame:
    """(id_cols..., columns of `terms`): each text with every term that stands in it, once.

    `key_col` and `term_key_col` are match keys (words between single blanks). A term stands where a text has its words in a row; the
    last one only begins a word, unless `whole`. A text is taken apart into its distinct runs of as many words as terms have,
    these into beginnings as long as terms' are, and joined on these: the plan and the work a text takes depend on the shapes,
    not on how many terms there are. A term that most texts hold is a join key like others. Empty and null keys and terms match nothing; rows and terms that repeat give repeated rows.
    """
    kept = terms.withColumn("_key", F.trim(F.col(term_key_col))).where("_key <> ''").persist()
    shapes, few = _shapes(kept, whole)
    if not shapes:
        return texts.select(*id_cols).limit(0).join(kept.drop("_key").limit(0), how="cross")
    sent = F.broadcast if few else lambda df: df
    grams = _grams(texts.select(*id_cols, F.trim(F.col(key_col)).alias("_text")).where("_text <> ''"), id_cols, shapes, sent(_heads(kept)))
    return grams.join(sent(kept), "_key").drop("_key")
