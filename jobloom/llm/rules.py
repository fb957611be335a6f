"""Quality rules with cutoffs certified on labelled holdouts; built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import cut, table, written

#: ASCII white space inside a character class.
SPACE = r" \t\n\x0B\f\r"
#: Words in a window.
WINDOW = 5
#: A stratum's good documents may be rejected falsely at this rate over all rules, with this probability of being wrong anywhere.
ALPHA, DELTA = 0.02, 0.05
#: A good document rejected weighs as much as so many bad ones when certified cutoffs are chosen from.
PRICE = 5
# Rule -> candidate cutoffs on its metric, from strict to lax; a document above the cutoff is rejected.
CUTOFFS = {
    "symbols": [0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3],
    "dup_lines": [0.1, 0.2, 0.3, 0.4, 0.5, 0.7],
    "repeats": [0.02, 0.05, 0.1, 0.15, 0.2],
    "capitals": [0.1, 0.2, 0.3, 0.5, 0.7],
    "few_words": [0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
}


def bound(array: Column, f) -> Column:
    """f over `array` evaluated once: a lambda's variable stands for it."""
    return F.get(F.transform(F.array(array), f), F.lit(0))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_distinct)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("words"),
        (F.length(text) - F.regexp_count(text, F.lit(f"[{SPACE}]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
    )
    n = F.size("words")
    hashes = F.slice(F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])), F.lit(1), F.greatest(n - WINDOW + 1, F.lit(0)))
    second = first.select("doc_id", "stratum", "word_chars", "n_symbols", "n_capitals", n.cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), hashes.alias("hashes"))

    def places(s: Column) -> Column:
        """Where windows begin that aren't alone in their text, from (hash, place) in order."""
        return F.array_sort(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x.i.alias("i"), (F.coalesce(x.h == F.get(s, k - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(s, k + 1).h, F.lit(False))).alias("twice"))), lambda x: x.twice), lambda x: x.i))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(p, start, lambda a, x: F.struct((a.n + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a.n)

    pairs = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), F.lit(0).cast("long")).otherwise(covered(bound(pairs, places)))
    return second.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"), "n_lines", "n_capitals", "n_distinct")


def metrics() -> dict[str, Column]:
    """Each rule's metric, from 0 (fine) upwards."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
        "few_words": F.lit(1) - share("n_distinct", "n_words"),
    }


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X binomial (n, p): its terms summed in logarithms, so that nothing underflows."""
    start = n * math.log1p(-p)
    odds = math.log(p) - math.log1p(-p)

    def add(acc: Column, i: Column) -> Column:
        term = acc.term + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (F.greatest(acc.total, term) + F.log1p(F.exp(-F.abs(acc.total - term)))).alias("total"))

    return F.aggregate(F.slice(F.sequence(F.lit(0).cast("long"), k), F.lit(2), F.greatest(k.cast("int"), F.lit(1))), F.struct(start.alias("term"), start.alias("total")), add, lambda acc: acc.total)


def certified_cutoffs(held: DataFrame, alpha: float = ALPHA, delta: float = DELTA, cutoffs: dict[str, list[float]] = CUTOFFS) -> DataFrame:
    """(stratum, rule, cutoff) chosen from a labelled holdout: (stratum, metrics..., good boolean).

    A cutoff that rejects k of a stratum's n good documents is certified if P(Binomial(n, a) <= k) is at most
    delta over the number of tests (strata * candidates, Bonferroni), a = alpha / rules: then, with probability 1 - delta,
    every certified cutoff's false rejection rate is below a, and a stratum's below alpha. Among them that one is chosen which
    rejects most bad documents less PRICE times the good ones, the laxest of equals; none if that isn't above 0.
    """
    a = alpha / len(cutoffs)
    tests = [(rule, c) for rule, cs in cutoffs.items() for c in cs]
    above = lambda good, rule, c: F.count_if((F.col("good") == good) & (F.col(rule) > c))
    counts = held.groupBy("stratum").agg(F.count_if("good").alias("n"), F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), above(True, r, c).alias("k"), above(False, r, c).alias("bad")) for r, c in tests]).alias("tests"))
    m = counts.agg(F.greatest(F.count("*"), F.lit(1)).alias("strata"))
    rows = counts.crossJoin(F.broadcast(m)).select("stratum", "n", "strata", F.inline("tests"))
    tail = F.when(F.col("k") < F.col("n") * a, log_binomial_cdf(F.col("k"), F.col("n"), a))
    rows = rows.where(tail <= F.log(F.lit(delta) / (F.col("strata") * len(tests))))
    gain = F.col("bad") - PRICE * F.col("k")
    return rows.where(gain > 0).groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(gain.alias("gain"), F.col("cutoff").alias("c"))).alias("cutoff"))


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, broken), a row per row of `docs`.

    kept is false for texts that fail the base (under ten words, or over a fifth of them in repeated windows) or break
    a certified rule of their stratum; broken lists those rules. The bound of `certified_cutoffs` holds for the rules together;
    the base is given, and rejects what it rejects of good documents besides. Every stratum has cutoffs of its own. Holdout: all documents with a label (`labels`: doc_id,
    quality; the least of several counts, null ones don't). Null text counts as empty, null strata as ''. Repeated rows and null ids
    are answered row by row. Without labels only the base holds. Windows are compared by 64-bit hashes
    within a text. Other columns are ignored; an empty table gives an empty result.
    """
    rows = cut(measured(docs, id_col, text_col, stratum_col))
    rows = rows.withColumns(metrics())
    truth = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = rows.join(truth, "doc_id").select("stratum", *CUTOFFS, (F.col("quality") >= 1).alias("good"))
    chosen = certified_cutoffs(held, alpha, delta)
    # A row for each stratum; written so that the planner knows its size, and broadcasts it only if it is small.
    chosen = written(chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")))
    rows = rows.join(chosen, "stratum", "left")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(F.col(r) > F.try_element_at("cutoffs", F.lit(r)), F.lit(r)) for r in CUTOFFS]))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.size(broken) == 0)).alias("kept"), F.array_join(broken, ",").alias("broken"))


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_METRIC_SQL = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "few_words": "1 - n_distinct / greatest(n_words, 1)",
}
_TESTS = ", ".join(f"('{r}', CAST({c} AS DOUBLE))" for r, cs in CUTOFFS.items() for c in cs)
_A = ALPHA / len(CUTOFFS)
OP2_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, k, words[k:k + 4] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS k FROM w WHERE len(words) >= 5)),
t AS (SELECT doc_id, k FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
r AS (SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM t) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_capitals,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_distinct(words)) AS BIGINT) AS n_distinct, coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
v AS (SELECT *, {", ".join(f"{e} AS {k}" for k, e in _METRIC_SQL.items())} FROM m),
h AS (SELECT v.*, q.quality >= 1 AS good FROM v JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) q USING (doc_id)),
x AS (
  SELECT stratum, rule, cutoff, CAST(sum(CAST(good AS INT)) AS BIGINT) AS n, CAST(sum(CAST(good AND metric > cutoff AS INT)) AS BIGINT) AS k, CAST(sum(CAST(NOT good AND metric > cutoff AS INT)) AS BIGINT) AS bad
  FROM (SELECT stratum, good, c.rule, c.cutoff, CASE c.rule {" ".join(f"WHEN '{k}' THEN {k}" for k in _METRIC_SQL)} END AS metric FROM h CROSS JOIN (VALUES {_TESTS}) c(rule, cutoff))
  GROUP BY ALL),
d AS (
  SELECT *, (SELECT sum(exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({_A}) + (n - i) * ln(1 - {_A}))) FROM (SELECT unnest(range(0, k + 1)) AS i)) AS cdf
  FROM x WHERE k < n * {_A}),
c AS (
  SELECT stratum, rule, arg_max(cutoff, {{'gain': bad - {PRICE} * k, 'c': cutoff}}) AS cutoff
  FROM d WHERE cdf <= {DELTA} / ((SELECT count(DISTINCT stratum) FROM x) * (SELECT count(*) FROM (VALUES {_TESTS}))) AND bad > {PRICE} * k GROUP BY ALL),
b AS (SELECT v.doc_id, string_agg(c.rule, ',' ORDER BY list_position({list(CUTOFFS)}, c.rule)) AS broken FROM v JOIN c USING (stratum)
      WHERE CASE c.rule {" ".join(f"WHEN '{k}' THEN {k}" for k in _METRIC_SQL)} END > c.cutoff GROUP BY v.doc_id)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND b.doc_id IS NULL AS kept, coalesce(broken, '') AS broken
FROM v LEFT JOIN b ON v.doc_id = b.doc_id
"""
