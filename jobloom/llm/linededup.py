"""Line dedup over overlapping windows of three lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import private, table, written

#: Lines in a window.
WINDOW = 3
#: What is trimmed from a line before it is hashed.
SPACE = " \t\r\x0b\x0c"


def _cleaned(text: Column) -> Column:
    """The lines with something in them: (at: index among all lines, line: trimmed)."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(SPACE)).alias("line")))
    return F.filter(lines, lambda x: x.line != "")


def _window_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), F.transform(_cleaned(text), lambda x: F.struct(F.xxhash64(x.line).alias("a"), F.hash(x.line).alias("b"))).alias("h"))
    window = lambda k: F.struct(k.alias("k"), F.xxhash64(*[F.get("h", k + d).a for d in range(WINDOW)]).alias("w1"), F.hash(*[F.get("h", k + d).b for d in range(WINDOW)]).alias("w2"))
    spans = F.transform(F.sequence(F.lit(0), F.greatest(F.size("h") - WINDOW, F.lit(0))), window)
    spans = F.slice(spans, F.lit(1), F.greatest(F.size("h") - WINDOW + 1, F.lit(0)))
    return rows.select("id", "th", F.inline(spans))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, ks): for each text with any, the windows (index of first line) that also occur earlier.

    th is the text's hash; (id, th) names a text. Firsts are minima combined before the shuffle, so a window that a
    third of all rows hold costs a row per task; they are written, so that the join back to the occurrences deals both sides anew
    and can be split.
    """
    occ = _window_rows(docs, id_col, text_col)
    firsts = written(occ.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "k")).alias("first")).where("n > 1").select("w1", "w2", "first"))
    later = occ.join(firsts, ["w1", "w2"]).where(F.struct("id", "th", "k") > F.col("first"))
    return later.groupBy("id", "th").agg(F.collect_set("k").alias("ks"))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the text as it stays, and _lines, _removed, _windows (long).

    Windows are three consecutive lines, blank ones passed over, each trimmed of ASCII white space. Every window
    that stands earlier (smaller id, or same text at an earlier line) goes; covered lines are
    merged, removed once, and the rest joined again, blank lines kept. Null ids come first. Rows with the same id
    and text are one text: neither is later than the other. Same id but other text: ordered by the text's hash.
    Null text stays null with counts of zero; texts of fewer than three lines hold no window. Other columns pass
    through unchanged, whatever their names; only columns _lines, _removed and _windows give way. Windows are told apart by 96
    bits of hash. An empty table gives an empty result.
    """
    i, h, k, r = (private(docs, x) for x in ("id", "th", "ks", "r"))
    kept = repeated_windows(docs, id_col, text_col).select(F.col("id").alias(i), F.col("th").alias(h), F.col("ks").alias(k))
    keyed = docs.withColumns({h: F.xxhash64(F.col(f"`{text_col}`")), r: F.col(f"`{id_col}`")})
    joined = keyed.join(kept.hint("shuffle_hash"), keyed[r].eqNullSafe(kept[i]) & (keyed[h] == kept[h]), "left").drop(kept[h])

    @F.pandas_udf("text string, lines long, removed long")
    def applied(text: pd.Series, ks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_without(t, k) for t, k in zip(text, ks)], columns=["text", "lines", "removed"])

    # Not taken apart: a filter on the result would else run it twice.
    apply = applied.asNondeterministic()
    done = joined.withColumn(r, apply(F.col(f"`{text_col}`"), F.col(k)))
    counts = {"_lines": F.col(f"{r}.lines"), "_removed": F.col(f"{r}.removed"), "_windows": F.coalesce(F.size(k), F.lit(0)).cast("long")}
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col and c not in counts]
    return done.select(*others, F.col(f"{r}.text").alias(text_col), *[c.alias(name) for name, c in counts.items()])


def _without(text: str | None, ks) -> tuple[str | None, int, int]:
    """The text without the lines that windows `ks` cover; lines with something in them, and how many went."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip(SPACE)]
    if ks is None or not len(ks):
        return text, len(full), 0
    gone = {full[k + d] for k in ks for d in range(WINDOW)}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(full), len(gone)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_windows").alias("n_windows"), F.col("_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x, i: {'at': i, 'line': trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))}), lambda x: x.line <> '') AS ls,
         string_split(text, chr(10)) AS every
  FROM documents),
w AS (
  SELECT doc_id, k, ls[k].line AS a, ls[k + 1].line AS b, ls[k + 2].line AS c
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS k FROM l WHERE len(ls) >= 3)),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS n FROM w),
g AS (SELECT doc_id, list(k) AS ks, count(*) AS n_windows FROM r WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, list_distinct(flatten(list_transform(ks, lambda k: [k, k + 1, k + 2]))) AS gone, n_windows FROM g)
SELECT l.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_windows, 0) AS BIGINT) AS n_windows,
       CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN every ELSE
         list_filter(every, lambda x, i: NOT list_contains(list_transform(gone, lambda k: ls[k].at), i)) END, chr(10)), '')) AS kept_sha256
FROM l LEFT JOIN m USING (doc_id)
"""
