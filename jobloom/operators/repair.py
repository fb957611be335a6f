"""Derived columns made again: from raw records, or pay alone from what was kept of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import salary as S
from jobloom.functions.text import step
from jobloom.operators.normalize import normalize

PAY = ["salary_min", "salary_max", "currency", "period", "is_public", "parse_error", "parse_status"]
#: Columns of liveness, which making rows again doesn't touch.
LIVENESS = ["status", "miss_count", "checked_on"]


def reparse(stored: DataFrame, raw: DataFrame, source: str | None = None, failed_only: bool = False, id_pattern: str | None = None, as_of: Column | None = None) -> DataFrame:
    """Rows of `normalize` for the stored postings (source, external_id, parse_status, LIVENESS) whose raw record (payload: a declared posting) is kept; liveness stays as it is."""
    wanted = stored.select("source", F.col("external_id").alias("own_id"), "parse_status", *LIVENESS)
    wanted = wanted.where(F.col("source") == source) if source else wanted
    wanted = wanted.where(F.col("parse_status").isin("PARTIAL", "FAILED")) if failed_only else wanted
    own = raw.select("source", F.col("external_id").alias("own_id"), F.col("payload").alias("posting"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = wanted.join(own, ["source", "own_id"]).drop("parse_status").withColumns({"page_url": F.get_json_object("posting", "$.url"), "salary_text": none("string"), "skills": none("array<string>"), "work_mode": none("string")})
    return normalize(rows, id_pattern, as_of=as_of)


def repair_salary(stored: DataFrame, usd_vnd: float = S.USD_VND) -> DataFrame:
    """(posting_id, outcome, old, new): stored postings without a raw record whose pay is read again from salary_raw.

    outcome is unreadable, same or changed; old and new are structs of PAY. A problem with pay is replaced in parse_error, others
    stay; FAILED rows stay failed.
    """
    rows = step(stored.where("raw_key is null and salary_raw is not null"), _s=S.salary_from_raw(F.col("salary_raw"), usd_vnd))
    rows = step(rows, _e=S.replace_salary_problem(F.col("parse_error"), S.salary_problem(F.col("_s.out_of_range"), F.col("salary_raw"))))
    status = F.when(F.col("parse_status") == "FAILED", F.col("parse_status")).when(F.col("_e").isNotNull(), "PARTIAL").otherwise("OK")
    made = {"salary_min": F.col("_s.min"), "salary_max": F.col("_s.max"), "currency": F.col("_s.currency"), "period": F.col("_s.period"), "is_public": F.col("_s.is_public"), "parse_error": F.col("_e"), "parse_status": status}
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(v) for c, v in made.items()])
    outcome = F.when(F.col("_s").isNull(), "unreadable").when(same, "same").otherwise("changed")
    return rows.select("posting_id", outcome.alias("outcome"), F.struct(*PAY).alias("old"), F.struct(*[v.alias(c) for c, v in made.items()]).alias("new"))


def repair_counts(repaired: DataFrame) -> DataFrame:
    """(scanned, unreadable, changed, now_public, now_hidden)."""
    changed = F.col("outcome") == "changed"
    return repaired.agg(
        F.count("*").alias("scanned"), F.count_if(F.col("outcome") == "unreadable").alias("unreadable"), F.count_if(changed).alias("changed"),
        F.count_if(changed & ~F.col("old.is_public") & F.col("new.is_public")).alias("now_public"), F.count_if(changed & F.col("old.is_public") & ~F.col("new.is_public")).alias("now_hidden"),
    )
