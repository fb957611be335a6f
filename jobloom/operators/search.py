"""Search over postings: filters, orders, pages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import match_key
from jobloom.sources.model import ALIVE

PAGE = 20
#: Columns that lists, single postings and probes read; nothing else reaches the scan.
LIST_COLUMNS = ["posting_id", "title", "company", "source_id", "status", "level", "is_public", "salary_min", "salary_max", "work_mode", "posted_at", "expires_on"]
DETAIL_COLUMNS = [*LIST_COLUMNS, "description", "years_min", "checked_on", "miss_count", "parse_status"]
PROBE_COLUMNS = ["posting_id", "status", "source_id", "external_id", "expires_on", "checked_on"]


@dataclass
class JobFilters:
    """What a request asks for; empty or null asks for nothing."""

    q: str = ""
    province: str = ""
    level: str = ""
    source_id: int | None = None
    salary_only: bool = False
    salary_from: int | None = None
    posted_within: int | None = None
    include_dead: bool = False
    extra: dict = field(default_factory=dict)

    @staticmethod
    def parse(params: dict[str, str | list[str]]) -> JobFilters:
        """From request parameters; junk falls back to what is asked by default."""
        one = lambda k: (v[0] if isinstance(v := params.get(k, ""), list) and v else v if isinstance(v, str) else "").strip()
        number = lambda k: int(float(one(k))) if one(k).replace(".", "", 1).isdigit() else None
        flag = lambda k: one(k).lower() in ("1", "true", "on", "yes")
        return JobFilters(one("q"), one("province"), one("level"), number("source"), flag("salary"), number("from"), number("days"), flag("dead"))


def where(f: JobFilters, as_of: Column | None = None) -> Column:
    """One conjunction; simple comparisons reach the scan."""
    out = F.lit(True) if f.include_dead else F.col("status").isin(ALIVE)
    if f.q:
        out &= F.lower("title").contains(f.q.lower()) | F.lower("description").contains(f.q.lower()) | F.lower("company").contains(f.q.lower()) | match_key(F.col("title")).contains(match_key(F.lit(f.q)))
    if f.province:
        out &= F.col("province") == f.province
    if f.level:
        out &= F.col("level") == f.level
    if f.source_id is not None:
        out &= F.col("source_id") == f.source_id
    if f.salary_only:
        out &= F.col("is_public")
    if f.salary_from is not None:
        out &= (F.col("salary_min") >= f.salary_from) | (F.col("salary_max") >= f.salary_from)
    if f.posted_within is not None and as_of is not None:
        out &= F.col("posted_at") >= as_of - F.expr(f"interval {f.posted_within} days")
    return out


def order(kind: str, back: bool = False) -> list[Column]:
    """Newest, best paid or soonest over, nulls last; then newest, then by id. `back`: the same from the end."""
    first = {"salary": [F.asc_nulls_first("salary_max") if back else F.desc_nulls_last("salary_max")], "deadline": [F.desc_nulls_first("expires_on") if back else F.asc_nulls_last("expires_on")]}.get(kind, [])
    return [*first, *([F.asc("posted_at"), F.desc("posting_id")] if back else [F.desc("posted_at"), F.asc("posting_id")])]


def page(rows: DataFrame, number: int, kind: str = "newest", size: int = PAGE) -> DataFrame:
    return rows.orderBy(*order(kind)).offset((max(number, 1) - 1) * size).limit(size)


def page_start(number: int | None, total: int, size: int) -> int:
    """How many rows stand before a page; one beyond the last page, or None, is the last."""
    last = max(1, -(-total // size))
    return size * ((last if number is None else min(max(number, 1), last)) - 1)


def cut(rows: DataFrame, total: int, start: int, size: int, ahead: list[Column], back: list[Column]) -> DataFrame:
    """`size` rows from `start` on of `total` rows in the order `ahead`, in which no two are equal. In the second half they are taken from the end (`back`: the order from there), so that the last page keeps no more than a page of rows."""
    if 2 * start <= total:
        return rows.orderBy(*ahead).offset(start).limit(size)
    return rows.orderBy(*back).limit(total - start).orderBy(*ahead).limit(size)


def find(rows: DataFrame, f: JobFilters, number: int | None, kind: str = "newest", size: int = PAGE, as_of: Column | None = None) -> tuple[int, DataFrame]:
    """(how many fit, a page of them); a page beyond the last one, or None, is the last."""
    fit = rows.where(where(f, as_of))
    total = fit.count()
    return total, cut(fit, total, page_start(number, total, size), size, order(kind), order(kind, back=True))


def recheck_due(rows: DataFrame, as_of: Column) -> DataFrame:
    """Alive postings to look at again: near their end, missed, never checked or not for a week."""
    due = (F.col("expires_on") <= F.date_add(as_of, 3)) | (F.col("miss_count") >= 1) | F.col("checked_on").isNull() | (F.col("checked_on") < F.date_sub(as_of, 7))
    return rows.where(F.col("status").isin(ALIVE) & due)
