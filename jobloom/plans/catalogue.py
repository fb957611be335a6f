"""Registered queries: each operator of the inventory over the posting model, beside its SQL."""

from __future__ import annotations

from jobloom.plans import dictionaries, fields, lifecycle, links, matching, pages, pay, records, report, search, sources, stats, streams, text, texts  # noqa: F401
from jobloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
