"""Every registered query of the library against its SQL, and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from jobloom.plans import catalogue
from tests.oracle import same

NAMES = sorted(catalogue.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    same(catalogue.queries()[name](spark, sf), catalogue.oracle_sql()[name], sf)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
