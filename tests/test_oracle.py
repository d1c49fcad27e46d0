"""Every registered query against its SQL twin, on whole tables."""

import pytest

from paperfold.catalog import REGISTRY
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, folder, name):
    rows, _, error = compare(spark, con, name, folder)
    assert error is None, error
    assert rows > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
