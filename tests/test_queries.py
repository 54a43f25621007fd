"""Every core query against its SQL twin, or for rows, on the smallest tables."""

import pytest

from pagelens.plans import catalogue
from tests.oracle import oracle_rows, rows


#: Queries that find nothing in the smallest tables.
EMPTY = {"int_injection"}


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, testdata, name):
    df = catalogue.queries()[name](spark, testdata)
    cols, expected = oracle_rows(testdata, catalogue.oracle_sql()[name])
    assert sorted(df.columns) == cols
    assert rows(df) == expected


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_query_runs(spark, testdata, name):
    """Rows that stay the same from one run to the next; what they hold is tested on fixtures."""
    df = catalogue.queries()[name](spark, testdata)
    assert rows(df) == rows(df) and (rows(df) or name in EMPTY)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
