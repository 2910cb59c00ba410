"""Every registered query of the listing engine against its SQL, on the smallest data."""

import pytest

from tests.oracle import same_rows
from tessera.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        same_rows(df, ORACLES[name], sf)
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert {r.tier for r in rows} <= {"pewny", "prawdopodobny", "mozliwy"} and rows
    assert set(e.oracle_sql()) <= set(e.queries())

