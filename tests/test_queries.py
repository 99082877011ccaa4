"""Every registered retail query against its SQL, on the smallest tables."""

import pytest

from support import DATA, same_rows
from ledgerloom.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    if name in SQL:
        assert same_rows(df, *oracle(SQL[name]))
    else:
        assert df.count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
