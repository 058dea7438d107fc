"""Every registered query on the smallest tables, against its SQL where it has one."""

from __future__ import annotations

import pytest

from tests.conftest import TESTDATA
from tracewright import plans

SF = TESTDATA / "sf0.001"
SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, agree, name):
    df = plans.queries()[name](spark, str(SF))
    if name in SQL:
        agree(df, SQL[name], SF)
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.queries()) <= set(__spark_entry__.queries())
