"""Every query of the core that SQL can express, against that SQL."""

import pytest
from oracle import differences

from seqloom.plans import all_queries, all_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, name):
    sqls = all_sql()
    if name in sqls:
        assert differences(spark, all_queries(), sqls, name, SF) == ""
    else:
        all_queries()[name](spark, SF).collect()


def test_sql_has_queries():
    assert set(all_sql()) <= set(all_queries())
