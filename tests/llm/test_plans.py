"""Every query of the training-data operators that SQL can express."""

import pytest
from oracle import differences

from seqloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    if name in oracle_sql():
        assert differences(spark, queries(), oracle_sql(), name, SF) == ""
    else:
        queries()[name](spark, SF).collect()
