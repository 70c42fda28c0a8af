import os

import pytest

from codeseam.llm import queries
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, oracle.DATA)
    sql = queries.oracle_sql().get(name)
    if sql:
        oracle.same(df, oracle.connect(), sql)
    else:
        df.collect()
