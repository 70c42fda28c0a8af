import os
import re

import pytest

from codeseam.plans import registry
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, oracle.DATA)
    sql = registry.oracle_sql().get(name)
    if sql:
        oracle.same(df, duck, sql)
    else:
        df.collect()


def test_name_filters_reach_the_scan(spark):
    plan = registry.queries()["hot_files"](spark, oracle.DATA)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


@pytest.mark.parametrize(("name", "limits"), [("vector_threshold", ["1"]), ("hybrid_find", ["60"])])
def test_inputs_have_no_row_cap(spark, name, limits):
    """One limit is left: the query vector's single row, the best 60 of the fused list."""
    plan = registry.queries()[name](spark, oracle.DATA)._jdf.queryExecution().analyzed().toString()
    assert re.findall(r"GlobalLimit (\d+)", plan) == limits
