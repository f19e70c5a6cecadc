import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from onggi.llm import queries as q
from test_queries import SF, compare


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, name, q.queries(), q.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_runs(spark, name):
    assert q.queries()[name](spark, SF).count() > 0
