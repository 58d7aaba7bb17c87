import os

import pytest

from heliograph.llm.queries import ORACLES, QUERIES
from tests.oracle import FOLDER, database, difference

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert difference(spark, database(), QUERIES[name], ORACLES[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
