import os

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n[0] == "p" or not n[1].isdigit() or n[1] in "135"))
def test_agrees_with_sql(spark, con, name):
    assert differences(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert not set(entry.oracle_sql()) - set(entry.queries())
