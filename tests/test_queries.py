"""Every registered query against its SQL in DuckDB, on the smallest test data."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, duck  # noqa: E402
from statedit.queries import load  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(load()[0]))
def test_query(spark, con, name):
    problem = compare(entry.queries()[name](spark, DATA), con, entry.oracle_sql()[name])
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["variable", "1998", "1997", "diff", "pdiff"]
