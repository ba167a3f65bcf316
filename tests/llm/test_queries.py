"""Every query with SQL against its SQL; the registry as a whole."""

import pytest
from compare import check, connect
from conftest import DATA, TABLES

from colloquy.llm.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(f"{DATA}/sf0.01", TABLES)


def test_thirteen_operators():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    check(QUERIES[name](spark, f"{DATA}/sf0.01"), con, ORACLE[name])
