"""Every registered query against its SQL."""

import pytest
from compare import check, connect
from conftest import DATA, TABLES

from colloquy.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(f"{DATA}/sf0.01", TABLES)


#: tokenizers are beyond SQL: tests/test_tokenizers.py holds this one against a loop
WITHOUT_SQL = {"fit_prompt_tokenizer"}


def test_every_other_query_has_sql():
    assert set(ORACLE) == set(QUERIES) - WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    check(QUERIES[name](spark, f"{DATA}/sf0.01"), con, ORACLE[name])
