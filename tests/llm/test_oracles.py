"""Corpus queries against their SQL, over whole small tables."""

import pytest
from compare import same
from conftest import SMALL

from sieveline.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, small_con, name):
    same(QUERIES[name](spark, SMALL), small_con, ORACLE_SQL[name])


def test_ten_operators_and_the_pipeline_are_registered():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
    assert "pipeline" in QUERIES
