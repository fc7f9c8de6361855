import pytest

from tests.test_state import duck, same  # noqa: F401
from tidemark.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_duckdb(spark, sf, duck, name):  # noqa: F811
    same(queries.queries()[name](spark, sf).toPandas(), duck.execute(oracles.oracle_sql()[name]).df())


def test_one_query_for_each_operator():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
