"""The registered queries that have SQL."""

import pytest

from lodestack.llm import registry

from .. import oracle
from ..conftest import SF


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, name):
    oracle.check(spark, oracle.connect(SF), SF, registry.QUERIES[name], registry.ORACLE[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
