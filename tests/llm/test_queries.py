"""Every query of the subpackage that has SQL, against it; the contracts' columns."""

import pytest

from ashlar.llm.queries import ORACLES, QUERIES

from .oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
