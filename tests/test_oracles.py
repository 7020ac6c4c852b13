"""Every registered relational query against its SQL twin in DuckDB."""

import oracle
import pytest

from rankwell.plans import registry

SF = "/root/testdata/sf0.01"
#: Groups of the operator inventory and how many each has.
SURVEYED = {"src": 17, "snk": 7, "ing": 3, "chk": 13, "emb": 6, "rtv": 18, "jon": 16, "map": 5, "pol": 8, "flt": 18, "evl": 29, "sta": 14, "ann": 11, "agt": 12, "gen": 9, "str": 3, "nbk": 10}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_operator_has_a_query():
    ids = {f"{k}{n:02d}" for k, most in SURVEYED.items() for n in range(1, most + 1)}
    assert {n.split("_")[0] for n in registry.QUERIES} == ids


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    if name not in registry.ORACLE_SQL:
        assert registry.QUERIES[name](spark, SF).count() > 0
        return
    assert oracle.difference(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) is None
