"""Every registered query of the reference's operators against its SQL."""

import pytest

from tarnfold.plans import registry
from tests import oracle


#: Held against plain Python in test_hostile.py: SQL has no similarity of common blocks.
NO_SQL = {"x25_closest_name"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, con):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in NO_SQL:
        assert df.count() > 0
        return
    assert name in registry.ORACLES
    oracle.same(con, df, registry.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
