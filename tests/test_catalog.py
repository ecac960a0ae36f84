"""Every plant query equals its SQL on the smallest tables."""

import functools

import pytest

from plantmill.jobs import catalog
from tests.conftest import same_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def one_skeleton():
    """The queries on canes share one skeleton here, which each of them builds for itself elsewhere."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(catalog, "grown", functools.cache(catalog.grown))
        yield


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = df.columns
    same_rows(duck.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({catalog.ORACLES[name]})").fetchall(), [tuple(r) for r in df.collect()])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
