"""Every registered query over the tables against its SQL."""

import pytest
from oracle import connect, same

from sonorum import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    same(catalog.queries()[name](spark, FOLDER).toPandas(), duck.execute(catalog.oracle_sql()[name]).df())


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r["deviation"] == 0 for r in rows)
