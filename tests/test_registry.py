"""Every registered query gives what its SQL gives."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, duck
from palimpsest.plans.staging import drop_work, staged
from workload import ALL_QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(ALL_QUERIES) <= set(queries()) and set(ALL_QUERIES) <= set(oracle_sql())


def test_work_tables_can_be_dropped(spark):
    kept = staged(spark.range(5), "some")
    assert kept.count() == 5 and drop_work(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ_FILE"):
        kept.count()


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", list(ALL_QUERIES))
def test_query(name, spark, con):
    got = queries()[name](spark, FOLDER).toPandas()
    assert compare(got, con.execute(oracle_sql()[name]).df()) == ""
