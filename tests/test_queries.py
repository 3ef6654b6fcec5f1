"""Every query against its SQL oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

from repolytics import catalog
from tests.conftest import SF


@pytest.fixture(scope="module")
def oracle():
    own = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        own.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return own


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    got = catalog.QUERIES[name](spark, SF)
    want = oracle.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["ownership_by_path", "cochange_pairs", "history_trend"])
def test_results_do_not_depend_on_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(repr, catalog.QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
