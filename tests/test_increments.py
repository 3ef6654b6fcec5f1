"""Stored partial sums against runs over everything."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from repolytics.catalog import QUERIES
from repolytics.operators import churn, ownership
from repolytics.plans import adapters, incremental
from tests.conftest import SF

NOW = datetime(2026, 10, 6, 12)
FACTS = "commit string, at timestamp, author string, path string, added long, deleted long"


def history(r, names):
    rows = []
    for name in names:
        at, who = NOW - timedelta(hours=r.randint(0, 9000)), r.choice(["ann", "bob", "cyd"])
        rows += [(name, at, who, p, None if p == "bin" else r.randint(0, 30), None if p == "bin" else r.randint(0, 9)) for p in r.sample(["a", "b", "c/d", "bin"], r.randint(1, 4))]
    return rows


def same(store, spark, rows, window=None):
    full = spark.createDataFrame(rows, FACTS)
    inside = full if window is None else full.filter(F.to_date("at") >= F.date_sub(F.to_date(F.lit(NOW)), window))
    assert sorted(map(tuple, store.churn("r", NOW, window).collect())) == sorted(map(tuple, churn.churn_by_path(inside).collect()))
    assert store.concentration("r", NOW, window).collect() == churn.concentration(churn.churn_by_path(inside)).collect()
    names = ["unit", "author", "commits", "weighted_share", "share", "last_commit", "rank"]
    assert sorted(map(tuple, store.owners("r", NOW).select(*names).collect())) == sorted(map(tuple, ownership.owners(full, "path", NOW).select(*names).collect()))


def test_increments_equal_a_run_over_everything(spark, tmp_path):
    r = random.Random(4)
    store = incremental.Store(spark, f"file://{tmp_path}/store")
    assert store.churn("r", NOW).count() == 0 and store.commits("r") == 0
    rows = []
    for step in range(4):
        new = history(r, [f"{step}-{i}" for i in range(20)])
        again = [x for x in rows if x[0].endswith("-3")]
        store.append(spark.createDataFrame(new + again, FACTS).repartition(2), "r")
        store.append(spark.createDataFrame(history(r, ["other"]), FACTS), "s")
        rows += new
        same(store, spark, rows)
        same(store, spark, rows, window=90)
    assert store.commits("r") == 80 and store.commits("s") == 1
    store.compacted("r")
    same(store, spark, rows, window=200)
    assert store.commits("r") == 80 and store.commits("s") == 1


def test_an_append_reads_the_names_of_one_root_alone(spark, tmp_path):
    store = incremental.Store(spark, f"file://{tmp_path}/store")
    for root in ("r", "s"):
        store.append(spark.createDataFrame(history(random.Random(1), ["x", "y"]), FACTS), root)
    plan = store._rows("seen", "r").select("commit")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(root" in plan and "ReadSchema: struct<kind:string,commit:string>" in plan


def test_queries_equal_the_operators_over_everything(spark):
    full = adapters.commit_files(spark, SF)
    inside = full.filter(F.to_date("at") >= F.date_sub(F.to_date(F.lit(adapters.NOW).cast("timestamp")), 400))
    assert sorted(map(tuple, QUERIES["incremental_churn"](spark, SF).collect())) == sorted(map(tuple, churn.churn_by_path(inside).collect()))
    names = ["unit", "author", "commits", "weighted_share", "rank"]
    assert sorted(map(tuple, QUERIES["incremental_owners"](spark, SF).select(*names).collect())) == sorted(map(tuple, ownership.owners(full, "path", adapters.NOW).select(*names).collect()))
