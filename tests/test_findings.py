"""Tables on which a query once differed from its SQL or did a step's work in one task."""

import duckdb
import pytest
from pyspark.sql import functions as F

from repolytics import catalog, catalog_graph
from repolytics.operators import code, coupling
from repolytics.plans import incremental
from tests.conftest import SF
from tests.test_queries import rows


def compared(spark, folder, name, **tables):
    """A query's rows and its SQL's over tables given as SELECTs."""
    own = duckdb.connect()
    for table, sql in tables.items():
        own.sql(f"copy ({sql}) to '{folder}/{table}.parquet' (format parquet)")
        own.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got, want = catalog.QUERIES[name](spark, str(folder)), own.sql(catalog.ORACLE_SQL[name])
    return rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall())


SHORT = "SELECT i::BIGINT AS event_id, (i % 4)::BIGINT AS user_id, ['view', 'error'][1 + i % 2] AS event_type, (i % 3) * 0.0006 AS value FROM range(24) r(i)"


def test_spans_that_took_no_time(spark, tmp_path):
    got, want = compared(spark, tmp_path, "otel_functions", events=SHORT)
    assert got == want and len(want) == 4


def test_profiles_with_spans_that_took_no_time(spark, tmp_path):
    got, want = compared(spark, tmp_path, "profile_loader", events=SHORT, nation="SELECT 1::BIGINT AS n_nationkey")
    assert got == want and len(want) == 5


def of_types(kind, value="(i % 3) * 0.5", user="(i % 4)::BIGINT"):
    return f"SELECT i::BIGINT AS event_id, {user} AS user_id, {kind} AS event_type, {value} AS value FROM range(400) r(i)"


PLAIN = "['view', 'error'][1 + i % 2]"
ODD_EVENTS = {
    "null values": of_types(PLAIN, "CASE WHEN i % 4 <> 2 AND i % 7 <> 0 THEN i * 0.5 END"),
    "marks of JSON": of_types("['a\"b', 'c\\d', 'e' || chr(10) || chr(1), 'error'][1 + i % 4]", user="(i // 4 % 4)::BIGINT"),
    "blank types": of_types("['', '  ', ' x ', NULL, 'error'][1 + i % 5]"),
    "wide types": of_types("repeat('x', (i % 12 // 3)::INTEGER) || repeat('事', 1500)", user="(i % 12)::BIGINT"),
    "no users": of_types(PLAIN, user="CASE WHEN i % 4 > 0 THEN i % 4 - 2 END"),
}


@pytest.mark.parametrize("kind", sorted(ODD_EVENTS))
@pytest.mark.parametrize("name", ["profile_loader", "otel_functions"])
def test_profiles_of_odd_events(spark, tmp_path, name, kind):
    got, want = compared(spark, tmp_path, name, events=ODD_EVENTS[kind], nation="SELECT 1::BIGINT AS n_nationkey")
    assert got == want and len(want) > 1


def test_profiles_of_values_that_are_no_times(spark, tmp_path):
    events = of_types(PLAIN, "['nan'::DOUBLE, 'inf', '-inf', 1e300, 8e15, -3.5][1 + i % 6]", "(i // 6 % 4)::BIGINT")
    got, want = compared(spark, tmp_path, "profile_loader", events=events, nation="SELECT 1::BIGINT AS n_nationkey")
    assert got == want and len(want) == 5


def test_spans_of_centuries(spark, tmp_path):
    got, want = compared(spark, tmp_path, "otel_functions", events="SELECT i::BIGINT AS event_id, i::BIGINT AS user_id, 'view' AS event_type, 8e12 AS value FROM range(3) r(i)")
    assert got == want and len(want) == 3


def test_profiles_of_repeated_files(spark, tmp_path):
    nation = "SELECT CASE WHEN i > 4 THEN i // 2 END AS n_nationkey FROM range(10) r(i)"
    got, want = compared(spark, tmp_path, "profile_loader", events=of_types(PLAIN, user="CASE WHEN i % 4 > 0 THEN i % 4 END"), nation=nation)
    assert got == want and len(want) == 14


def test_costly_rows_are_dealt_and_read_once(spark, tmp_path):
    duckdb.sql(f"copy (SELECT i::BIGINT AS p_partkey, (i % 50)::INTEGER AS p_size FROM range(2000) r(i)) to '{tmp_path}/part.parquet' (format parquet)")
    for name in ("workflow_findings_first", "workflow_findings", "workflow_gates", "workflow_report"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "InMemoryTableScan" not in plan and "REPARTITION_BY_NUM" in plan


LINES = "SELECT i // 4 AS l_orderkey, (i % 90)::BIGINT AS l_partkey, (1 + i % 7)::INTEGER AS l_linenumber, (i % 50)::DOUBLE AS l_quantity FROM range(800) r(i)"
ORDERS = "SELECT i AS o_orderkey, 'a' || i % 3 AS o_orderpriority, TIMESTAMP '1997-01-01' + INTERVAL 1 HOUR * i AS o_orderdate FROM range(200) r(i)"


def test_manifests_are_dealt_and_parsed_once(spark, tmp_path):
    got, want = compared(spark, tmp_path, "manifest_counts", lineitem=LINES)
    assert got == want and len(want) == 200
    plan = catalog.QUERIES["manifest_counts"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 3 and "REPARTITION_BY_NUM" in plan


def test_log_records_are_dealt(spark, tmp_path):
    got, want = compared(spark, tmp_path, "log_commits", lineitem=LINES, orders=ORDERS)
    assert got == want and len(want) == 200
    assert catalog.QUERIES["log_commits"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2


def tasks_dealt(spark, folder, name):
    return catalog.QUERIES[name](spark, str(folder))._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM")


def test_line_items_are_dealt_by_commit(spark, tmp_path):
    got, want = compared(spark, tmp_path, "orphans", lineitem=LINES, orders=ORDERS)
    assert got == want and len(want) == 90
    assert tasks_dealt(spark, tmp_path, "orphans") == 1


def test_files_of_packages_are_dealt(spark, tmp_path):
    got, want = compared(spark, tmp_path, "nearest_packages", part="SELECT i::BIGINT AS p_partkey, 'b' || i % 5 AS p_brand, 't' || i % 7 AS p_type, (i % 3)::INTEGER AS p_size FROM range(300) r(i)")
    assert got == want and len(want) == 300
    assert tasks_dealt(spark, tmp_path, "nearest_packages") > 0


def test_units_are_dealt_by_commit(spark):
    plan = catalog.QUERIES["ownership_units"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan


def test_pairs_are_dealt_and_take_the_time_of_the_first_path(spark, tmp_path):
    got, want = compared(spark, tmp_path, "cochange_pairs", lineitem=LINES, orders=ORDERS)
    assert got == want and len(want) > 0
    assert tasks_dealt(spark, tmp_path, "cochange_pairs") >= 3
    own = spark.sql("SELECT 'k' AS commit, 'f' || lpad(id, 2, '0') AS path, timestamp_seconds(id) AS at FROM range(12)")
    rows = coupling.pairs(own, 1, 0.0, block_paths=1).collect()
    assert len(rows) == 66 and all(r["first_shared"].second == r["last_shared"].second == int(r["a"][1:]) for r in rows)


def test_parts_of_the_history_are_dealt_before_they_are_grouped(spark):
    own = spark.sql("SELECT timestamp_seconds(id) AS at, 'f' || id % 5 AS path, 'a' AS author, 1L AS added, 1L AS deleted FROM range(40)")
    found = incremental.parts(own)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["path"], r["changes"], r["added"]) for r in found.collect()) == [(f"f{i}", 8, 8) for i in range(5)]


def test_branch_words_are_counted_without_lists_of_words(spark):
    odd = ["", None, "if", "IF if_ if1 _if If\tELSIF elif", "caſe case Kelse whenİf ifé éif", "if if if||if&&&for", "&&&&|||", "loop\r\nloop\x0bmatch\x00select while-whiles", "\U0001f600if\U0001f600 for"]
    own = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, text string").select("i", code.branch_count(F.col("text")).alias("n"))
    assert [r["n"] for r in own.orderBy("i").collect()] == [0, None, 1, 4, 4, 7, 3, 5, 2]
    for name in ("hotspots", "severity_counts"):
        assert "regexp_extract_all(text" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()


def test_lines_are_counted_with_and_without_a_last_line_end(spark):
    texts = ["", None, "\n", "a", "a\n", "a\n\n", "\n\na", " \t\r\nb\r\n\x0b", "é\n \n\u2028\n"]
    own = spark.createDataFrame([(str(i), "Python", x) for i, x in enumerate(texts)], "path string, language string, content string")
    got = code.line_counts(own).orderBy("path").collect()
    assert [(r["total_lines"], r["filled_lines"]) for r in got] == [(0, 0), (None, None), (1, 0), (1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (3, 2)]
    plan = catalog.QUERIES["hotspots"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") <= 2


def test_cells_of_pairs_are_dealt_once(spark):
    own = spark.sql("SELECT 'k' || id % 2 AS commit, 'f' || lpad(id, 2, '0') AS path, timestamp_seconds(id) AS at, 3L AS n FROM range(24)")
    left, right = coupling._grid(own, 5)
    assert left.sameSemantics(right)
    cells = [tuple(r) for r in left.select("commit", "low", "high", "block_a", "a").collect()]
    assert len(cells) == len(set(cells)) == 24 * 3 and {(r[3] in r[1:3]) for r in cells} == {True}


def test_pairs_of_a_topology_search_no_cycles(spark):
    found = catalog_graph._topology(spark, SF)
    assert "cycles" not in found and {"coupling", "hidden", "risk"} <= found.keys()
