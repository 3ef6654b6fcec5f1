"""Queries over paths, names, orders and verdicts: functions whose results one column shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from repolytics.functions import numeric as num, predicates as pred
from repolytics.operators import coupling, ownership, workspace
from repolytics.plans import adapters as tables, history
from repolytics.plans.adapters import NOW
from repolytics.registry import query
from repolytics.streaming import watch

table = tables.table

# PRJ-01, PRJ-02, PRJ-06..08, PRJ-11, FN-06 -----------------------------------------------------------

EXTENSIONS = {0: (".go", "Go"), 1: (".PY", "Python"), 2: (".tsx", "TypeScript"), 3: (".yml", "YAML"), 4: (".md", None), 5: (".hpp", "C++"), 6: ("", None), 7: (".rs", "Rust"), 8: (".sql", "SQL"), 9: (".cs", "C#")}
NAMED = "CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN {repr(name) if name else 'NULL'}" for k, (_, name) in EXTENSIONS.items()) + " END"
MARKED = "CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN '{mark}'" for k, (mark, _) in EXTENSIONS.items()) + " END"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each part: at the root, one folder deep or three deep."""
    p = F.col("p_partkey")
    mark = F.lit("")
    for k, (own, _) in EXTENSIONS.items():
        mark = F.when(p % 10 == k, own).otherwise(mark)
    folder = F.when(p % 3 == 0, "").when(p % 3 == 1, F.concat("p_brand", F.lit("/"))).otherwise(F.concat("p_brand", F.lit("/x/"), "p_type", F.lit("/")))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(folder, F.lit("f"), p.cast("string"), mark).alias("path"))


@query(
    f"SELECT p_partkey, {NAMED} AS language, {NAMED} <> 'YAML' AS scored, CASE p_partkey % 3 WHEN 0 THEN '.' WHEN 1 THEN p_brand ELSE p_brand || '/x/' || p_type END AS dir, CASE p_partkey % 3 WHEN 0 THEN '' ELSE p_brand END AS boundary, 'f' || p_partkey || {MARKED} AS base, "
    "CASE p_partkey % 6 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE -1 END::BIGINT AS rank, least(greatest(p_retailprice - 1000, -50), 50)::DOUBLE AS held FROM part"
)
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    severity = F.when(k == 0, "critical").when(k == 1, "high").when(k == 2, "medium").when(k == 3, "low").when(k == 4, "info").otherwise("grave")
    own = _paths(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey")
    return own.select(
        "p_partkey", pred.language_of("path").alias("language"), pred.has_control_flow(pred.language_of("path")).alias("scored"), pred.dir_of("path").alias("dir"), pred.boundary_of("path").alias("boundary"), pred.base_name("path").alias("base"),
        pred.severity_rank(severity).alias("rank"), num.clamp(F.col("p_retailprice") - 1000, -50, 50).alias("held"),
    )


# PRJ-10, PRJ-16 ---------------------------------------------------------------------------------------------


@query("SELECT p_brand || '/x/' || p_type || '/f' || p_partkey AS path, CASE WHEN bool_or(p_size % 2 = 0) OVER (PARTITION BY p_brand, p_type) THEN p_brand || '/x/' || p_type ELSE p_brand END AS package FROM part")
def nearest_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest package above each file: a brand, or its type's folder where a part of even size made it one."""
    own = tables.spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size"), "p_partkey")
    deep = F.concat("p_brand", F.lit("/x/"), "p_type")
    packages = own.select(F.col("p_brand").alias("path")).union(own.filter("p_size % 2 = 0").select(deep)).distinct()
    return workspace.nearest(own.select(F.concat(deep, F.lit("/f"), F.col("p_partkey").cast("string")).alias("path")), packages)


@query("SELECT s_suppkey, s_suppkey % 4 = 0 AS star, s_suppkey % 4 < 3 AS deep, s_suppkey % 4 = 1 AS one FROM supplier")
def glob_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    own = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k == 0, "libs/mass").when(k == 1, "libs/units/a").when(k == 2, "libs").otherwise("library/x").alias("dir"))
    return own.select("s_suppkey", pred.matches_glob("dir", "libs/*").alias("star"), pred.matches_glob("dir", "libs/**").alias("deep"), pred.matches_glob("dir", "libs/unit?/?").alias("one"))


# AGG-16, ORD-03, WIN-07, GAT-04, AGG-27, PRJ-21 ------------------------------------------------------------------

CF = "cf AS (SELECT o_orderkey AS k, o_orderdate AS ts, o_orderpriority AS author, CAST(l_partkey AS VARCHAR) AS path FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(f"WITH {CF}, c AS (SELECT substr(path, 1, 1) AS unit, author, count(*) AS n, count(DISTINCT path) AS files FROM cf GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY n DESC, author) AS r FROM c) SELECT unit, (SELECT count(DISTINCT path) FROM cf WHERE substr(path, 1, 1) = unit) AS files, author AS owner, round(n / (SELECT sum(n) FROM c d WHERE d.unit = r.unit)::DOUBLE * 10000) / 10000 AS weighted_share FROM r WHERE r = 1")
def directory_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by the first digit of a part, ownership without decay."""
    return ownership.directories(tables.commit_files(spark, sf_dir), F.substring("path", 1, 1), NOW, half_life_days=0)


@query(
    "WITH t AS (SELECT DISTINCT l_orderkey AS k, l_suppkey::VARCHAR AS path FROM lineitem JOIN orders ON o_orderkey = l_orderkey), n AS (SELECT path, count(*) AS n FROM t GROUP BY 1), p AS (SELECT x.path AS a, y.path AS b, count(*) AS shared FROM t x JOIN t y ON x.k = y.k AND x.path < y.path GROUP BY 1, 2 HAVING count(*) >= 2), "
    "c AS (SELECT a, b, shared, least(shared::DOUBLE / least(na.n, nb.n), 1) AS coupling FROM p JOIN n na ON na.path = a JOIN n nb ON nb.path = b WHERE shared::DOUBLE / least(na.n, nb.n) >= 0.01::DOUBLE) SELECT a, b, shared, coupling, row_number() OVER (ORDER BY coupling DESC, shared DESC, a, b) AS place FROM c ORDER BY place LIMIT 100"
)
def pairs_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = coupling.strongest(coupling.pairs(tables.commit_files(spark, sf_dir, "l_suppkey"), 2, 0.01), 100).select("a", "b", "shared", "coupling")
    return own.withColumn("place", F.row_number().over(Window.orderBy(F.desc("coupling"), F.desc("shared"), "a", "b")).cast("bigint"))


SNAP = "snap AS (SELECT o_orderpriority AS root, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS id, trunc(count(*) FILTER (o_orderstatus = 'F') * 100::DOUBLE / count(*) * 100 + 0.5::DOUBLE) / 100 AS score, count(*) FILTER (o_totalprice > 300000) AS risk_count, count(*) AS files FROM orders GROUP BY 1, 2)"


def _r2(x: str) -> str:
    return f"(trunc(({x}) * 100 + CASE WHEN ({x}) >= 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END) / 100)"


@query(f"WITH {SNAP}, l AS (SELECT * FROM snap WHERE root = '5-LOW' ORDER BY id DESC LIMIT 12) SELECT count(*) AS records, {_r2('arg_max(score, id) - arg_min(score, id)')} AS score, {_r2('(arg_max(files, id) - arg_min(files, id)) / 10::DOUBLE')} AS complexity, (arg_max(risk_count, id) - arg_min(risk_count, id))::BIGINT AS risks FROM l")
def frame_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tables.snapshots(spark, sf_dir).withColumn("avg_complexity", F.col("files") / F.lit(10.0))
    return history.frame_delta(own, "5-LOW", 12)


@query(f"WITH {SNAP}, d AS (SELECT root, id, {_r2('score - lag(score) OVER (PARTITION BY root ORDER BY id)')} AS delta FROM snap) SELECT root, id, CASE WHEN delta > 5 THEN 'significant improvement' WHEN delta > 0 THEN 'slight improvement' WHEN delta <= -5 THEN 'significant regression' WHEN delta < 0 THEN 'slight regression' ELSE 'no net change' END AS verdict FROM d WHERE delta IS NOT NULL")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = history.trend(tables.snapshots(spark, sf_dir)).filter("delta is not null")
    return own.select("root", "id", history.verdict("delta").alias("verdict"))


@query("SELECT event_type AS op, user_id AS root, count(*) AS events FROM (SELECT *, event_id % 3 AS k FROM events) WHERE event_type IN ('click', 'error') AND k < 2 GROUP BY ALL")
def relevant_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, k = table(spark, sf_dir, "events"), F.col("event_id") % 3
    op = F.when(F.col("event_type") == "click", "write").when(F.col("event_type") == "error", "create").otherwise("chmod")
    events = own.select(F.col("event_type"), F.col("user_id").alias("root"), op.alias("op"), F.when(k == 0, "a/b.go").when(k == 1, "c.PY").otherwise("d.txt").alias("path"), "ts")
    return watch.relevant(events).groupBy(F.col("event_type").alias("op"), "root").agg(F.count(F.lit(1)).alias("events"))
