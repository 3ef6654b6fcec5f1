"""Star-schema tables as fact tables, so that the same operators run on them.

An order is a commit, its priority the author, its line items the paths it changes
(quantity added, line number deleted); documents are source files; events are runtime
observations; months of orders are snapshots; nations and regions are packages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from repolytics.functions.dealing import spread
from repolytics.functions.numeric import round2
from repolytics.functions.predicates import severity_of_impact
from repolytics.operators.code import branch_count, estimates, line_counts

NOW = "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("author"))


def commit_files(spark: SparkSession, sf_dir: str, grain: str = "l_partkey") -> DataFrame:
    """A row for each line item, dealt by commit: what follows groups nearly distinct rows, and few tasks would hold them all."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col(grain).cast("string").alias("path"), F.col("l_quantity").cast("bigint").alias("added"), F.col("l_linenumber").cast("bigint").alias("deleted"))
    own, dealt = commits(spark, sf_dir), spread(lines, "l_orderkey")
    return own.join(dealt, own["commit"] == dealt["l_orderkey"]).select("commit", "at", "author", "path", "added", "deleted")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("doc_id") % 5 == 0, "tests/").otherwise("")
    path = F.concat("source", F.lit("/"), place, F.col("doc_id").cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File records from columns alone: prose has no comments, so lines need no scanner."""
    own = files(spark, sf_dir)
    both = line_counts(own.select("path", F.lit("Python").alias("language"), F.col("language").alias("lang"), branch_count(F.col("content")).alias("branch_points"), "content"), keep=("lang", "branch_points"))
    zero = F.lit(0).cast("bigint")
    return estimates(both.select("path", "language", "lang", "total_lines", F.col("filled_lines").alias("code_lines"), zero.alias("functions"), "branch_points", F.col("branch_points").alias("max_function_branches"), zero.alias("max_nesting")))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runtime observations: function, file (null where the event has no k), latency."""
    own = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return own.select(F.concat_ws(":", "event_type", k).alias("name"), F.when(k.cast("int") % 2 == 0, F.concat(k, F.lit(".py"))).alias("file"), F.floor(F.col("value") * 1000).cast("bigint").alias("latency_ns"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each priority (root) and month: id, score, risk_count, files."""
    own = table(spark, sf_dir, "orders")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint")
    return own.groupBy(F.col("o_orderpriority").alias("root"), month.alias("id")).agg(
        round2(F.try_divide(F.count_if(F.col("o_orderstatus") == "F") * 100.0, F.count(F.lit(1)).cast("double"))).alias("score"),
        F.count_if(F.col("o_totalprice") > 300000).alias("risk_count"), F.count(F.lit(1)).alias("files"),
    )


def risks(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """A risk for each customer's orders of a year: id, impact, severity."""
    own = table(spark, sf_dir, "orders").filter(F.year("o_orderdate") == year)
    sums = own.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("impact"))
    return sums.withColumn("severity", severity_of_impact("impact"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("package"), F.col("r_name").alias("boundary"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation imports another where its customers buy clearly more than average from that nation's suppliers."""
    nation = table(spark, sf_dir, "nation")
    bought = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    buyers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    sold = bought.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = sold.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    edges = counts.crossJoin(F.broadcast(counts.agg(F.avg("n").alias("usual")))).filter(F.col("n") > 1.3 * F.col("usual")).select("c_nationkey", "s_nationkey")
    a, b = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("src")), nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dst"))
    return edges.join(a, "c_nationkey").join(b, "s_nationkey").select("src", "dst")
