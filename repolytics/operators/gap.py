"""Static effort against runtime evidence: hot, quiet, debt and phantom code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repolytics.functions.numeric import clamp01, col, ratio, round_half
from repolytics.functions.predicates import base_name

COMPLICATED = 25.0
LEAST_COVERAGE = 0.5


def static_score(complexity, lines, churn) -> Column:
    """0..100 from complexity over 50, lines over 400 and churn over 300, each saturating."""
    parts = 0.45 * clamp01(col(complexity) / 50) + 0.30 * clamp01(col(lines) / 400) + 0.25 * clamp01(col(churn) / 300)
    return round_half(100 * parts, 2)


def critical_risk(static, hits) -> Column:
    return F.when(col(hits) > 0, round_half(col(static) * F.log10(col(hits) + 1), 2)).otherwise(0.0)


def samples(events: DataFrame, name: str = "name", hits: str | None = None, latency: str = "latency_ns") -> DataFrame:
    """name, hits, latency_ns summed for each function; most hits first when ordered."""
    n = F.count(F.lit(1)) if hits is None else F.sum(hits)
    return events.groupBy(F.col(name).alias("name")).agg(n.cast("bigint").alias("hits"), F.sum(latency).cast("bigint").alias("latency_ns"))


def coverage(events: DataFrame, attributed: Column) -> DataFrame:
    """One row: observations, attributed, coverage, kind."""
    sums = events.agg(F.count(F.lit(1)).alias("observations"), F.count_if(attributed).alias("attributed"))
    kind = F.when(F.col("attributed") == 0, "none").when(F.col("attributed") < F.col("observations"), "partial").otherwise("file+function")
    return sums.select("observations", "attributed", ratio("attributed", "observations").alias("coverage"), kind.alias("attribution"))


def first(found: DataFrame, by: str = "critical", limit: int | None = None) -> DataFrame:
    """Entries in order: by critical risk, or by static effort alone where there is no profile; ties by path."""
    order = [F.desc("critical"), F.desc("static"), "path"] if by == "critical" else [F.desc("static"), "path"]
    ordered = found.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def entries(records: DataFrame, runtime: DataFrame, profile_coverage: float, churn: DataFrame | None = None, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """path, static, hits, latency_ns, critical, bucket, ambiguous of measured, non-test files.

    records: path, code_lines, complexity, is_test, complexity_measured.  runtime: file,
    hits, latency_ns, joined on base names; a base name of several files joins nothing.
    """
    named = records.withColumn("base", base_name("path"))
    seen = runtime.withColumn("base", base_name("file")).filter("base <> ''").groupBy("base").agg(F.sum("hits").cast("bigint").alias("hits"), F.sum("latency_ns").cast("bigint").alias("latency_ns"))
    alone = named.groupBy("base").agg(F.count(F.lit(1)).alias("paths"), F.min("path").alias("path")).filter("paths = 1")
    alone = alone.join(seen, "base", "left").select("path", "hits", "latency_ns", F.lit(True).alias("alone"))  # common names meet nothing
    own = named.filter(~F.col("is_test") & F.col("complexity_measured")).join(alone, "path", "left")
    if churn is not None:
        own = own.join(churn.select("path", (F.col("added") + F.col("deleted")).alias("churn")), "path", "left")
    else:
        own = own.withColumn("churn", F.lit(0))
    one = F.coalesce("alone", F.lit(False))
    zero = F.lit(0).cast("bigint")
    own = own.withColumn("hits", F.when(one, F.coalesce("hits", zero)).otherwise(zero)).withColumn("latency_ns", F.when(one, F.coalesce("latency_ns", zero)).otherwise(zero))
    own = own.withColumn("static", static_score("complexity", "code_lines", F.coalesce("churn", F.lit(0))))
    absent = "phantom" if profile_coverage >= least_coverage else "debt"
    bucket = F.when((F.col("hits") > 0) & (F.col("static") >= COMPLICATED), "hot").when(F.col("hits") > 0, "quiet").otherwise(absent)
    return own.select("path", "static", "hits", "latency_ns", critical_risk("static", "hits").alias("critical"), bucket.alias("bucket"), (~one).alias("ambiguous"))
