"""Snapshots as JSON documents, and a history table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SCHEMA = (
    "schema_version string, root string, recorded_at timestamp, git_commit string, version string, score double, grade string, code_score double, dependency_score double, git_score double, "
    "risk_count bigint, critical_risk_count bigint, high_risk_count bigint, hotspot_count bigint, confirmed_hotspots bigint, files bigint, source_files bigint, test_files bigint, "
    "test_file_ratio double, code_lines bigint, avg_file_lines double, avg_complexity double, max_complexity double, dependency_drift boolean"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of JSON files; a document without a schema version is refused."""
    found = spark.read.schema(SCHEMA).json(path, multiLine=True)
    checked = F.when(F.col("schema_version").isNull(), F.raise_error(F.lit("a snapshot needs a schema_version"))).otherwise(F.col("schema_version"))
    return found.withColumn("schema_version", checked)


def write_json(snapshots: DataFrame, path: str) -> None:
    snapshots.write.mode("overwrite").json(path)


def append(snapshots: DataFrame, path: str) -> None:
    """Add snapshots to a Parquet history partitioned by root, with ids after those there.

    One writer at a time; ids follow recorded_at within a root.
    """
    spark = snapshots.sparkSession
    try:
        last = spark.read.parquet(path).groupBy("root").agg(F.max("id").alias("last_id"))
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        last = spark.createDataFrame([], "root string, last_id bigint")
    order = Window.partitionBy("root").orderBy("recorded_at")
    numbered = snapshots.join(last, "root", "left").withColumn("id", F.coalesce("last_id", F.lit(0).cast("bigint")) + F.row_number().over(order)).drop("last_id")
    numbered.write.mode("append").partitionBy("root").parquet(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# Documents: a snapshot with its parts nested, read without a schema -----------------------------------------------

#: Where a document of each schema version keeps its parts.
PLACES = {"risks": ("$.risks", "$.risks.items"), "score": ("$.score", "$.health.score"), "grade": ("$.grade", "$.health.grade"), "version": ("$.schema_version",)}
RISK = "array<struct<id:string,impact:double,severity:string,subject:string>>"


def documents(snapshots: DataFrame, risks: DataFrame, by: str = "root") -> DataFrame:
    """by, doc: one VARIANT document for each snapshot row, its risks (by, id, impact, severity, subject) within.

    The columns of the snapshot stay at the top of the document, whatever they are.
    """
    wanted = [c for c in ("id", "impact", "severity", "subject") if c in risks.columns]
    nested = risks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*wanted))).alias("risks"))
    whole = snapshots.join(nested, by, "left").withColumn("risks", F.coalesce("risks", F.array()))
    return whole.select(by, F.parse_json(F.to_json(F.struct(*[c for c in whole.columns]))).alias("doc"))


def _at(doc: str, part: str, kind: str):
    """A part of a document, wherever its schema version keeps it; null where it is absent or of another kind."""
    return F.coalesce(*(F.try_variant_get(F.col(doc), place, kind) for place in PLACES[part]))


def stored_risks(stored: DataFrame, by: str = "root", doc: str = "doc") -> DataFrame:
    """by, id, impact, severity of the risks of documents of any schema version."""
    return stored.select(by, F.explode(_at(doc, "risks", RISK)).alias("r")).select(by, "r.id", "r.impact", "r.severity")


def stored_measures(stored: DataFrame, names: list[str], by: str = "root", doc: str = "doc") -> DataFrame:
    """by, schema_version, score, grade and the named measures of documents; null where one has none."""
    more = [F.coalesce(F.try_variant_get(F.col(doc), f"$.{n}", "double"), F.try_variant_get(F.col(doc), f"$.measures.{n}", "double")).alias(n) for n in names]
    return stored.select(by, _at(doc, "version", "string").alias("schema_version"), _at(doc, "score", "double").alias("score"), _at(doc, "grade", "string").alias("grade"), *more)


def write_documents(stored: DataFrame, path: str) -> None:
    """Add documents to a Parquet folder, their VARIANT column as it is."""
    stored.write.mode("append").parquet(path)
