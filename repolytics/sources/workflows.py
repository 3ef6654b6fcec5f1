"""Workflow files as rows: one for each file, with its jobs and steps as arrays.

YAML is parsed in Arrow batches; everything after that is columns.  `on:` is read by key,
whether a resolver takes it for a word or for the truth value.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

FOLDER = ".github/workflows"
_STEP = pa.struct([("uses", pa.string()), ("options", pa.map_(pa.string(), pa.string())), ("timeout", pa.bool_())])
_GRANT = pa.struct([("scope", pa.string()), ("level", pa.string())])
_AXIS = pa.struct([("axis", pa.string()), ("n", pa.int64())])
_JOB = pa.struct([("job", pa.string()), ("permissions", pa.string()), ("grants", pa.list_(_GRANT)), ("timeout", pa.bool_()), ("axes", pa.list_(_AXIS)), ("steps", pa.list_(_STEP))])
JOB = (
    "job:string,permissions:string,grants:array<struct<scope:string,level:string>>,timeout:boolean,axes:array<struct<axis:string,n:bigint>>,"
    "steps:array<struct<uses:string,options:map<string,string>,timeout:boolean>>"
)
SCHEMA = f"file string, error string, name string, triggers array<string>, permissions string, grants array<struct<scope:string,level:string>>, jobs array<struct<{JOB}>>"


def _grants(value) -> tuple[str | None, list[dict]]:
    """permissions: a word, or a level for each scope."""
    if isinstance(value, dict):
        return None, [{"scope": str(k), "level": str(v)} for k, v in sorted(value.items(), key=lambda x: str(x[0]))]
    return (value if isinstance(value, str) else None), []


def _text(value) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _step(value) -> dict:
    own = value if isinstance(value, dict) else {}
    options = own.get("with")
    return {"uses": _text(own.get("uses")), "options": [(str(k), _text(v)) for k, v in options.items()] if isinstance(options, dict) else [], "timeout": own.get("timeout-minutes") is not None}


def _job(name, value) -> dict:
    own = value if isinstance(value, dict) else {}
    word, grants = _grants(own.get("permissions"))
    strategy = own.get("strategy")
    matrix = strategy.get("matrix") if isinstance(strategy, dict) else None
    size = lambda v: len(v) if isinstance(v, list) else 0 if v is None else 1
    axes = [{"axis": str(k), "n": size(v)} for k, v in sorted(matrix.items(), key=lambda x: str(x[0]))] if isinstance(matrix, dict) else None
    steps = own.get("steps")
    return {"job": str(name), "permissions": word, "grants": grants, "timeout": own.get("timeout-minutes") is not None, "axes": axes, "steps": [_step(s) for s in steps] if isinstance(steps, list) else []}


def parsed(text: str | None) -> dict:
    """One file; error says why it is no workflow."""
    import yaml

    out = {"error": None, "name": None, "triggers": [], "permissions": None, "grants": [], "jobs": []}
    try:
        doc = yaml.load(text or "", Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError as error:
        return out | {"error": re.sub(r"\s+", " ", str(error))}
    if doc is None:
        return out
    if not isinstance(doc, dict):
        return out | {"error": "the document is no mapping"}
    on = doc.get("on", doc.get(True))
    triggers = list(on) if isinstance(on, (dict, list)) else [on] if on is not None else []
    word, grants = _grants(doc.get("permissions"))
    jobs = doc.get("jobs")
    return out | {
        "name": _text(doc.get("name")), "triggers": [str(t) for t in triggers], "permissions": word, "grants": grants,
        "jobs": [_job(k, v) for k, v in sorted(jobs.items(), key=lambda x: str(x[0]))] if isinstance(jobs, dict) else [],
    }


def _parse(batches):
    kinds = {"error": pa.string(), "name": pa.string(), "triggers": pa.list_(pa.string()), "permissions": pa.string(), "grants": pa.list_(_GRANT), "jobs": pa.list_(_JOB)}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = [parsed(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in kinds.items())], ["file", *kinds])


def workflows(files: DataFrame) -> DataFrame:
    """file, error, name, triggers, permissions, grants, jobs of workflow files (file, text)."""
    return files.select("file", "text").mapInArrow(_parse, SCHEMA)


def workflow_files(spark: SparkSession, root: str) -> DataFrame:
    """file, text of the workflow files of a repository; an absent folder gives none."""
    from repolytics.sources.facts import absent_path

    try:
        found = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{FOLDER}")
    except Exception as error:
        if not absent_path(error):
            raise
        return spark.createDataFrame([], "file string, text string")
    named = found.withColumn("name", F.element_at(F.split("path", "/"), -1)).filter(F.col("name").rlike(r"\.ya?ml$"))
    return named.select(F.concat(F.lit(FOLDER + "/"), "name").alias("file"), F.decode("content", "UTF-8").alias("text"))


def jobs(found: DataFrame) -> DataFrame:
    """file, job, permissions, grants, timeout, axes, steps: a row for each job."""
    return found.select("file", F.explode("jobs").alias("j")).select("file", "j.*")


def steps(found: DataFrame) -> DataFrame:
    """file, job, step (from 1), uses, options, timeout: a row for each step."""
    return jobs(found).select("file", "job", F.posexplode("steps").alias("at", "s")).select("file", "job", (F.col("at") + 1).cast("bigint").alias("step"), "s.*")
