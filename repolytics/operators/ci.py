"""Rules over continuous-integration workflows, as rows of files, jobs and steps.

Every rule gives job, rule, severity, detail (null where it does not hold) as columns of a
workflow's or a job's row; workflows are those of sources.workflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repolytics.functions.predicates import is_commit_sha, severity_rank
from repolytics.sources import workflows as rows

MOST_MATRIX = 256
#: Refs that move, and set-up actions that can cache.
MOVING_REFS = ("latest", "main", "master")
CACHED_ACTIONS = ("actions/setup-node", "actions/setup-go")
CACHED_IF_ASKED = ("actions/setup-python",)
PLACES = f"array<struct<whole:boolean,{rows.JOB}>>"
FINDINGS = "array<struct<job:string,rule:string,severity:string,detail:string>>"


def _found(when, rule, severity, detail: Column) -> Column:
    """A finding where the condition holds, else null."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(when, F.struct("job", text(rule).alias("rule"), text(severity).alias("severity"), detail.alias("detail")))


def _action(step) -> Column:
    """owner/repository of an action, in lower case."""
    return F.lower(F.trim(F.substring_index(step["uses"], "@", 1)))


def unparseable() -> Column:
    return _found(F.col("whole") & F.col("error").isNotNull(), "unparseable_workflow", "high", F.col("error"))


def permissions() -> list[Column]:
    """Files and jobs that may write everything, and every scope they may write."""
    everything = _found(F.lower("permissions") == "write-all", "write_all_permissions", "high", F.col("permissions"))
    severity = lambda g: F.when(g["scope"] == "contents", "medium").otherwise("low")
    return [F.array(everything), F.transform("grants", lambda g: _found(F.lower(g["level"]) == "write", "write_scope", severity(g), g["scope"]))]


def pinning(step, numbered) -> list[Column]:
    """Actions without a ref, with an empty or moving ref, or with one that is neither a commit nor a release."""
    uses = F.trim(step["uses"])
    some, at, ref = F.coalesce(step["uses"], F.lit("")) != "", F.instr(uses, "@") > 0, F.substring_index(uses, "@", -1)
    moving = F.lower(ref).isin(*MOVING_REFS)
    release = ref.startswith("v") & ref.contains(".")
    loose = at & (ref != "") & ~is_commit_sha(ref) & (moving | ~release)
    unpinned = (~at & ~uses.startswith("./")) | (at & (ref == ""))
    return [_found(some & unpinned, "unpinned_action", "high", numbered(uses)), _found(some & loose, "mutable_ref", F.when(moving, "high").otherwise("medium"), numbered(uses))]


def caching(step, numbered) -> list[Column]:
    """Set-up steps that do not cache; those of Python only where they name a cache or its files."""
    value = F.lower(F.try_element_at(step["options"], F.lit("cache")))
    cached = F.coalesce((value != "") & (value != "false"), F.lit(False))
    asked = F.map_contains_key(step["options"], "cache") | F.map_contains_key(step["options"], "cache-dependency-path")
    detail = numbered(step["uses"])
    return [_found(_action(step).isin(*CACHED_ACTIONS) & ~cached, "missing_cache", "medium", detail), _found(_action(step).isin(*CACHED_IF_ASKED) & ~cached & asked, "missing_cache", "low", detail)]


def triggers(step, numbered) -> list[Column]:
    """Steps of workflows with a privileged trigger for foreign code that check out a ref or repository by name."""
    named = F.map_contains_key(step["options"], "ref") | F.map_contains_key(step["options"], "repository")
    exposed = F.array_contains("triggers", "pull_request_target")
    return [_found(exposed & (_action(step) == "actions/checkout") & named, "privileged_trigger_checkout", "critical", numbered(step["uses"]))]


def matrix(most: int = MOST_MATRIX) -> list[Column]:
    """Axes of one value, and matrices of more than most jobs (what include and exclude do is not counted)."""
    plain = F.filter("axes", lambda a: ~a["axis"].isin("include", "exclude"))
    product = F.aggregate(plain, F.lit(1).cast("bigint"), lambda n, a: n * a["n"])
    return [F.transform("axes", lambda a: _found(a["n"] == 1, "constant_matrix_axis", "low", a["axis"])), F.array(_found(product > most, "excessive_matrix", "medium", product.cast("string")))]


def timeouts() -> Column:
    """Jobs where neither the job nor a step has a time limit."""
    limited = F.col("timeout") | F.exists("steps", lambda s: s["timeout"])
    return _found(~F.col("whole") & ~limited, "missing_timeout", "low", F.col("job"))


def _of_step(step, at) -> Column:
    numbered = lambda detail: F.concat(F.lit("step "), (at + 1).cast("string"), F.lit(": "), detail)
    return F.array(*triggers(step, numbered), *caching(step, numbered), *pinning(step, numbered))


def _judged(workflows: DataFrame) -> DataFrame:
    """file, whole, found: a row for each workflow (whole) and for each of its jobs, with what the rules find there.

    Every rule is a column of such a row, so files are parsed once and nothing is cached or shuffled.
    """
    parts = ("job", "permissions", "grants", "timeout", "axes", "steps")
    none = F.lit(None)
    own = F.struct(F.lit(True).alias("whole"), F.lit("").alias("job"), "permissions", "grants", none.alias("timeout"), none.alias("axes"), none.alias("steps"))
    each = F.transform("jobs", lambda j: F.struct(F.lit(False).alias("whole"), *[j[p].alias(p) for p in parts]))
    places = workflows.select("file", "error", "triggers", F.explode(F.concat(F.array(own).cast(PLACES), each.cast(PLACES))).alias("p")).select("file", "error", "triggers", "p.*")
    found = [F.array(unparseable(), timeouts()), *permissions(), *matrix(), F.flatten(F.transform("steps", _of_step))]
    return places.select("file", "whole", F.concat(*[F.coalesce(F.array_compact(f), F.array().cast(FINDINGS)) for f in found]).alias("found"))


def findings(workflows: DataFrame) -> DataFrame:
    """What all rules find: file, job, rule, severity, detail."""
    each = _judged(workflows).select("file", F.explode_outer("found").alias("f"))  # explode alone would judge again, to filter what is empty
    return each.filter(F.col("f").isNotNull()).select("file", "f.*")


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc(severity_rank("severity")), "rule", "file", "job", "detail")


def report(workflows: DataFrame) -> DataFrame:
    """One row: workflows, jobs, and findings by severity."""
    of = lambda s: F.coalesce(F.sum(F.size(F.filter("found", lambda f: f["severity"] == s))), F.lit(0)).cast("bigint").alias(s)
    return _judged(workflows).agg(F.count_if("whole").alias("workflows"), F.count_if(~F.col("whole")).alias("jobs"), *[of(s) for s in ("critical", "high", "medium", "low")])
