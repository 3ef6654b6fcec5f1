"""Queries that run the readers: text made of the tables' rows goes through the parsers.

Each adapter writes what a tool would write (a log, a manifest, a workflow, spans); the
SQL counts the same things from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from repolytics.functions import predicates as pred, text as words
from repolytics.operators import ci, workspace
from repolytics.plans import adapters as tables, history, risks, setup
from repolytics.registry import query
from repolytics.sources import facts, profiles, workflows

table = tables.table


def lines(*parts) -> Column:
    return F.concat_ws("\n", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


# SRC-03, SRC-05..09: the log ---------------------------------------------------------------

LINE = "l AS (SELECT l_orderkey AS k, 'p' || l_partkey AS path, CASE WHEN l_linenumber <> 7 THEN l_quantity::BIGINT END AS added, CASE WHEN l_linenumber <> 7 THEN l_linenumber::BIGINT END AS deleted FROM lineitem)"


def _stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a numstat: binary changes (line number 7) have dashes for counts."""
    binary = F.col("l_linenumber") == 7
    count = lambda c: F.when(binary, "-").otherwise(F.col(c).cast("bigint").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws("\t", count("l_quantity"), count("l_linenumber"), text("p", F.col("l_partkey").cast("string"))).alias("value"))


@query(f"WITH {LINE} SELECT path, count(added) AS commits, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted, (count(added) + sum(added) + sum(deleted))::BIGINT AS score FROM l WHERE added IS NOT NULL GROUP BY path")
def numstat_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from repolytics.operators.churn import churn_by_path

    return churn_by_path(facts.numstat(_stat(spark, sf_dir)))


@query(f"WITH {LINE} SELECT path, count(*) AS changes, count(*) FILTER (added IS NULL) AS binary_changes FROM l GROUP BY path")
def numstat_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = facts.numstat(_stat(spark, sf_dir), keep_binary=True)
    return own.groupBy("path").agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("added").isNull()).alias("binary_changes"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each order, as `git log --numstat` writes it."""
    stat = tables.spread(_stat(spark, sf_dir), "l_orderkey").groupBy("l_orderkey").agg(F.concat_ws("\n", F.collect_list("value")).alias("stat"))
    own = tables.spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), "o_orderkey").join(stat, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    head = F.concat_ws("\x1f", F.col("o_orderkey").cast("string"), "o_orderpriority", F.concat("o_orderpriority", F.lit("@example.org")), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    return own.select(lines(head, "", F.coalesce("stat", F.lit(""))).alias("value"))


@query(
    f"WITH {LINE} SELECT k::VARCHAR AS commit, o_orderpriority AS author, o_orderpriority || '@example.org' AS email, o_orderdate AS at, array_to_string(list_sort(list_distinct(list(path))), ' ') AS files, coalesce(sum(added), -1)::BIGINT AS added, coalesce(sum(deleted), -1)::BIGINT AS deleted "
    "FROM l JOIN orders ON o_orderkey = k GROUP BY ALL"
)
def log_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.commits(facts.log_records(_log(spark, sf_dir))).withColumn("files", F.array_join("files", " "))


@query("SELECT 'p' || l_partkey AS path FROM lineitem WHERE l_quantity > 49 UNION SELECT 'p' || p_partkey FROM part WHERE p_size = 50")
def pending_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(text("p", F.col("l_partkey").cast("string"), " ").alias("value"))
    untracked = table(spark, sf_dir, "part").filter("p_size = 50").select(text("p", F.col("p_partkey").cast("string")).alias("value"))
    return facts.pending_changes(changed, untracked.union(spark.createDataFrame([("",)], "value string")))


# SRC-22..27, FN-13/14, GAP-03: runtime ----------------------------------------------------------


@query(
    "SELECT CASE WHEN event_id % 10 <> 0 THEN '/' || event_type || '/{id}' END AS route, count(*) AS hits, sum(CASE WHEN event_id % 10 <> 0 THEN floor(value * 1000)::BIGINT END)::BIGINT AS micros, "
    "count(*) FILTER (event_id % 10 <> 0 AND event_id % 4 = 0) AS errors, max(CASE WHEN event_id % 10 <> 0 THEN date_trunc('second', ts) END) AS last_at FROM events GROUP BY 1"
)
def access_log_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, n = table(spark, sf_dir, "events"), F.col("event_id")
    good = text('10.0.0.1 - - [', F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET /', F.col("event_type"), "/", F.col("user_id").cast("string"), '?page=2 HTTP/1.1" ', F.when(n % 4 == 0, "404").otherwise("200"), " 512 ", F.floor(F.col("value") * 1000).cast("bigint").cast("string"))
    parsed = facts.access_log(own.select(F.when(n % 10 == 0, "no request at all").otherwise(good).alias("value")))
    return parsed.groupBy("route").agg(F.count(F.lit(1)).alias("hits"), F.sum("micros").cast("bigint").alias("micros"), F.count_if(F.col("status") >= 400).alias("errors"), F.max("at").alias("last_at"))


def _quoted(value: Column) -> Column:
    """A string as JSON: to_json takes it as a list of one, whose brackets go."""
    return F.btrim(F.to_json(F.array(value)), F.lit("[]"))


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An OTLP export for each user, in the three shapes exporters write.

    An event of type x is a span of the function on_x(), so that blank types are names too;
    a time that is null or beyond 64 bits is null in its span, which still counts.
    """
    own, kind = table(spark, sf_dir, "events"), F.col("user_id") % 3
    took = F.try_multiply(F.floor(F.col("value") * 1000).cast("bigint"), F.lit(1000))
    begin = F.when(took > 2**63 - 1 - 1700000000000000000, F.lit(0)).otherwise(F.lit(1700000000000000000))
    nanos = F.coalesce(took.cast("string"), F.lit("null"))
    end = F.coalesce(text('"', (begin + took).cast("string"), '"'), F.lit("null"))
    known, name = F.col("event_type") != "error", _quoted(text("on_", F.col("event_type"), "()"))
    listed = text('{"name":"s","startTimeUnixNano":"', begin.cast("string"), '","endTimeUnixNano":', end, ',"attributes":[{"key":"n","value":{"intValue":"1"}}', F.when(known, text(',{"key":"code.function.name","value":{"stringValue":', name, "}}")).otherwise(""), "]}")
    nested = text('{"durationNanos":', nanos, F.when(known, text(',"code":{"function":{"name":', name, '},"filepath":"a/f.py"}')).otherwise(""), "}")
    plain = text('{"duration_nanos":', nanos, F.when(known, text(',"attributes":{"code.function.name":', name, "}")).otherwise(""), "}")
    span = F.when(kind == 0, listed).when(kind == 1, nested).otherwise(plain)
    spans = own.select("user_id", span.alias("span")).groupBy("user_id").agg(F.concat_ws(",", F.collect_list("span")).alias("spans"))
    shape = F.when(kind == 0, text('{"resourceSpans":[{"resource":{"attributes":[{"key":"service.version","value":{"stringValue":"1.2"}}]},"scopeSpans":[{"spans":[', F.col("spans"), "]}]}]}")).when(kind == 1, text('{"spans":[', F.col("spans"), "]}")).otherwise(text(" [", F.col("spans"), "]"))
    return spans.select("user_id", shape.alias("value"))


OTEL = "SELECT user_id % 3 AS shape, nullif(event_type, 'error') AS function, count(*) AS hits, sum(floor(value * 1000)::BIGINT * 1000)::BIGINT AS latency_ns FROM events GROUP BY 1, 2"


@query(OTEL)
def otel_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = facts.otel_spans(_exports(spark, sf_dir), keep=("user_id",)).withColumn("function", F.expr("substr(function, 4, length(function) - 5)"))
    return own.groupBy((F.col("user_id") % 3).alias("shape"), "function").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.when(F.col("timed"), F.col("latency_ns"))).cast("bigint").alias("latency_ns"))


@query(
    "SELECT 'otel' || user_id AS profile, count(*) AS observations, count(*) FILTER (event_type <> 'error') AS attributed, count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE AS coverage FROM events GROUP BY user_id "
    "UNION ALL SELECT 'odd' || n_nationkey, 0, 0, 0 FROM nation"
)
def profile_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by their content: exports of spans, and files of no known kind.

    A row of nation is a file of its own, told by a number after its name where keys repeat.
    """
    named = lambda name, key: text(name, F.coalesce(F.col(key).cast("string"), F.lit("?")))
    good = _exports(spark, sf_dir).select(named("otel", "user_id").alias("path"), F.col("value").cast("binary").alias("content"))
    odd = table(spark, sf_dir, "nation").select(text(named("odd", "n_nationkey"), "/", F.monotonically_increasing_id().cast("string")).alias("path"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("")).otherwise("nothing known").cast("binary").alias("content"))
    name = F.substring_index("profile", "/", 1)
    return profiles.summary(profiles.load(good.unionByName(odd))).withColumn("profile", F.when(~name.endswith("?"), name))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'the profile records version=' || o_custkey || ', the tree''s version is unknown' WHEN o_orderkey % 4 = 2 THEN NULL ELSE 'the profile records commit=' || o_custkey || ', the tree is x' END AS note FROM orders")
def profile_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    value = F.col("o_custkey").cast("string")
    labels = F.when(k == 0, F.create_map(F.lit("host"), value)).when(k == 3, F.create_map(F.lit("commit"), value)).otherwise(F.create_map(F.lit("version"), value))
    build = F.when(k == 1, "").when(k == 2, F.concat(F.lit("v"), value)).otherwise("x")
    return own.select("o_orderkey", profiles.stale_note(labels, build).alias("note"))


# SRC-11..21, AGG-24, PRJ-24/25: manifests --------------------------------------------------------------

PARTS = "d AS (SELECT l_orderkey AS k, count(DISTINCT l_partkey) FILTER (l_linenumber % 2 = 1) AS direct, count(DISTINCT l_partkey) FILTER (l_linenumber % 2 = 0) AS dev, len(list_intersect(list(DISTINCT l_partkey) FILTER (l_linenumber % 2 = 1), list(DISTINCT l_partkey) FILTER (l_linenumber % 2 = 0))) AS shared FROM lineitem GROUP BY 1)"


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, direct and dev: the parts of an order's odd and even lines as names of packages."""
    name = text("p", F.col("l_partkey").cast("string"))
    odd = F.col("l_linenumber") % 2 == 1
    own = tables.spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey")
    return own.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.when(odd, name)).alias("direct"), F.collect_set(F.when(~odd, name)).alias("dev"))


def _each(names, before: str, after: str, sep: str = "\n") -> Column:
    return F.array_join(F.transform(names, lambda x: F.concat(F.lit(before), x, F.lit(after))), sep)


@query(
    f"WITH {PARTS} SELECT k, direct AS npm_direct, dev - coalesce(shared, 0) AS npm_dev, direct AS go_direct, dev AS go_indirect, direct AS requirements, direct AS npm_lock, direct AS pnpm_lock, dev AS poetry_lock, direct + dev AS pipenv_lock, dev AS yarn_lock, direct AS go_sum FROM d"
)
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, direct, dev = _declared(spark, sf_dir), F.col("direct"), F.col("dev")
    npm = text('{"dependencies":{', _each(direct, '"', '":"^1"', ","), '},"devDependencies":{', _each(dev, '"', '":"^1"', ","), "}}")
    go = lines("module example.org/m", "", "require (", _each(direct, "\texample.org/", " v1.0.0"), _each(dev, "\texample.org/", " v1.0.0 // indirect"), ")")
    wanted = lines("-r other.txt", "# of this order", _each(direct, "", "_x==1.0  # pinned"), "https://example.org/a.whl")
    npm_lock = text('{"packages":{"":{"version":"1"}', _each(direct, ',"node_modules/', '":{"version":"1"}', ""), "}}")
    pnpm = lines("lockfileVersion: 9", "importers:", "  x:", "packages:", _each(direct, "  ", ":\n    resolution: {integrity: y}"))
    pipenv = text('{"default":{', _each(direct, '"', '":{"version":"1"}', ","), '},"develop":{', _each(dev, '"', '":{"version":"1"}', ","), "}}")
    counted = own.select(
        "k", facts.npm_manifest(npm).alias("npm"), facts.go_mod(go).alias("go"), F.size(facts.requirements(wanted)).cast("bigint").alias("requirements"),
        facts.npm_lock_count(npm_lock).alias("npm_lock"), facts.pnpm_lock_count(pnpm).alias("pnpm_lock"), facts.poetry_lock_count(_each(dev, "[[package]]\nname = ", "")).alias("poetry_lock"),
        facts.pipenv_lock_count(pipenv).alias("pipenv_lock"), facts.yarn_lock_count(_each(dev, "", "@^1:\n  version 1")).alias("yarn_lock"), facts.go_sum_count(_each(direct, "", " v1 h1:a=\n", "")).alias("go_sum"),
    )
    heads = {"npm_direct": "npm.direct", "npm_dev": "npm.dev", "go_direct": "go.direct", "go_indirect": "go.indirect"}
    return counted.select("k", *[F.col(c).alias(n) for n, c in heads.items()], "requirements", "npm_lock", "pnpm_lock", "poetry_lock", "pipenv_lock", "yarn_lock", "go_sum")


@query(f"WITH {PARTS} SELECT k::VARCHAR AS dir, direct - coalesce(shared, 0) AS direct, dev, direct + dev - coalesce(shared, 0) AS packages FROM d")
def pyproject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _declared(spark, sf_dir)
    doc = lines("[project]", 'name = "x"', text("dependencies = [", _each("direct", '"', '>=1"', ", "), "]"), "[project.optional-dependencies]", text("test = [", _each("dev", '"', '[extra]"', ", "), "]"))
    found = facts.pyproject(own.select(F.col("k").cast("string").alias("dir"), doc.alias("text")))
    return found.select("dir", "direct", "dev", F.size("packages").cast("bigint").alias("packages"))


@query(
    f"WITH {PARTS} SELECT k::VARCHAR AS dir, CASE k % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'go' ELSE 'python' END AS name, CASE k % 3 WHEN 0 THEN 'package.json' WHEN 1 THEN 'go.mod' ELSE 'requirements.txt' END AS manifest, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 3 = 0 THEN 'yarn.lock' WHEN k % 3 = 1 THEN 'go.sum' ELSE 'poetry.lock' END AS lockfile, "
    "direct, CASE WHEN k % 4 = 0 THEN 0 ELSE dev END AS transitive, k % 4 = 0 AS drift, k % 4 <> 0 AND k % 5 = 0 AS stale FROM d"
)
def dependency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests and lock files of each order as a folder; every fifth lock is older than its manifest."""
    own, k = _declared(spark, sf_dir), F.col("k")
    pick = lambda *x: F.when(k % 3 == 0, x[0]).when(k % 3 == 1, x[1]).otherwise(x[2])
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    manifest = pick(text('{"dependencies":{', _each("direct", '"', '":"^1"', ","), "}}"), lines("require (", _each("direct", "\t", " v1.0.0"), ")"), _each("direct", "", "==1"))
    lock = pick(_each("dev", "", "@^1:\n  version 1"), _each("dev", "", " v1 h1:a="), _each("dev", "[[package]]\nname = ", ""))
    made = own.select(F.col("k").cast("string").alias("dir"), pick(F.lit("package.json"), F.lit("go.mod"), F.lit("requirements.txt")).alias("file"), at.alias("mtime"), manifest.alias("text"))
    locks = own.filter(k % 4 != 0).select(F.col("k").cast("string").alias("dir"), pick(F.lit("yarn.lock"), F.lit("go.sum"), F.lit("poetry.lock")).alias("file"), F.when(k % 5 == 0, F.timestamp_seconds(F.lit(1_699_999_000))).otherwise(at).alias("mtime"), lock.alias("text"))
    return facts.dependency_stats(made.unionByName(locks)).select("dir", "name", "manifest", "lockfile", "direct", "transitive", "drift", "stale")


# SRC-28/29, PRJ-09: imports -----------------------------------------------------------------------------------


@query("SELECT DISTINCT 'm/' || c_mktsegment AS src, 'm/' || n_name AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT DISTINCT 'm/' || c_mktsegment, 'fmt' FROM customer")
def go_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    files = named.select(text(F.col("c_mktsegment"), "/f", F.col("c_custkey").cast("string"), ".go").alias("path"), lines("package f", "", 'import "fmt"', "import (", text('\tx "m/', F.col("n_name"), '"'), ")", "func main() {}").alias("content"))
    return facts.go_imports(files, "m")


@query("SELECT 'm/' || c_mktsegment AS package, c_mktsegment AS boundary, count(*) AS files FROM customer GROUP BY ALL")
def go_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.go_packages(table(spark, sf_dir, "customer").select(text(F.col("c_mktsegment"), "/f", F.col("c_custkey").cast("string"), ".go").alias("path")), "m")


# SRC-31/32, CI-01..06, ORD-05, GAT-03: workflows -------------------------------------------------------------------


def _workflow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workflow for each part; its key decides which rules it breaks."""
    p, s = F.col("p_partkey"), F.col("p_size")
    on = F.when(p % 5 == 0, "on: pull_request_target").when(p % 5 == 1, "on: [push, pull_request_target]").when(p % 5 == 2, "on:\n  pull_request_target:\n    branches: [main]").otherwise("on: push")
    allowed = F.when(p % 4 == 0, "permissions: write-all").when(p % 4 == 1, "permissions:\n  contents: write\n  issues: Write\n  pages: read").otherwise("permissions: read-all")
    ref = F.when(p % 6 == 0, "@main").when(p % 6 == 1, "@v4").when(p % 6 == 2, "@v4.1.0").when(p % 6 == 3, "@" + "0" * 40).when(p % 6 == 4, "@").otherwise("")
    axis = lambda name, n: text(f"        {name}: [", F.array_join(F.sequence(F.lit(1), n), ", "), "]")
    matrix = F.when(p % 2 == 0, lines("    strategy:", "      matrix:", axis("a", s % 20 + 1), axis("b", s % 18 + 1), "        include: [{a: 1}]"))
    node = F.when(p % 3 == 0, "        with: {cache: npm}").when(p % 3 == 1, "        with: {cache: false}")
    python = F.when(p % 11 == 0, "        with: {cache-dependency-path: x}").when(p % 11 == 1, "        with: {cache: pip}")
    doc = lines(
        text("name: w", p.cast("string")), on, allowed, "jobs:", "  build:", "    runs-on: x", F.when(p % 3 == 0, "    timeout-minutes: 5"), matrix, "    steps:",
        text('      - uses: "actions/checkout', ref, '"'), F.when(p % 7 == 0, "        with: {ref: x}"), "      - uses: Actions/Setup-Node@v4.0.1", node, "      - uses: actions/setup-python@v5.0.0", python,
        "      - uses: ./local", "      - run: make", F.when(p % 9 == 1, "        timeout-minutes: 3"),
    )
    return tables.spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(text("w", p.cast("string"), ".yml").alias("file"), F.when(p % 50 == 49, "jobs: [").otherwise(doc).alias("text"))


FLOWS = (
    "w AS (SELECT 'w' || p_partkey || '.yml' AS file, p_partkey AS p, p_size AS s FROM part WHERE p_partkey % 50 <> 49), wf AS ("
    "SELECT 'w' || p_partkey || '.yml' AS file, '' AS job, 'unparseable_workflow' AS rule, 'high' AS severity FROM part WHERE p_partkey % 50 = 49 UNION ALL SELECT file, '', 'write_all_permissions', 'high' FROM w WHERE p % 4 = 0 "
    "UNION ALL SELECT file, '', 'write_scope', 'medium' FROM w WHERE p % 4 = 1 UNION ALL SELECT file, '', 'write_scope', 'low' FROM w WHERE p % 4 = 1 UNION ALL SELECT file, 'build', 'privileged_trigger_checkout', 'critical' FROM w WHERE p % 5 < 3 AND p % 7 = 0 "
    "UNION ALL SELECT file, 'build', 'missing_cache', 'medium' FROM w WHERE p % 3 <> 0 UNION ALL SELECT file, 'build', 'missing_cache', 'low' FROM w WHERE p % 11 = 0 UNION ALL SELECT file, 'build', 'mutable_ref', CASE p % 6 WHEN 0 THEN 'high' ELSE 'medium' END FROM w WHERE p % 6 < 2 "
    "UNION ALL SELECT file, 'build', 'unpinned_action', 'high' FROM w WHERE p % 6 > 3 UNION ALL SELECT file, 'build', 'constant_matrix_axis', 'low' FROM w, (SELECT unnest(['a', 'b', 'include']) AS axis) WHERE p % 2 = 0 AND (axis = 'include' OR axis = 'a' AND s % 20 = 0 OR axis = 'b' AND s % 18 = 0) "
    "UNION ALL SELECT file, 'build', 'excessive_matrix', 'medium' FROM w WHERE p % 2 = 0 AND (s % 20 + 1) * (s % 18 + 1) > 256 UNION ALL SELECT file, 'build', 'missing_timeout', 'low' FROM w WHERE p % 3 <> 0 AND p % 9 <> 1)"
)


@query(f"WITH {FLOWS} SELECT file, job, rule, severity, count(*) AS n FROM wf GROUP BY ALL")
def workflow_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ci.findings(workflows.workflows(_workflow_files(spark, sf_dir)))
    return found.groupBy("file", "job", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FLOWS} SELECT (SELECT count(*) FROM part) AS workflows, (SELECT count(*) FROM w) AS jobs, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low")) + " FROM wf")
def workflow_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ci.report(workflows.workflows(_workflow_files(spark, sf_dir)))


@query(f"WITH {FLOWS}, o AS (SELECT file, rule, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS sr, job FROM wf WHERE rule <> 'constant_matrix_axis' AND rule <> 'write_scope') SELECT file, rule, row_number() OVER (ORDER BY sr DESC, rule, file, job) AS place FROM o ORDER BY place LIMIT 200")
def workflow_findings_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc(pred.severity_rank("severity")), "rule", "file", "job"]
    own = ci.ordered(ci.findings(workflows.workflows(_workflow_files(spark, sf_dir))).filter(~F.col("rule").isin("constant_matrix_axis", "write_scope"))).limit(200)
    return own.select("file", "rule", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))


@query(f"WITH {FLOWS} SELECT 'workflow_' || rule AS rule, file || CASE WHEN job = '' THEN '' ELSE ' job ' || job END AS place, count(*) AS n FROM wf WHERE severity IN ('critical', 'high') GROUP BY ALL")
def workflow_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = risks.workflow_breaches(ci.findings(workflows.workflows(_workflow_files(spark, sf_dir))), "high")
    return broken.groupBy("rule", "place").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'opened' END AS action, CASE WHEN o_orderkey % 3 > 0 THEN 'o/r' END AS repository, o_orderkey % 3 = 2 AS is_pull_request, CASE WHEN o_orderkey % 3 = 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 7 END END AS number, "
    "CASE WHEN o_orderkey % 3 = 2 THEN 'main' END AS base_ref, CASE WHEN o_orderkey % 3 = 2 THEN 'abc' || o_orderkey END AS head_sha FROM orders"
)
def pull_request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    number = F.when(k % 2 == 0, F.col("o_custkey")).otherwise(0)
    pull = F.when(k % 3 == 2, text(',"pull_request":{"number":', number.cast("string"), ',"base":{"ref":"main","sha":"b"},"head":{"ref":"f","sha":"abc', k.cast("string"), '"}}')).otherwise("")
    event = F.when(k % 3 == 0, "{}").otherwise(text('{"action":"opened","number":7,"repository":{"full_name":"o/r"}', pull, "}"))
    return own.select("o_orderkey", "o_custkey", facts.pull_request_event(event).alias("e")).select("o_orderkey", "e.action", "e.repository", "e.is_pull_request", F.when((k % 3 == 2) & (F.col("o_custkey") == 0) & (k % 2 == 0), 0).otherwise(F.col("e.number")).cast("bigint").alias("number"), "e.base_ref", "e.head_sha")


# SRC-33, PRJ-14/16..18, GRF-03/04, ORD-06, MONO-01: workspaces -------------------------------------------------------------------

SHAPES = (
    "(VALUES (0, 'pnpm', 'pnpm-workspace.yaml', 'pkgs/a'), (0, 'pnpm', 'pnpm-workspace.yaml', 'pkgs/b'), (1, 'lerna', 'lerna.json', 'pkgs/a'), (1, 'lerna', 'lerna.json', 'pkgs/b'), (1, 'lerna', 'lerna.json', 'pkgs/old'), (2, 'go.work', 'go.work', 'pkgs/a'), (2, 'go.work', 'go.work', 'pkgs/b'), "
    "(3, 'cargo', 'Cargo.toml', 'pkgs/a'), (3, 'cargo', 'Cargo.toml', 'pkgs/b'), (3, 'cargo', 'Cargo.toml', 'pkgs/old'), (3, 'cargo', 'Cargo.toml', 'pkgs/deep/x'), (4, 'npm', 'package.json', 'pkgs/a'), (4, 'npm', 'package.json', 'pkgs/b')) v(m, kind, marker, package)"
)


def _repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, path, text: a repository for each supplier, with one of five markers or none."""
    k = F.col("s_suppkey")
    marker = F.when(k % 6 == 0, F.struct(F.lit("pnpm-workspace.yaml").alias("path"), F.lit("packages:\n  - 'pkgs/*'\n  - '!pkgs/old'\n  - '../out/*'\n").alias("text"))).when(k % 6 == 1, F.struct(F.lit("lerna.json").alias("path"), F.lit('{"packages": ["./pkgs/*/"]}').alias("text"))).when(k % 6 == 2, F.struct(F.lit("go.work").alias("path"), F.lit("go 1.22\n\nuse (\n\t./pkgs/a\n\t./pkgs/b // second\n)\n").alias("text"))).when(k % 6 == 3, F.struct(F.lit("Cargo.toml").alias("path"), F.lit('[workspace]\nmembers = ["pkgs/**"]\n').alias("text"))).when(k % 6 == 4, F.struct(F.lit("package.json").alias("path"), F.lit('{"workspaces": {"packages": ["pkgs/?"]}}').alias("text")))
    file = lambda path, body="": F.struct(F.lit(path).alias("path"), (body if isinstance(body, Column) else F.lit(body)).alias("text"))
    every = F.array_compact(F.array(marker, F.when(k % 12 == 0, file("lerna.json", '{"packages": ["other/*"]}')), F.when(k % 12 == 1, file("go.work", "{broken")), file("pkgs/a/package.json", text('{"name": "a', k.cast("string"), '"}')), file("pkgs/b/go.mod"), file("pkgs/old/Cargo.toml"), file("pkgs/deep/x/pyproject.toml"), file("pkgs/node_modules/y/package.json"), file("other/z/package.json"), file("pkgs/none/readme.md")))
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("root"), F.explode(every).alias("f")).select("root", "f.*")


@query(
    f"SELECT s_name AS root, kind, marker, package, package || '/' || CASE package WHEN 'pkgs/a' THEN 'package.json' WHEN 'pkgs/b' THEN 'go.mod' WHEN 'pkgs/old' THEN 'Cargo.toml' ELSE 'pyproject.toml' END AS manifest, CASE package WHEN 'pkgs/a' THEN 'a' || s_suppkey ELSE '' END AS name, "
    f"CASE package WHEN 'pkgs/a' THEN 'npm' WHEN 'pkgs/b' THEN 'gomod' WHEN 'pkgs/old' THEN 'cargo' ELSE 'python' END AS ecosystem FROM supplier JOIN {SHAPES} ON m = s_suppkey % 6"
)
def workspace_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.detect(_repositories(spark, sf_dir))


@query(
    "SELECT package, array_to_string(list_sort(list(DISTINCT id)), ' ') AS risks FROM (SELECT p_brand AS package, 'r' || p_partkey AS id FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT DISTINCT p_brand, 'r' || p_partkey FROM part WHERE p_partkey % 4 = 3) GROUP BY 1"
)
def attributed_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks whose subject is a file below a brand's folder; identifiers and foreign paths belong to none."""
    own, p = table(spark, sf_dir, "part"), F.col("p_partkey")
    subject = F.when(p % 4 == 0, text(F.col("p_brand"), "/src/a.py")).when(p % 4 == 1, F.col("p_brand")).when(p % 4 == 2, text("https://", F.col("p_brand"), "/x.py")).otherwise(text(F.col("p_brand"), "/.x.yml"))
    found = workspace.attribute_risks(own.select(text("r", p.cast("string")).alias("id"), subject.alias("subject")), own.select(F.col("p_brand").alias("path")).distinct())
    return found.withColumn("risks", F.array_join("risks", " "))


# WIN-06, FN-15/16/21/22, PRJ-27/28/30, SET-01, SETUP: words and settings ---------------------------------------------------------------

SHOTS = "sh AS (SELECT o_orderpriority AS root, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS id, count(*) AS n, count(DISTINCT o_custkey) AS c, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1, 2)"


@query(
    f"WITH {SHOTS}, m AS (SELECT root, id, n - lag(n) OVER w AS dn, c - lag(c) OVER w AS dc, f - lag(f) OVER w AS df, n % 4 - lag(n % 4) OVER w AS dh, id % 5 = 0 AS drift, lag(id % 5 = 0) OVER w AS was, n % 3 - lag(n % 3) OVER w AS dt FROM sh WINDOW w AS (PARTITION BY root ORDER BY id)) "
    "SELECT root, id, CASE WHEN dn IS NULL THEN NULL ELSE coalesce(nullif(array_to_string(list_filter([CASE WHEN dn > 0 THEN '⚠ Complexity increased' WHEN dn < 0 THEN '✓ Complexity decreased' END, CASE WHEN dc > 5 THEN '⚠ Avg file size +' || dc || ' LOC' END, CASE WHEN dh > 0 THEN '⚠ ' || dh || ' new confirmed hotspot(s)' WHEN dh < 0 THEN '✓ ' || (-dh) || ' hotspot(s) resolved' END, "
    "CASE WHEN dc > 0 AND dt = 0 THEN '⚠ ' || dc || ' new file(s) with no tests' END, CASE WHEN df > 0 THEN '⚠ ' || df || ' new risk(s)' END, CASE WHEN drift AND NOT was THEN '⚠ Dependency drift introduced' WHEN NOT drift AND was THEN '✓ Dependency drift resolved' END], lambda x: x IS NOT NULL), ', '), ''), 'no notable change') END AS note FROM m"
)
def movement_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint")
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("root"), month.alias("id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("c"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    shots = own.select("root", "id", F.lit(50.0).alias("score"), F.col("n").cast("double").alias("avg_complexity"), F.col("c").cast("double").alias("avg_file_lines"), (F.col("n") % 4).alias("confirmed_hotspots"), F.col("c").alias("source_files"), (F.col("n") % 3).alias("test_files"), F.col("f").alias("risk_count"), (F.col("id") % 5 == 0).alias("dependency_drift"))
    return history.movement(shots).select("root", "id", "note")


@query(
    "WITH x AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS sha, (o_custkey % 41 - 20) / 4::DOUBLE AS d, o_custkey % 200 AS a FROM orders) SELECT o_orderkey, sha[1:12] AS short, "
    "CASE WHEN d > 0 THEN '+' WHEN d < 0 THEN '-' ELSE '' END || CASE WHEN round(abs(d) * 10) % 10 = 0 THEN (round(abs(d) * 10) // 10)::BIGINT::VARCHAR ELSE printf('%.1f', round(abs(d) * 10) / 10) END AS moved, "
    "CASE WHEN a > 150 THEN 'files too large' WHEN a < 25 THEN 'files too fragmented' ELSE 'in band' END AS size, CASE o_orderkey % 3 WHEN 0 THEN 40 ELSE 50 END AS many, o_orderkey % 4 = 0 AS is_path, o_orderkey % 2 = 0 AS pruned, "
    "printf('Direct deps: %d -> %d (%+.1f) LOC', a, a + 3, 3.0::DOUBLE) AS line FROM x"
)
def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    moved, avg = (F.col("o_custkey") % 41 - 20) / F.lit(4.0), F.col("o_custkey") % 200
    subject = F.when(k % 4 == 0, "a/b.c/d.py").when(k % 4 == 1, "@scope/pkg").when(k % 4 == 2, "C:/x.py").otherwise("/etc/x.conf")
    name = F.when(k % 4 == 0, ".hidden").when(k % 4 == 2, "node_modules").otherwise("src")
    return own.select(
        "o_orderkey", words.short_sha(F.md5(k.cast("string").cast("binary"))).alias("short"), words.signed(moved).alias("moved"), words.size_verdict(avg).alias("size"),
        words.many_direct(F.when(k % 3 == 0, "python").otherwise("npm")).alias("many"), words.looks_like_path(subject).alias("is_path"), words.is_pruned(name, "packages").alias("pruned"),
        words.delta_line(F.lit("Direct deps"), avg.cast("double"), (avg + 3).cast("double"), F.lit(3.0), F.lit("LOC"), F.lit(0)).alias("line"),
    )


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ts WHEN 2 THEN date_trunc('second', ts) ELSE ts END AS at FROM events")
def span_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, n = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_id") % 4
    written = F.when(n == 0, "no time").when(n == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(n == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+0000'")).otherwise(F.concat(F.unix_micros("ts").cast("string"), F.lit("000")))
    return own.select("event_id", words.otel_time(written).alias("at"))


@query("SELECT CASE WHEN c IN ('code', 'complexity', 'testing') THEN 'new' ELSE 'old' END AS age, c AS category, count(*) AS n FROM (SELECT CASE p_size % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'complexity' WHEN 2 THEN 'testing' WHEN 3 THEN 'git' ELSE 'dependency' END AS c FROM part) GROUP BY ALL")
def refreshed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") % 5
    kind = F.when(s == 0, "code").when(s == 1, "complexity").when(s == 2, "testing").when(s == 3, "git").otherwise("dependency")
    own = table(spark, sf_dir, "part").select(kind.alias("category"))
    again = own.filter(F.col("category").isin("code", "complexity", "testing")).withColumn("age", F.lit("new"))
    return risks.refreshed(own.withColumn("age", F.lit("old")), again).groupBy("age", "category").agg(F.count(F.lit(1)).alias("n"))


@query("WITH f AS (SELECT CASE p_size % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity, CASE p_size % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS sr, p_name AS title, p_partkey::VARCHAR AS subject FROM part) SELECT severity, title, subject, row_number() OVER (ORDER BY sr DESC, title, subject) AS place FROM f ORDER BY place LIMIT 150")
def findings_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") % 5
    severity = F.when(s == 0, "critical").when(s == 1, "high").when(s == 2, "medium").when(s == 3, "low").otherwise("info")
    own = risks.ordered_findings(table(spark, sf_dir, "part").select(severity.alias("severity"), F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("subject"))).limit(150)
    return own.withColumn("place", F.row_number().over(Window.orderBy(F.desc(pred.severity_rank("severity")), "title", "subject")).cast("bigint"))


@query(
    "WITH a AS (SELECT o_custkey::VARCHAR AS root, min(o_orderdate) AS first, count(*) AS n FROM orders GROUP BY 1), d AS (SELECT root, n, trunc((epoch_us(TIMESTAMP '1995-06-01') - epoch_us(first)) / 86400000000::DOUBLE) AS age FROM a) "
    "SELECT root, 'ignore_dirs' AS key, CASE WHEN n % 2 = 0 THEN '.git,dist,node_modules,vendor' ELSE '.git,node_modules,vendor' END AS value FROM d UNION ALL SELECT root, 'git_window_days', CASE WHEN greatest(age, 0) < 30 THEN '7' WHEN age < 90 THEN '30' WHEN age < 365 THEN '90' ELSE '180' END FROM d "
    "UNION ALL SELECT root, 'timeout_seconds', greatest(60, (n * 4000 + 9999) // 10000 * 10)::BIGINT::VARCHAR FROM d UNION ALL SELECT root, 'detect_workspace', 'true' FROM d WHERE n % 3 > 0"
)
def proposed_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("root")).agg(F.min("o_orderdate").alias("first_commit"), F.count(F.lit(1)).alias("n"))
    folders = own.filter("n % 2 = 0").select("root", F.explode(F.array(F.lit("dist"), F.lit("src"), F.lit("vendor"))).alias("name"))
    return setup.propose(own.select("root", "first_commit", (F.col("n") * 1000).alias("took_ms"), (F.col("n") % 3).alias("packages")), folders, "1995-06-01 00:00:00")
