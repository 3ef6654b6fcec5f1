"""Readers that turn repository text into fact tables.

All of them read through Spark's own sources, prune before they open files, and parse in
columns; only manifests that need a real parser leave the JVM, in Arrow batches.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from repolytics.functions.numeric import col, once
from repolytics.functions.predicates import boundary_of, language_of, normal_route, python_requirement
from repolytics.functions.text import in_pruned, otel_time
from repolytics.operators.code import IGNORED_DIRS, MAX_FILE_BYTES


def source_files(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES, ignored: tuple[str, ...] = IGNORED_DIRS) -> DataFrame:
    """path (relative), language, bytes, mtime, content of the source files below a folder.

    Size and extension are filtered before content is read; names of ignored folders
    prune at any depth.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z]+:/+", "/", root.rstrip("/"))
    path = F.substring(F.regexp_replace("path", r"^[a-z]+:/+", "/"), len(base) + 2, 1 << 20)
    named = every.withColumn("path", path).withColumn("language", language_of("path"))
    outside = ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, ignored)))
    kept = named.filter((F.col("length") <= max_bytes) & F.col("language").isNotNull() & outside)
    return kept.select("path", "language", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"))


def scan_gaps(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES, ignored: tuple[str, ...] = IGNORED_DIRS) -> DataFrame:
    """One row: truncated (source files above the size cap) and skipped (files that are no UTF-8 text)."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z]+:/+", "/", root.rstrip("/"))
    named = every.withColumn("path", F.substring(F.regexp_replace("path", r"^[a-z]+:/+", "/"), len(base) + 2, 1 << 20))
    outside = ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, ignored)))
    kept = named.filter(language_of("path").isNotNull() & outside)
    read = F.when(F.col("length") <= max_bytes, F.is_valid_utf8(F.col("content").cast("string")))
    return kept.agg(F.count_if(F.col("length") > max_bytes).alias("truncated"), F.count_if(~read).alias("skipped"))


def numstat(lines: DataFrame, keep_binary: bool = False, value: str = "value") -> DataFrame:
    """lines with path, added, deleted of `added<TAB>deleted<TAB>path`; binary rows have null counts."""
    parts = F.split(F.col(value), "\t", 3)
    named = lines.filter(F.size(parts) == 3).withColumns({"added": F.expr(f"try_cast(split({value}, '\\t', 3)[0] as bigint)"), "deleted": F.expr(f"try_cast(split({value}, '\\t', 3)[1] as bigint)"), "path": parts[2]})
    return named if keep_binary else named.filter("added is not null and deleted is not null")


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """commit, author, email, at, path, added, deleted from `git log --numstat` text.

    The log is written with --format='%x1e%H%x1f%an%x1f%ae%x1f%aI%x1f%P': a record for each
    commit, which is the line separator of the reader, so commits are split in parallel.
    """
    return log_records(spark.read.text(path, lineSep="\x1e"))


def log_heads(records: DataFrame, value: str = "value") -> DataFrame:
    """commit, author, email, at, merge of every record of a log; a commit of two parents or more is a merge."""
    head = F.split(F.substring_index(F.col(value), "\n", 1), "\x1f")
    parents = F.split(F.trim(F.coalesce(F.try_element_at(head, F.lit(5)), F.lit(""))), " ")
    return records.filter(F.col(value) != "").select(head[0].alias("commit"), head[1].alias("author"), head[2].alias("email"), F.try_to_timestamp(head[3]).alias("at"), (F.size(parents) > 1).alias("merge"))


def access_log(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """route, status, micros, at of lines of the combined log; null route where a line does not parse."""
    v = F.col(value)
    request = r'"([A-Z]+) (\S+)[^"]*" (\d{3}) (\S+)'
    stamp = F.regexp_extract(v, r"\[([^\]]+)\]", 1)
    at = F.coalesce(F.try_to_timestamp(stamp, F.lit("dd/MMM/yyyy:HH:mm:ss Z")), F.try_to_timestamp(stamp))
    found = v.rlike(request)
    micros = F.expr(f"try_cast(regexp_extract({value}, ' ([0-9]+)$', 1) as bigint)")
    return lines.select(*keep, F.when(found, normal_route(F.regexp_extract(v, request, 2))).alias("route"), F.when(found, F.regexp_extract(v, request, 3).cast("int")).alias("status"), F.when(found, micros).alias("micros"), F.when(found, at).alias("at"))


_OTEL_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_OTEL_CODE = "struct<function:struct<name:string,namespace:string>,filepath:string>"
_OTEL_SPAN = f"struct<name:string,startTimeUnixNano:string,endTimeUnixNano:string,start_time:string,end_time:string,startTime:string,endTime:string,durationNanos:bigint,duration_nanos:bigint,code:{_OTEL_CODE},attributes:string>"
_OTEL_FILE = f"struct<resourceSpans:array<struct<resource:struct<attributes:string>,scopeSpans:array<struct<spans:array<{_OTEL_SPAN}>>>,spans:array<{_OTEL_SPAN}>>>,spans:array<{_OTEL_SPAN}>>"


def attributes(text: Column) -> Column:
    """A map of an OTLP attribute list (key, typed value) or of a plain object, given as JSON; null where it is neither."""
    listed = F.from_json(text, f"array<struct<key:string,value:{_OTEL_VALUE}>>")
    value = lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string"), F.lit(""))
    keys = F.transform(listed, lambda a: a["key"])
    pairs = F.transform(listed, lambda a: F.struct(a["key"].alias("key"), value(a).alias("value")))
    distinct = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.when(F.ltrim(text).startswith("["), F.map_from_entries(distinct)).otherwise(F.from_json(text, "map<string,string>"))


def otel_spans(docs: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """function, file, latency_ns, timed, started, ended, resource of the spans of OTLP JSON texts.

    A text is an object of resourceSpans (with scopeSpans or spans), an object of spans or
    a bare array of spans; attributes are a list of typed values or a plain object.  Only
    a named source function attributes a span; others have null there and still count.
    A span that tells no time (timed is false) has no latency, which is 0 too.
    """
    text = F.ltrim(F.col(value))
    file = F.from_json(F.when(text.startswith("["), F.concat(F.lit('{"spans":'), text, F.lit("}"))).otherwise(text), _OTEL_FILE)
    none = F.array().cast(f"array<{_OTEL_SPAN}>")
    nested = F.flatten(F.transform(F.coalesce(file["resourceSpans"], F.array().cast(f"array<struct<resource:struct<attributes:string>,scopeSpans:array<struct<spans:array<{_OTEL_SPAN}>>>,spans:array<{_OTEL_SPAN}>>>")), lambda r: F.concat(F.coalesce(F.flatten(F.transform(r["scopeSpans"], lambda s: F.coalesce(s["spans"], none))), none), F.coalesce(r["spans"], none))))
    spans = docs.select(*keep, F.get(file["resourceSpans"], F.lit(0))["resource"]["attributes"].alias("resource"), F.explode(F.when(F.size(nested) > 0, nested).otherwise(F.coalesce(file["spans"], none))).alias("x")).select(*keep, "resource", "x.*")
    own = spans.withColumn("own", attributes(F.col("attributes")))
    at = lambda *names: F.coalesce(*[otel_time(n) for n in names])
    start, end = at("startTimeUnixNano", "startTime", "start_time"), at("endTimeUnixNano", "endTime", "end_time")
    nanos = F.expr("try_cast(endTimeUnixNano as bigint) - try_cast(startTimeUnixNano as bigint)")
    took = F.coalesce(F.nullif("durationNanos", F.lit(0)), F.nullif("duration_nanos", F.lit(0)), nanos, (F.unix_micros(end) - F.unix_micros(start)) * 1000)
    timed = F.coalesce(took, "durationNanos", "duration_nanos").isNotNull()
    name = F.coalesce(F.trim("code.function.name"), F.try_element_at("own", F.lit("code.function.name")))
    place = F.coalesce("code.filepath", F.try_element_at("own", F.lit("code.file.path")), F.try_element_at("own", F.lit("code.filepath")))
    return own.select(*keep, F.nullif(name, F.lit("")).alias("function"), place.alias("file"), F.greatest(F.coalesce(took, F.lit(0)), F.lit(0)).cast("bigint").alias("latency_ns"), timed.alias("timed"), start.alias("started"), end.alias("ended"), attributes(F.col("resource")).alias("resource"))


def npm_manifest(text) -> Column:
    """struct(direct, dev, packages) of a package.json."""
    m = F.from_json(col(text), "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>")
    keys = lambda m, name: F.coalesce(F.map_keys(m[name]), F.array().cast("array<string>"))
    direct = lambda m: F.size(keys(m, "dependencies")) + F.size(keys(m, "peerDependencies")) + F.size(keys(m, "optionalDependencies"))
    dev = lambda m: F.size(F.array_except(keys(m, "devDependencies"), keys(m, "dependencies")))
    return once(m, lambda m: F.struct(direct(m).cast("bigint").alias("direct"), dev(m).cast("bigint").alias("dev"), F.slice(F.array_sort(keys(m, "dependencies")), 1, 50).alias("packages")))


def npm_lock_count(text) -> Column:
    m = F.from_json(col(text), "packages map<string,struct<version:string>>, dependencies map<string,struct<version:string>>")
    packages = lambda m: F.size(F.map_filter(m["packages"], lambda k, v: k != ""))
    return once(m, lambda m: F.coalesce(F.when(m["packages"].isNotNull(), packages(m)), F.size(m["dependencies"]), F.lit(0)).cast("bigint"))


def pipenv_lock_count(text) -> Column:
    m = F.from_json(col(text), "default map<string,struct<version:string>>, develop map<string,struct<version:string>>")
    n = lambda m, name: F.coalesce(F.when(m[name].isNotNull(), F.size(m[name])), F.lit(0))
    return once(m, lambda m: (n(m, "default") + n(m, "develop")).cast("bigint"))


def _lines(text) -> Column:
    return F.split(F.translate(col(text), "\r", ""), "\n")


def poetry_lock_count(text) -> Column:
    return F.size(F.filter(_lines(text), lambda x: F.trim(x) == "[[package]]")).cast("bigint")


def yarn_lock_count(text) -> Column:
    return F.size(F.filter(_lines(text), lambda x: x.rlike(r"^[^ \t#].*:\s*$"))).cast("bigint")


def go_sum_count(text) -> Column:
    return F.size(F.array_distinct(F.filter(F.transform(_lines(text), lambda x: F.split(F.trim(x), r"\s+")[0]), lambda x: x != ""))).cast("bigint")


def pnpm_lock_count(text) -> Column:
    """Indented lines that end in a colon below packages: or snapshots:."""
    counted = F.aggregate(
        _lines(text), F.struct(F.lit(False).alias("on"), F.lit(0).cast("bigint").alias("n")),
        lambda s, x: F.struct(
            F.when(x.rlike(r"^\S"), x.rlike(r"^(packages|snapshots):\s*$")).otherwise(s["on"]).alias("on"),
            (s["n"] + (s["on"] & x.rlike(r"^\s+\S.*:\s*$")).cast("bigint")).alias("n"),
        ),
    )
    return counted["n"]


def go_mod(text) -> Column:
    """struct(direct, indirect) of a go.mod's requirements."""
    inside = F.regexp_extract_all(col(text), F.lit(r"(?s)require\s*\(([^)]*)\)"), 1)
    single = F.regexp_extract_all(col(text), F.lit(r"(?m)^\s*require\s+([^(\s].*)$"), 1)
    lines = F.filter(F.concat(F.flatten(F.transform(inside, lambda b: F.split(b, "\n"))), single), lambda x: F.trim(F.regexp_replace(x, "//.*$", "")) != "")
    n = lambda found: F.size(F.filter(found, lambda x: x.rlike(r"//.*\bindirect\b"))).cast("bigint")
    return once(lines, lambda x: once(n(x), lambda n: F.struct((F.size(x) - n).cast("bigint").alias("direct"), n.alias("indirect"))))


def requirements(text) -> Column:
    """Sorted distinct names a requirements.txt asks for."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(_lines(text), lambda x: python_requirement(x)), lambda x: x.isNotNull())))


def _toml(batches):
    import tomllib

    name = lambda s: re.sub(r"[_.]", "-", re.match(r"[A-Za-z0-9._-]*", s.strip())[0].lower()).strip("-")
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            direct, dev = set(), set()
            try:
                doc = tomllib.loads(text or "")
            except (tomllib.TOMLDecodeError, TypeError):
                doc = {}
            project = doc.get("project", {})
            direct |= {name(x) for x in project.get("dependencies", []) if isinstance(x, str)}
            dev |= {name(x) for group in project.get("optional-dependencies", {}).values() for x in group if isinstance(x, str)}
            dev |= {name(x) for group in doc.get("dependency-groups", {}).values() for x in group if isinstance(x, str)}
            poetry = doc.get("tool", {}).get("poetry", {})
            direct |= {name(x) for x in poetry.get("dependencies", {}) if x != "python"}
            dev |= {name(x) for x in poetry.get("dev-dependencies", {})} | {name(x) for g in poetry.get("group", {}).values() for x in g.get("dependencies", {})}
            rows.append((len(direct - dev), len(dev), sorted((direct | dev) - {""})))
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.string()))], ["dir", "direct", "dev", "packages"])


def pyproject(manifests: DataFrame) -> DataFrame:
    """dir, direct, dev, packages of pyproject.toml files (dir, text)."""
    return manifests.select("dir", "text").mapInArrow(_toml, "dir string, direct bigint, dev bigint, packages array<string>")


def ecosystems(manifests: DataFrame) -> DataFrame:
    """dir, name, manifest, lockfile, drift, stale from rows of manifest files (dir, file, mtime).

    The first manifest and the first lock file of each ecosystem count; a lock more than
    a second older than its manifest is stale.
    """
    rules = [("npm", "package.json", "m", 0), ("npm", "package-lock.json", "l", 0), ("npm", "pnpm-lock.yaml", "l", 1), ("npm", "yarn.lock", "l", 2), ("go", "go.mod", "m", 0), ("go", "go.sum", "l", 0), ("python", "pyproject.toml", "m", 0), ("python", "requirements.txt", "m", 1), ("python", "poetry.lock", "l", 0), ("python", "uv.lock", "l", 1), ("python", "Pipfile.lock", "l", 2)]
    known = manifests.sparkSession.createDataFrame(rules, "name string, file string, kind string, priority int")
    named = manifests.join(F.broadcast(known), "file")
    pick = lambda kind, field: F.min_by(F.when(F.col("kind") == kind, F.col(field)), F.when(F.col("kind") == kind, F.col("priority")))
    found = named.groupBy("dir", "name").agg(pick("m", "file").alias("manifest"), pick("l", "file").alias("lockfile"), pick("m", "mtime").alias("manifest_at"), pick("l", "mtime").alias("lock_at")).filter("manifest is not null")
    stale = F.coalesce(F.unix_micros("manifest_at") > F.unix_micros("lock_at") + 1_000_000, F.lit(False))
    return found.select("dir", "name", "manifest", "lockfile", F.col("lockfile").isNull().alias("drift"), stale.alias("stale"))


def dependency_stats(files: DataFrame) -> DataFrame:
    """dir, name, manifest, lockfile, direct, dev, indirect, total, transitive, drift, stale of every ecosystem.

    files: dir, file, mtime, text of manifests and lock files.
    """
    found = ecosystems(files.select("dir", "file", "mtime"))
    texts = lambda prefix: files.select(F.col("dir").alias(f"{prefix}_dir"), F.col("file").alias(prefix), F.col("text").alias(f"{prefix}_text"))
    own = found.join(texts("m"), (F.col("dir") == F.col("m_dir")) & (F.col("manifest") == F.col("m")), "left").join(texts("l"), (F.col("dir") == F.col("l_dir")) & (F.col("lockfile") == F.col("l")), "left")
    toml = pyproject(files.filter("file = 'pyproject.toml'").select("dir", "text")).select(F.col("dir").alias("p_dir"), F.col("direct").alias("p_direct"), F.col("dev").alias("p_dev"))
    own = own.join(toml, (F.col("dir") == F.col("p_dir")) & (F.col("manifest") == "pyproject.toml"), "left")
    zero = F.lit(0).cast("bigint")
    npm, go = npm_manifest("m_text"), go_mod("m_text")
    by = lambda *cases: F.coalesce(*[F.when(F.col("manifest") == name, value) for name, value in cases], zero).cast("bigint")
    locks = {"package-lock.json": npm_lock_count, "pnpm-lock.yaml": pnpm_lock_count, "yarn.lock": yarn_lock_count, "go.sum": go_sum_count, "poetry.lock": poetry_lock_count, "uv.lock": poetry_lock_count, "Pipfile.lock": pipenv_lock_count}
    counted = own.select(
        "dir", "name", "manifest", "lockfile",
        by(("package.json", npm["direct"]), ("go.mod", go["direct"]), ("requirements.txt", F.size(requirements("m_text"))), ("pyproject.toml", F.col("p_direct"))).alias("direct"),
        by(("package.json", npm["dev"]), ("pyproject.toml", F.col("p_dev"))).alias("dev"), by(("go.mod", go["indirect"])).alias("indirect"),
        F.coalesce(*[F.when(F.col("lockfile") == name, count("l_text")) for name, count in locks.items()], zero).cast("bigint").alias("transitive"), "drift", "stale",
    )
    return counted.withColumn("total", F.col("direct") + F.col("dev") + F.col("indirect"))


def manifest_files(spark: SparkSession, root: str) -> DataFrame:
    """dir (relative; empty at the root), file, mtime, text of the manifests and lock files below a folder."""
    names = ("package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "go.mod", "go.sum", "pyproject.toml", "requirements.txt", "poetry.lock", "uv.lock", "Pipfile.lock")
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z]+:/+", "/", root.rstrip("/"))
    path = F.substring(F.regexp_replace("path", r"^[a-z]+:/+", "/"), len(base) + 2, 1 << 20)
    named = every.withColumn("rel", path).withColumn("file", F.element_at(F.split("rel", "/"), -1)).filter(F.col("file").isin(*names))
    outside = ~F.arrays_overlap(F.split("rel", "/"), F.array(*map(F.lit, IGNORED_DIRS)))
    return named.filter(outside).select(F.regexp_extract("rel", "^(.*)/[^/]*$", 1).alias("dir"), "file", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"))


def text_files(spark: SparkSession, root: str, names: tuple[str, ...]) -> DataFrame:
    """path (relative), text of the files of these names below a folder."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z]+:/+", "/", root.rstrip("/"))
    named = every.select(F.substring(F.regexp_replace("path", r"^[a-z]+:/+", "/"), len(base) + 2, 1 << 20).alias("path"), "content")
    return named.filter(F.element_at(F.split("path", "/"), -1).isin(*names)).select("path", F.decode("content", "UTF-8").alias("text"))


def module_of(spark: SparkSession, root: str) -> str:
    """The module a root go.mod declares; empty without one."""
    row = text_files(spark, root, ("go.mod",)).filter("path = 'go.mod'").select(F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1)).first()
    return row[0] if row else ""


def go_packages(files: DataFrame, module: str) -> DataFrame:
    """package, boundary, files of Go files (path): a package's boundary is the first part of its folder.

    Folders without sources of the repository's own do not count.
    """
    files = files.filter(~in_pruned("path", "imports"))
    package = F.regexp_replace(F.concat_ws("/", F.lit(module), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), "/$", "")
    return files.groupBy(package.alias("package"), boundary_of("path").alias("boundary")).agg(F.count(F.lit(1)).alias("files"))


def go_imports(files: DataFrame, module: str) -> DataFrame:
    """src, dst: imports between packages, from the text of Go files (path, content) outside pruned folders."""
    files = files.filter(~in_pruned("path", "imports"))
    block = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(r"(?ms)^import\s*\(([^)]*)\)"), 1), lambda b: F.regexp_extract_all(b, F.lit(r'"([^"]+)"'), 1)))
    single = F.regexp_extract_all("content", F.lit(r'(?m)^import\s+(?:[\w.]+\s+)?"([^"]+)"'), 1)
    package = F.regexp_replace(F.concat_ws("/", F.lit(module), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), "/$", "")
    return files.select(package.alias("src"), F.explode(F.array_distinct(F.concat(block, single))).alias("dst")).distinct()


def absent_path(error: Exception) -> bool:
    """Whether a read failed because there is nothing at the path."""
    return any(mark in str(error) for mark in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "does not exist"))


def log_records(records: DataFrame, value: str = "value") -> DataFrame:
    """commit, author, email, at, path, added, deleted from records of a log (value); null counts: a binary change."""
    lines = F.split(value, "\n")
    head = F.split(lines[0], "\x1f")
    changes = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), lambda x: x.contains("\t"))
    commits = records.filter(F.col(value) != "").select(head[0].alias("commit"), head[1].alias("author"), head[2].alias("email"), F.try_to_timestamp(head[3]).alias("at"), F.explode(changes).alias("change"))
    return numstat(commits, keep_binary=True, value="change").drop("change")


def commits(parsed: DataFrame, since: str | None = None, limit: int | None = None) -> DataFrame:
    """commit, author, email, at, files (sorted, distinct), added, deleted of parsed changes.

    Counts are -1 where a commit has binary changes alone.  since leaves out what is
    older, limit keeps the newest.
    """
    own = parsed if since is None else parsed.filter(F.col("at") >= F.lit(since).cast("timestamp"))
    sums = own.groupBy("commit", "author", "email", "at").agg(F.array_sort(F.collect_set("path")).alias("files"), F.coalesce(F.sum("added"), F.lit(-1)).cast("bigint").alias("added"), F.coalesce(F.sum("deleted"), F.lit(-1)).cast("bigint").alias("deleted"))
    return sums if limit is None else sums.orderBy(F.desc("at"), "commit").limit(limit)


def pending_changes(changed: DataFrame, untracked: DataFrame, value: str = "value") -> DataFrame:
    """path: what differs from the last commit, from the lines of a diff's and of untracked names, each once, in order."""
    names = changed.select(F.trim(F.col(value)).alias("path")).union(untracked.select(F.trim(F.col(value)).alias("path")))
    return names.filter("path <> ''").distinct().orderBy("path")


def pull_request_event(text) -> Column:
    """struct(action, repository, is_pull_request, number, base_ref, base_sha, head_ref, head_sha) of an event's JSON; null where it does not parse."""
    side = "struct<ref:string,sha:string>"
    event = F.from_json(col(text), f"action string, number bigint, repository struct<full_name:string>, pull_request struct<number:bigint,base:{side},head:{side}>")
    pull = event["pull_request"]
    number = F.coalesce(F.nullif(pull["number"], F.lit(0)), event["number"])
    return F.struct(
        event["action"].alias("action"), event["repository"]["full_name"].alias("repository"), pull.isNotNull().alias("is_pull_request"), F.when(pull.isNotNull(), number).alias("number"),
        pull["base"]["ref"].alias("base_ref"), pull["base"]["sha"].alias("base_sha"), pull["head"]["ref"].alias("head_ref"), pull["head"]["sha"].alias("head_sha"),
    )
