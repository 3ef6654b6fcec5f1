"""Source structure: lines, lexical complexity, language breakdown, hotspots.

measure() and branch_count() leave the JVM: a block comment's state crosses lines, so a
file is scanned in order, in Arrow batches, and branch words are counted by Arrow's own
search, which takes a fraction of the time of lists of words.  Everything else is columns.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from repolytics.functions.numeric import ratio, round2
from repolytics.functions.predicates import complexity_level, has_control_flow, is_test_path
from repolytics.functions.text import hotspot_reason

# Words that open a unit or branch, and how languages mark comments.
DEFINITION_WORDS = (
    "func", "fn", "def", "function", "sub", "proc", "method", "class", "impl", "trait", "interface",
    "async", "export", "public", "private", "protected", "static", "override", "abstract", "defp", "deff",
)
BRANCH_WORDS = ("if", "elif", "elsif", "for", "while", "case", "catch", "select", "match", "except", "unless", "rescue", "when", "loop")
BRANCH_MARKS = ("&&", "||")
C_LIKE = "Go C C++ C# Java JavaScript TypeScript Rust Zig Swift Kotlin Scala".split()
LINE_COMMENTS = {x: ("//",) for x in C_LIKE} | {"PHP": ("//", "#"), "Ruby": ("#",), "Python": ("#",), "Shell": ("#",), "YAML": ("#",), "SQL": ("--",), "Lua": ("--",)}
BLOCK_COMMENTS = {x: ("/*", "*/") for x in [*C_LIKE, "PHP", "SQL"]} | {"Ruby": ("=begin", "=end"), "Lua": ("--[[", "]]")}
QUOTES = {x: "\"'`" for x in ("Go", "JavaScript", "TypeScript", "Shell")} | {x: '"' for x in ("C#", "Java", "Swift", "Kotlin")}
MAX_FILE_BYTES = 2 << 20
IGNORED_DIRS = (
    ".git", ".hg", ".svn", ".idea", ".vscode", "node_modules", "vendor", "dist", "build", "out", "target",
    "coverage", ".next", ".nuxt", ".cache", ".venv", "venv", "__pycache__", ".terraform", ".gradle", "bin", "obj",
    "assets", "public", "static",
)

_BRANCHES = frozenset(BRANCH_WORDS)
_WORD = re.compile(r"[A-Za-z0-9_]+")
_BRACES = re.compile(r"[{}]")
_FIRST = re.compile(r"[ \t]*([A-Za-z0-9_]*)")


@lru_cache
def _strings(quotes: str) -> re.Pattern:
    return re.compile("|".join(rf"{q}((?:\\.|[^{q}\\])*)({q}|\\?$)" for q in quotes), re.S)


def blank_strings(line: str, quotes: str) -> str:
    """A line with what stands between quotes blanked; an open quote blanks to the end."""
    if not any(q in line for q in quotes):
        return line
    pattern = _strings(quotes)

    def blank(found: re.Match) -> str:
        k = next(i for i in range(1, found.re.groups, 2) if found[i] is not None)
        inside = len(re.sub(r"\\.", "x", found[k], flags=re.S))
        return found[0][0] + " " * inside + found[k + 1]

    return pattern.sub(blank, line)


def strip_line(raw: str, language: str, in_block: bool) -> tuple[str, bool, bool]:
    """(code, skip, in_block) of a line: comments cut, blank and comment lines skipped.

    A block comment opens only at the start of what is left of a line; what follows its
    end on a later line is code, its strings blanked, comments in it not looked for.
    """
    start, end = BLOCK_COMMENTS.get(language, ("", ""))
    line = raw.strip()
    if in_block:
        at = line.find(end)
        if at < 0:
            return "", True, True
        rest = blank_strings(line[at + len(end) :].strip(), QUOTES.get(language, "\"'"))
        return rest, rest == "", False
    line = blank_strings(line, QUOTES.get(language, "\"'"))
    for mark in LINE_COMMENTS.get(language, ()):
        at = line.find(mark)
        if at >= 0:
            line = line[:at]
    line = line.strip()
    if start and line.startswith(start):
        return "", True, end not in line[len(start) :]
    return line, line == "", False


def branches(line: str) -> int:
    words = sum(w.lower() in _BRANCHES for w in _WORD.findall(line))
    return words + sum(line.count(mark) for mark in BRANCH_MARKS)


def defines(line: str) -> bool:
    return _FIRST.match(line)[1].lower() in DEFINITION_WORDS


def scan(text: str, language: str, scored: bool = True) -> dict:
    """Line counts and complexity counters of one file."""
    out = {"total_lines": 0, "code_lines": 0, "functions": 0, "branch_points": 0, "max_function_branches": 0, "max_nesting": 0}
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    in_block, depth, current = False, 0, 0
    for raw in lines:
        out["total_lines"] += 1
        line, skip, in_block = strip_line(raw, language, in_block)
        if skip:
            continue
        out["code_lines"] += 1
        if not scored:
            continue
        if defines(line):
            out["max_function_branches"] = max(out["max_function_branches"], current)
            out["functions"] += 1
            current = 0
        n = branches(line)
        out["branch_points"] += n
        current += n
        for c in _BRACES.findall(line):
            if c == "{":
                depth += 1
                out["max_nesting"] = max(out["max_nesting"], depth)
            else:
                depth = max(0, depth - 1)
    out["max_function_branches"] = max(out["max_function_branches"], current)
    return out


_COUNTS = ("total_lines", "code_lines", "functions", "branch_points", "max_function_branches", "max_nesting")


def _scan(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = [scan(t or "", lang or "") for lang, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[k] for r in rows], pa.int64()) for k in _COUNTS)], ["path", "language", *_COUNTS])


def estimates(counts: DataFrame) -> DataFrame:
    """counts with complexity (mean per unit), its level, the worst unit and density."""
    units = F.greatest(F.col("functions"), F.lit(1))
    mean = (F.col("branch_points") + units) / units
    measured = has_control_flow("language")
    return counts.select(
        "*", is_test_path("path").alias("is_test"), F.coalesce(measured, F.lit(False)).alias("complexity_measured"),
        F.when(measured, round2(mean)).otherwise(0.0).alias("complexity"), F.when(measured, complexity_level(mean)).otherwise("").alias("level"),
        F.when(measured, F.col("max_function_branches") + 1).otherwise(0).cast("bigint").alias("max_function_complexity"),
        round2(ratio(F.col("branch_points") * 100, "code_lines")).alias("density"),
    )


def measure(files: DataFrame) -> DataFrame:
    """A record for each file (path, language, content)."""
    counts = files.select("path", "language", "content").mapInArrow(_scan, "path string, language string, " + ", ".join(f"{k} bigint" for k in _COUNTS))
    return estimates(counts)


def line_counts(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """path, language, total_lines, filled_lines: in columns, for languages without block comments."""
    text = F.col(content)
    lines = F.split(text, "\n", -1)
    total = F.size(lines) - F.when(text.endswith("\n") | (text == ""), 1).otherwise(0)  # what follows the last line end is a line where it is not empty
    return files.select("path", "language", *keep, total.cast("bigint").alias("total_lines"), F.size(F.filter(lines, lambda x: x.rlike(r"[^ \t\r\f\x0b]"))).cast("bigint").alias("filled_lines"))


#: Letters in both cases by name, so that only ASCII ones are alike; RE2's \\b is that of [A-Za-z0-9_].
_BRANCH_PATTERN = r"\b(?:" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in BRANCH_WORDS) + r")\b"


def _branch_counts(texts: pa.Array) -> pa.Array:
    found = pc.count_substring_regex(texts, _BRANCH_PATTERN)
    for mark in BRANCH_MARKS:
        found = pc.add(found, pc.count_substring(texts, mark))
    return found.cast(pa.int64())


def branch_count(text: Column) -> Column:
    """Branch words and marks in a text, counted by Arrow's search over whole batches: no list of all words is made."""
    return F.arrow_udf(_branch_counts, LongType())(text)


def worst_files(records: DataFrame, limit: int = 10) -> DataFrame:
    """The measured files of greatest complexity, equal ones in walk order."""
    return records.filter("complexity_measured").orderBy(F.desc("complexity"), F.split("path", "/")).limit(limit)


def languages(records: DataFrame, limit: int = 8) -> DataFrame:
    """language, files, lines, tests; most lines first."""
    sums = records.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("code_lines").cast("bigint").alias("lines"), F.count_if("is_test").alias("tests"))
    return sums.orderBy(F.desc("lines"), "language").limit(limit)


def complexity_summary(records: DataFrame) -> DataFrame:
    """One row over the measured files; the worst file is the first in walk order among equals."""
    seen = records.filter("complexity_measured")
    return seen.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("functions"), F.lit(0)).cast("bigint").alias("functions"), F.coalesce(F.sum("branch_points"), F.lit(0)).cast("bigint").alias("branch_points"),
        round2(F.coalesce(F.avg("complexity"), F.lit(0.0))).alias("avg_complexity"), F.coalesce(F.max("complexity"), F.lit(0.0)).alias("max_complexity"),
        F.coalesce(F.max("max_nesting"), F.lit(0)).cast("bigint").alias("max_nesting"), F.count_if(F.col("level") == "high").alias("high_files"), F.count_if(F.col("level") == "very_high").alias("very_high_files"),
    ).crossJoin(F.broadcast(seen.orderBy(F.desc("complexity"), F.split("path", "/")).limit(1).agg(F.max("path").alias("max_complexity_file"))))


def code_stats(records: DataFrame, by: str | None = None) -> DataFrame:
    """One row (or one for each value of by): files, lines, tests, ratios, languages."""
    keys = [by] if by else []
    sums = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~F.col("is_test")).alias("source_files"), F.count_if("is_test").alias("test_files"),
        F.coalesce(F.sum("total_lines"), F.lit(0)).cast("bigint").alias("total_lines"), F.coalesce(F.sum("code_lines"), F.lit(0)).cast("bigint").alias("code_lines"),
        F.coalesce(F.sum(F.when(F.col("is_test"), F.col("code_lines"))), F.lit(0)).cast("bigint").alias("test_lines"),
        F.coalesce(F.max("code_lines"), F.lit(0)).cast("bigint").alias("largest_file_lines"), F.countDistinct("language").alias("languages"),
    )
    return sums.select(
        *keys, "files", "source_files", "test_files", "total_lines", "code_lines", "test_lines", "largest_file_lines", "languages",
        round2(ratio("code_lines", "files")).alias("avg_file_lines"), round2(ratio("test_files", "source_files")).alias("test_file_ratio"), round2(ratio("test_lines", "code_lines")).alias("test_line_ratio"),
    )


def hotspots(records: DataFrame, churn: DataFrame, threshold: int = 400, limit: int | None = 10, lines: int = 500, changed: int = 30) -> DataFrame:
    """path, language, code_lines, churn, complexity, complexity_measured, level, confirmed, reason of large files.

    Confirmed: at least `lines` long, at least `changed` lines of churn, complexity high
    or worse.  The size filter runs before the join.
    """
    large = records.filter(F.col("code_lines") >= threshold)
    moved = churn.select("path", (F.col("added") + F.col("deleted")).cast("bigint").alias("churn"))
    named = large.join(moved, "path", "left").withColumn("churn", F.coalesce("churn", F.lit(0).cast("bigint")))
    hard = F.col("level").isin("high", "very_high")
    out = named.select("path", "language", "code_lines", "churn", "complexity", "complexity_measured", "level", ((F.col("code_lines") >= lines) & (F.col("churn") >= changed) & hard).alias("confirmed"))
    out = out.withColumn("reason", hotspot_reason(least_lines=lines, least_churn=changed))
    return out if limit is None else out.orderBy(F.desc("confirmed"), F.desc("code_lines"), "path").limit(limit)
