"""Column predicates and classifications over paths, names and scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from repolytics.functions.numeric import col, once

# Names and bounds that decide results, each list in its natural order.
LANGUAGES = {
    "Go": ".go", "C": ".c .h", "C++": ".cc .cpp .cxx .hpp .hh", "C#": ".cs", "Java": ".java",
    "JavaScript": ".js .jsx .mjs .cjs", "TypeScript": ".ts .tsx .mts .cts .vue .svelte",
    "Rust": ".rs", "Zig": ".zig", "Swift": ".swift", "Kotlin": ".kt .kts", "Scala": ".scala .sc", "PHP": ".php",
    "Ruby": ".rb", "Python": ".py .pyi", "Shell": ".sh .bash .zsh", "YAML": ".yml .yaml", "SQL": ".sql", "Lua": ".lua",
}
UNSCORED_LANGUAGES = ("YAML",)
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs", "testing", "e2e")
TEST_SUFFIXES = (
    "_test.go", "_test.py", "_test.rb", "_test.rs", "_test.c", "_test.cc", "_test.java", "test.java", "test.kt", "tests.cs",
    ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".test.mjs", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", ".spec.mjs", "_spec.rb",
)
TEST_PREFIXES = ("test_", "spec_")
SEVERITIES = ("info", "low", "medium", "high", "critical")
COMPLEXITY_BANDS = (("low", 10.0), ("moderate", 20.0), ("high", 50.0))
GRADES = (("A", 90.0), ("B", 80.0), ("C", 70.0), ("D", 60.0))


def extension(path) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def base_name(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def dir_of(path) -> Column:
    """The directory of a path; "." at the root."""
    found = F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)
    return F.when(found == "", F.lit(".")).otherwise(found)


def boundary_of(path) -> Column:
    """The first segment of a path's directory; empty at the root."""
    path = col(path)
    return F.when(F.instr(path, "/") == 0, F.lit("")).otherwise(F.substring_index(path, "/", 1))


def folder_of(path) -> Column:
    """The folder a path is in; `.` at the root."""
    path = col(path)
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def language_of(path) -> Column:
    """The language of a path's extension; null for files that do not count."""
    pairs = [F.lit(x) for language, marks in LANGUAGES.items() for mark in marks.split() for x in (mark, language)]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def has_control_flow(language) -> Column:
    return col(language).isin([x for x in LANGUAGES if x not in UNSCORED_LANGUAGES])


def is_test_path(path) -> Column:
    low = F.lower(F.translate(col(path), "\\", "/"))
    name = base_name(low)
    in_dir = F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, TEST_DIRS)))
    ends = name.rlike("(" + "|".join(map(re.escape, TEST_SUFFIXES)) + ")$")
    return in_dir | ends | name.rlike("^(" + "|".join(TEST_PREFIXES) + ")")


def banded(value, bands, rest: str, above: bool) -> Column:
    """The first band whose bound the value meets: from below (<=) or from above (>=)."""
    value, out = col(value), None
    for name, bound in bands:
        meets = value >= bound if above else value <= bound
        out = F.when(meets, name) if out is None else out.when(meets, name)
    return out.otherwise(rest)


def complexity_level(value) -> Column:
    return banded(value, COMPLEXITY_BANDS, "very_high", above=False)


def grade(score) -> Column:
    return banded(score, GRADES, "F", above=True)


def severity_rank(severity) -> Column:
    out = None
    for rank, name in enumerate(SEVERITIES):
        out = F.when(col(severity) == name, rank) if out is None else out.when(col(severity) == name, rank)
    return out.otherwise(-1).cast("bigint")


def severity_of_impact(impact) -> Column:
    return banded(impact, (("critical", 12.0), ("high", 6.0), ("medium", 2.0)), "low", above=True)


def inside(path, package) -> Column:
    """Whether a path is a package or lies below it, segment by segment."""
    return (col(path) == col(package)) | col(path).startswith(F.concat(col(package), F.lit("/")))


def ancestors(path) -> Column:
    """A path and all its directories, so that prefix joins become equi-joins."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ** takes any rest, * and ? stay in a segment."""
    out = []
    for segment in pattern.strip("/").split("/"):
        if segment == "**":
            return "^" + "/".join(out) + ("(/.*)?$" if out else ".*$")
        out.append("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in segment))
    return "^" + "/".join(out) + "$"


def matches_glob(path, pattern: str) -> Column:
    return col(path).rlike(glob_regex(pattern))


def normal_route(path) -> Column:
    """A route without query, numeric and UUID-shaped segments replaced by {id}."""
    bare = F.regexp_replace(col(path), r"[?#].*$", "")
    segments = F.transform(F.split(bare, "/"), lambda s: F.when(s.rlike(r"^([0-9]+|.{8}-.{4}-.{4}-.{4}-.{12})$"), "{id}").otherwise(s))
    return F.array_join(segments, "/")


def is_commit_sha(ref) -> Column:
    return col(ref).rlike("^[0-9a-fA-F]{40}$")


def python_name(name) -> Column:
    """A distribution name as package indexes compare it."""
    return F.regexp_replace(F.translate(F.lower(col(name)), "_.", "--"), "^-+|-+$", "")


def python_requirement(spec) -> Column:
    """The normal name a requirement line asks for; null for options and bare URLs."""
    line = F.trim(F.regexp_replace(F.trim(col(spec)), r"(^|\s)#.*$", ""))
    egg = lambda x: F.regexp_extract(x, r"#egg=([A-Za-z0-9._-]+)", 1)
    named = lambda x: F.regexp_extract(x, r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(\[[^\]]*\])?\s*(@|[<>=!~;,]|$)", 1)
    name = once(line, lambda x: F.when(x.rlike(r"^[A-Za-z][A-Za-z+]*://"), egg(x)).otherwise(named(x)))  # empty for an option
    return once(name, lambda x: F.when(x != "", python_name(x)))


def numbers_in(text) -> Column:
    """Numeric tokens of a text, trailing zeros of decimals trimmed."""
    found = F.regexp_extract_all(col(text), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1)
    return F.transform(found, lambda x: F.when(x.contains("."), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x))


def unsupported_numbers(text, facts) -> Column:
    """Numbers of a text that are neither facts nor small ordinals (0 to 20)."""
    small = F.array(*[F.lit(str(i)) for i in range(21)])
    return F.array_sort(F.array_except(F.array_except(F.array_distinct(numbers_in(text)), col(facts)), small))


def trend_status(delta, higher_is_better: bool = True) -> Column:
    """Stable, Improved, Dropped or Regression, by how far a measure moved."""
    move = col(delta) if higher_is_better else -col(delta)
    return F.when(F.abs(move) < 0.5, "Stable").when(move > 0, "Improved").when(move <= -10, "Regression").otherwise("Dropped")
