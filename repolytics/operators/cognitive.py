"""Cognitive load of functions and files from variable lifetimes, calls and nesting."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from repolytics.functions.numeric import clamp01, col, round_half
from repolytics.functions.predicates import extension
from repolytics.operators.code import strip_line

CALL = r"([A-Za-z0-9_.]+)[ \t]*\("


def score(lifetime, density, depth) -> Column:
    """0..100, one decimal, from median lifetime, call density and depth."""
    parts = 0.45 * clamp01((col(lifetime) - 20) / F.lit(200.0)) + 0.35 * clamp01(col(density) / F.lit(20.0)) + 0.20 * clamp01(col(depth) / F.lit(6.0))
    return round_half(100 * parts, 1)


def median(x) -> Column:
    """Integer median: of an even number, the floor of the middle mean."""
    return F.floor(F.percentile(col(x), 0.5)).cast("bigint")


def call_targets(line) -> Column:
    """Distinct names called in a text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(line), F.lit(CALL), 1)))


def files(functions: DataFrame) -> DataFrame:
    """path, functions, median_lifetime, max_lifetime, density, depth, score from rows of functions.

    functions: path, name, lifetime, density, depth.  Depth is an integer mean.
    """
    sums = functions.groupBy("path").agg(F.count(F.lit(1)).alias("functions"), median("lifetime").alias("median_lifetime"), F.max("lifetime").alias("max_lifetime"), F.percentile("density", 0.5).alias("density"), F.floor(F.sum("depth") / F.count(F.lit(1))).cast("bigint").alias("depth"))
    return sums.withColumn("score", score("median_lifetime", "density", "depth"))


def counted_median(frame: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, median: the mean of the two middle values, by counting each distinct value.

    Values are counted before anything is shuffled; a running sum of the counts then tells
    where the middle ranks lie.  Without by all distinct values meet in one task, so it is
    meant for values of a fixed number of digits, as scores are.  Nulls do not count.
    """
    counts = frame.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    placed = counts.withColumn("upto", F.sum("n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(group))
    low, high = (F.min(F.when(F.col("upto") >= rank, F.col(value))) for rank in (F.expr("(all + 1) div 2"), F.expr("all div 2 + 1")))
    return placed.groupBy(*by).agg(((low + high) / 2).alias("median"))


def summary(measured: DataFrame, failed: str = "failed") -> DataFrame:
    """One row: median and worst score over files that were measured in full; zeros without any."""
    known = measured.filter(~F.col(failed))
    worst = known.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("worst"))
    return counted_median(known, "score").select(F.coalesce("median", F.lit(0.0)).alias("median")).crossJoin(F.broadcast(worst))


#: Extensions of the languages that are measured without a parser, and the
#: words that begin a function there.
LEXICAL = {"TypeScript": (".ts", ".tsx"), "JavaScript": (".js", ".jsx", ".mjs", ".cjs")}
STARTS = ("function ", "func ", "def ", "=>")


def lexical_files(sources: DataFrame) -> DataFrame:
    """path, language, functions, density, depth, score of JavaScript and TypeScript files, from columns alone.

    Depth is the deepest brace nesting between function starts; density the distinct call
    targets in a hundred lines of the file; lifetimes need a parser and count as none, which
    is why these files are marked as not measured in full.  sources: path, language, content.
    """
    lines = F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")
    many = lambda line, sign: F.length(line) - F.length(F.replace(line, F.lit(sign)))
    fields = ("depth", "most", "inside", "found", "deepest")
    state = lambda *v: F.struct(*(x.cast("boolean" if name == "inside" else "int").alias(name) for name, x in zip(fields, v)))

    def step(at: Column, line: Column) -> Column:
        begins = reduce(or_, (line.contains(w) for w in STARTS))
        ends = begins & at["inside"]
        depth = F.greatest(F.lit(0), at["depth"] + many(line, "{") - many(line, "}"))
        most = F.greatest(F.when(begins, at["depth"]).otherwise(at["most"]), depth)
        return state(depth, most, at["inside"] | begins, at["found"] + ends.cast("int"), F.when(ends, F.greatest(at["deepest"], at["most"])).otherwise(at["deepest"]))

    end = lambda at: F.struct((at["found"] + at["inside"].cast("int")).alias("functions"), F.when(at["inside"], F.greatest(at["deepest"], at["most"])).otherwise(at["deepest"]).alias("depth"))
    folded = F.aggregate(F.filter(lines, lambda x: x.rlike(r"\S")), state(F.lit(0), F.lit(0), F.lit(False), F.lit(0), F.lit(0)), step, end)
    known = reduce(or_, ((F.col("language") == name) & extension("path").isin(*marks) for name, marks in LEXICAL.items()))
    own = sources.filter(known & F.col("content").isNotNull()).select("path", "language", folded.alias("f"), F.size(call_targets("content")).alias("targets"), F.size(lines).alias("lines"))
    density = round_half(F.col("targets").cast("double") / F.col("lines") * 100, 1)
    return own.select("path", "language", F.greatest(F.lit(1), F.col("f.functions")).cast("bigint").alias("functions"), density.alias("density"), F.col("f.depth").cast("bigint").alias("depth")).withColumn("score", score(F.lit(0), "density", "depth"))


def measured(sources: DataFrame) -> DataFrame:
    """path, language, functions, median_lifetime, max_lifetime, density, depth, score, failed of every file that can be measured.

    Go files by their functions (zeros without any), the others as a whole and marked failed.
    """
    go = sources.filter("language = 'Go'").select("path", "language")
    own = go.join(files(functions(sources.filter("language = 'Go'"))), "path", "left").fillna(0, ["functions", "median_lifetime", "max_lifetime", "density", "depth", "score"]).withColumn("failed", F.lit(False))
    rest = lexical_files(sources).withColumns({"median_lifetime": F.lit(0).cast("bigint"), "max_lifetime": F.lit(0).cast("bigint"), "failed": F.lit(True)})
    return own.unionByName(rest)


_OPEN = re.compile(r"\b(?:func|function)\b\s*(?:\([^)]*\)\s*)?([A-Za-z_]\w*)?|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>")
_DECLARED = re.compile(r"([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s*:=|\b(?:var|let|const)\s+([A-Za-z_$][\w$]*)")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_CALLED = re.compile(CALL)


def functions_in(text: str, language: str) -> list[dict]:
    """Functions of a source text by a lexical scan: name, line, lines, lifetime, calls, density, depth.

    A function runs from the line that opens it to the brace that closes it.  A variable
    lives from the line that declares it to the last line that names it; the lifetime of
    a function is the median over its variables.  Every control block counts as two
    levels of depth, itself and its braces.
    """
    open_functions, done, depth, in_block = [], [], 0, False
    for number, raw in enumerate(text.split("\n"), 1):
        line, skip, in_block = strip_line(raw, language, in_block)
        if skip:
            continue
        found = _OPEN.search(line)
        if found and "{" in line[found.start() :]:
            open_functions.append({"name": found[1] or found[2] or "", "line": number, "base": depth, "born": {}, "last": {}, "calls": 0, "deepest": 0})
        for own in open_functions:
            body = line[line.index("{", found.start()) :] if own["line"] == number else line
            own["calls"] += len(_CALLED.findall(body))
            for names in _DECLARED.findall(line):
                for name in _NAME.findall(names[0] or names[1]):
                    own["born"].setdefault(name, number)
            for name in _NAME.findall(line):
                if name in own["born"]:
                    own["last"][name] = number
        for c in line:
            depth = depth + 1 if c == "{" else max(0, depth - 1) if c == "}" else depth
            for own in open_functions:
                own["deepest"] = max(own["deepest"], depth - own["base"] - 1)
            if c == "}" and open_functions and depth <= open_functions[-1]["base"]:
                done.append(open_functions.pop() | {"end": number})
    out = []
    for own in sorted(done, key=lambda f: (f["line"], f["name"])):
        lives = sorted(own["last"].get(n, b) - b for n, b in own["born"].items())
        middle = (lives[(len(lives) - 1) // 2] + lives[len(lives) // 2]) // 2 if lives else 0
        lines = own["end"] - own["line"] + 1
        out.append({"name": own["name"], "line": own["line"], "lines": lines, "lifetime": middle, "calls": own["calls"], "density": 100.0 * own["calls"] / lines, "depth": 2 * own["deepest"]})
    return out


def _functions(batches):
    kinds = {"name": pa.string(), "line": pa.int64(), "lines": pa.int64(), "lifetime": pa.int64(), "calls": pa.int64(), "density": pa.float64(), "depth": pa.int64()}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, paths, rows = batch.slice(at, 256), [], []
            for path, language, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                found = functions_in(text or "", language or "")
                paths += [path] * len(found)
                rows += found
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in kinds.items())], ["path", *kinds])


def functions(sources: DataFrame) -> DataFrame:
    """A row for each function of Go, JavaScript and TypeScript files (path, language, content)."""
    own = sources.filter(F.col("language").isin("Go", "JavaScript", "TypeScript")).select("path", "language", "content")
    return own.mapInArrow(_functions, "path string, name string, line long, lines long, lifetime long, calls long, density double, depth long")
