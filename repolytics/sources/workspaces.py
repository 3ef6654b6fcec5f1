"""Workspace markers: which globs a repository's root declares as its packages."""

from __future__ import annotations

import json
import posixpath
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from repolytics.functions.numeric import col

#: Marker files in the order in which they are asked, and manifests of packages.
MARKERS = {"pnpm-workspace.yaml": "pnpm", "lerna.json": "lerna", "go.work": "go.work", "Cargo.toml": "cargo", "package.json": "npm"}
MANIFESTS = {"package.json": "npm", "go.mod": "gomod", "Cargo.toml": "cargo", "pyproject.toml": "python"}
MOST_BYTES = 8 << 20


def clean(patterns) -> tuple[list[str], list[str]]:
    """(included, excluded) globs below the root; those that leave it or name it are dropped."""
    sides: tuple[list[str], list[str]] = ([], [])
    for pattern in patterns or ():
        if not isinstance(pattern, str):
            continue
        left = pattern.strip()
        out = left.startswith("!")
        left = left[1:].strip() if out else left
        if not left:
            continue
        path = posixpath.normpath(left.replace("\\", "/"))
        if path in (".", "..") or path.startswith(("../", "/")):
            continue
        sides[out].append(path)
    return sides


def _go_work(text: str) -> list[str]:
    found = re.finditer(r"(?ms)^[ \t]*use[ \t]*\((.*?)^[ \t]*\)|^[ \t]*use[ \t]+([^(\n]+)$", text)
    lines = [line for m in found for line in (m[1] if m[1] is not None else m[2]).split("\n")]
    named = (re.sub(r"//.*$", "", x).strip().strip('"') for x in lines)
    return [x for x in named if x]


def _cargo(text: str) -> list[str]:
    import tomllib

    found = tomllib.loads(text).get("workspace", {})
    return found.get("members", []) if isinstance(found, dict) else []


def _npm(text: str) -> list[str]:
    found = json.loads(text).get("workspaces") or []
    return found.get("packages", []) if isinstance(found, dict) else found


def _pnpm(text: str) -> list[str]:
    import yaml

    found = yaml.safe_load(text)
    return found.get("packages", []) if isinstance(found, dict) else []


def declared(marker: str, text: str | None) -> tuple[list[str], list[str]]:
    """The globs a marker file declares; none where it does not parse or declares no packages."""
    read = {"pnpm-workspace.yaml": _pnpm, "lerna.json": lambda t: json.loads(t).get("packages", []), "go.work": _go_work, "Cargo.toml": _cargo, "package.json": _npm}[marker]
    try:
        found = read(text or "")
    except Exception as error:  # each parser has errors of its own; a broken marker declares nothing
        if isinstance(error, ImportError):
            raise
        return [], []
    return clean(found if isinstance(found, list) else [])


def _parse(batches):
    for batch in batches:
        found = [declared(m, t) for m, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[i] for f in found], pa.list_(pa.string())) for i in (0, 1))], ["root", "marker", "include", "exclude"])


def markers(files: DataFrame) -> DataFrame:
    """root, marker, include, exclude of the marker files among files (root, path, text) at the root."""
    at_root = files.filter(F.col("path").isin(*MARKERS) & (F.length("text") <= MOST_BYTES))
    return at_root.select("root", F.col("path").alias("marker"), "text").mapInArrow(_parse, "root string, marker string, include array<string>, exclude array<string>")


def priority(marker) -> Column:
    out = F.lit(len(MARKERS))
    for at, name in enumerate(MARKERS):
        out = F.when(col(marker) == name, at).otherwise(out)
    return out


def kind(marker) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair]), col(marker))


def glob_regex(pattern, absorbing: bool = False) -> Column:
    """A glob column as a regular expression: * and ? stay in a segment, ** spans any number of them.

    Of an excluded glob (absorbing) what follows ** does not matter: it takes all the rest.
    """
    text = F.regexp_replace(col(pattern), r"(^|/)\*\*/.*$", "$1**") if absorbing else col(pattern)
    quoted = F.regexp_replace(text, r"([\\.^$|()\[\]{}+])", r"\\$1")
    for part, mark in ((r"(^|/)\*\*$", "$1\u0001"), (r"(^|/)\*\*/", "$1\u0002"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("^\u0001$", ".+"), ("/\u0001$", "(/.*)?"), ("\u0002", "(.+/)?")):
        quoted = F.regexp_replace(quoted, part, mark)
    return F.concat(F.lit("^"), quoted, F.lit("$"))
