"""Small results as text: Markdown and plain tables, JSON documents, a comment on a build, a timeline.

Reports are rendered on the driver from rows that are few by construction (one snapshot,
top-k lists); every function bounds what it collects.
"""

from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import DataFrame, Row, functions as F

from repolytics.functions.text import magnitude, signed
from repolytics.plans import health, risks as rules

MOST_ROWS = 500
SCHEMA_VERSION = "1"
MARKS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵", "info": "⚪"}


def cell(value) -> str:
    text = "" if value is None else f"{value:g}" if isinstance(value, float) else str(value)
    return text.replace("|", "\\|").replace("\r\n", " ").replace("\n", " ").replace("\r", " ")


def markdown(frame: DataFrame, title: str = "", limit: int = MOST_ROWS) -> str:
    """A frame of few rows as a Markdown table."""
    rows = frame.limit(limit).collect()
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(frame.columns) + " |", "|" + " --- |" * len(frame.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def plain(frame: DataFrame, title: str = "", limit: int = MOST_ROWS) -> str:
    """A frame of few rows as an aligned table for a terminal."""
    rows = [[cell(v) for v in r] for r in frame.limit(limit).collect()]
    widths = [max(map(len, column)) for column in zip(frame.columns, *rows)]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in [frame.columns, *rows]]
    return "\n".join([*([title.upper()] if title else []), *lines]) + "\n"


def sections(frames: dict[str, DataFrame], form: str = "table", only: list[str] | None = None, limit: int = MOST_ROWS) -> str:
    """Several frames under their names, as tables, Markdown or one JSON document; only names those wanted."""
    unknown = set(only or ()) - set(frames)
    if unknown:
        raise ValueError(f"unknown sections {sorted(unknown)}: there are {sorted(frames)}")
    wanted = {k: v for k, v in frames.items() if not only or k in only}
    if form == "json":
        return document(wanted, limit)
    if form not in ("table", "markdown"):
        raise ValueError("form is table, markdown or json")
    return "\n".join((markdown if form == "markdown" else plain)(frame, name, limit) for name, frame in wanted.items())


def _value(x):
    if isinstance(x, Row):
        return {k: _value(v) for k, v in x.asDict().items()}
    if isinstance(x, (list, tuple)):
        return [_value(v) for v in x]
    if isinstance(x, dict):
        return {str(k): _value(v) for k, v in x.items()}
    return x.isoformat() if isinstance(x, (date, datetime)) else x


def document(frames: dict[str, DataFrame], limit: int = MOST_ROWS, single: tuple[str, ...] = ("total", "stats", "summary", "report", "git", "dependencies"), **more) -> str:
    """One nested JSON document: a list of objects for each frame, an object for those of one row."""
    out = {"schema_version": SCHEMA_VERSION, **more}
    for name, frame in frames.items():
        rows = [_value(r) for r in frame.limit(limit).collect()]
        out[name] = (rows[0] if rows else None) if name in single else rows
    return json.dumps(out, ensure_ascii=False, sort_keys=False, default=str) + "\n"


def counted(risks: DataFrame) -> dict[str, int]:
    """How many risks there are, in all and by severity, counted in Spark."""
    own = risks.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in MARKS)).first()
    return own.asDict()


def status(total: DataFrame, risks: DataFrame, top: int = 3) -> str:
    """Score, grade, weakest measure, how many risks, and the first of them."""
    own = total.first()
    if own is None:
        return "no data\n"
    count = counted(risks)
    lines = [f"{own['score']:g} ({own['grade']}), {own['label']}; weakest: {own['weakest']}"]
    if count["total"]:
        lines.append(", ".join([f"{count['total']} risk(s)", *(f"{count[s]} {s}" for s in ("critical", "high") if count[s])]))
    lines += [f"- {r['severity']}: {r['id']} ({r['impact']:g})" for r in risks.limit(top).collect()]
    lines += [f"... and {count['total'] - top} more"] if count["total"] > top else []
    return "\n".join(lines) + "\n"


def comment(frame: DataFrame, risks: DataFrame, event: dict | None = None, most_risks: int = 0, version: str = "") -> str:
    """A comment on a change: score and movement, the rows of health.categories, risks, where it comes from.

    frame: one row with score, grade, previous_score and the columns of categories.
    risks: severity, id, subject, impact.  event: repository, head_sha, baseline.
    """
    own = frame.withColumn("moved", magnitude(F.col("score") - F.col("previous_score"))).first()
    lines = ["<!-- repolytics -->", "## Repository health", ""]
    if own["previous_score"] is None:
        lines += [f"**Health:** `{own['score']:.1f}` ({own['grade']})", ""]
    else:
        delta = own["score"] - own["previous_score"]
        arrow = "→" if abs(delta) < 0.5 else "↑" if delta > 0 else "↓"
        lines += [f"**Health:** `{own['previous_score']:.1f} → {own['score']:.1f}` ({arrow}{own['moved']})", ""]
    lines += ["| Category | Score | Delta | Status |", "| :--- | :---: | :---: | :---: |"]
    for r in health.categories(frame, []).withColumn("shown", signed("delta")).orderBy("position").collect():
        value = "–" if r["value"] is None else f"{r['value']:.1f}{r['unit']}"
        lines.append(f"| {r['label']} | {value} | {r['shown'] if r['delta'] is not None else '–'} | {r['status']} |")
    lines += ["", "- **Testing**: files of tests for each source file, not line coverage", "- **Build**: the build is not run, so its time is not measured", ""]
    total = counted(risks)["total"]
    kept = rules.ordered(risks).limit(most_risks or MOST_ROWS).collect()
    lines += [f"### Risks ({total})", ""] if total else ["### Risks", "", "None."]
    lines += [f"- {MARKS.get(r['severity'], '')} **{cell(r['id'])}**" + (f" — `{cell(r['subject'])}`" if r["subject"] else "") for r in kept]
    lines += [f"- _{total - len(kept)} further risk(s) left out_"] if len(kept) < total else []
    named = event or {}
    parts = [named.get("repository"), f"head `{named['head_sha'][:8]}`" if named.get("head_sha") else None, f"baseline {named['baseline']}" if named.get("baseline") else None, f"repolytics {version}" if version else None]
    lines += ["", "---", "_From local analysis" + (f" ({', '.join(p for p in parts if p)})" if any(parts) else "") + "; nothing is estimated._"]
    return "\n".join(lines) + "\n"


def facts(frame: DataFrame, risks: DataFrame, most_risks: int = 10) -> tuple[str, set[str]]:
    """What a summary may be written from: a text of facts, and the numbers it may use.

    Numbers of a summary that are not among these are unsupported
    (predicates.unsupported_numbers).
    """
    from repolytics.functions.predicates import numbers_in

    spark = frame.sparkSession
    own = frame.first()
    lines = [] if own is None else [f"{k}: {cell(v)}" for k, v in own.asDict().items() if v is not None]
    lines += [f"risk {r['severity']}: {r['id']}, impact {r['impact']:g}" for r in rules.ordered(risks).limit(most_risks).collect()]
    text = "\n".join(lines)
    numbers = spark.createDataFrame([(text,)], "text string").select(numbers_in("text")).first()[0]
    return text, set(numbers)


def summary_checked(spark, text: str, known: set[str]) -> list[str]:
    """The numbers of a written summary that no fact supports."""
    from repolytics.functions.predicates import unsupported_numbers

    return spark.createDataFrame([(text, sorted(known))], "text string, known array<string>").select(unsupported_numbers("text", "known")).first()[0]


def axis(low: float, high: float) -> tuple[float, float]:
    """Bounds at multiples of ten, at least twenty apart, within 0..100."""
    a, b = low // 10 * 10, -(-high // 10) * 10
    while b - a < 20:
        a, b = max(0.0, a - 10), min(100.0, b + 10)
        if (a, b) == (0.0, 100.0):
            break
    return max(0.0, a), min(100.0, b)


def timeline(points: DataFrame, columns: int = 60, rows: int = 11) -> str:
    """The scores of one root's trend as a plot of at most columns x rows characters."""
    scores = [r["score"] for r in points.orderBy("id").limit(MOST_ROWS).collect()]
    if not scores:
        return "no history\n"
    low, high = axis(min(scores), max(scores))
    width = min(columns, len(scores))
    held = [scores[min(len(scores) - 1, (2 * i + 1) * len(scores) // (2 * width))] for i in range(width)]
    level = [round((s - low) / (high - low or 1) * (rows - 1)) for s in held]
    lines = [f"{low + (high - low) * k / (rows - 1):5.0f} |" + "".join("●" if v == k else " " for v in level) for k in range(rows - 1, -1, -1)]
    return "\n".join(lines) + "\n"

