"""Column functions that word results: signed movements, short names, one-line reasons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from repolytics.functions.numeric import col, round_half

SHORT_SHA = 12
#: Direct dependencies above which an ecosystem counts as large.
MANY_DIRECT = {"python": 40}
MANY_DIRECT_ELSE = 50
#: Folders that the walks of single operators leave out.
PRUNED_DIRS = {
    "imports": (".git", "node_modules", "vendor", "dist", "build", "target", ".next", "testdata", ".venv"),
    "packages": ("node_modules", ".git", "vendor", "target", "dist", "build", "out", "coverage", ".next", "__pycache__", ".venv", "venv"),
}


def short_sha(sha, length: int = SHORT_SHA) -> Column:
    return F.substring(col(sha), 1, length)


def magnitude(value) -> Column:
    """The size of a movement with at most one decimal, halves away from zero."""
    size = round_half(F.abs(col(value)), 1)
    return F.when(size == F.floor(size), size.cast("bigint").cast("string")).otherwise(F.format_string("%.1f", size))


def signed(value) -> Column:
    """A movement with its sign; "0" where nothing moved."""
    value = col(value)
    return F.when(value > 0, F.concat(F.lit("+"), magnitude(value))).when(value < 0, F.concat(F.lit("-"), magnitude(value))).otherwise("0")


def delta_line(label, before, after, delta, unit, digits) -> Column:
    """`label: before -> after (+delta) unit`, before and after with 0 to 2 digits."""
    shown = lambda x: F.when(col(digits) == 0, F.format_string("%.0f", col(x))).when(col(digits) == 1, F.format_string("%.1f", col(x))).otherwise(F.format_string("%.2f", col(x)))
    tail = F.when(col(unit) == "", "").otherwise(F.concat(F.lit(" "), col(unit)))
    return F.concat(col(label), F.lit(": "), shown(before), F.lit(" -> "), shown(after), F.lit(" ("), F.format_string("%+.1f", col(delta)), F.lit(")"), tail)


def size_verdict(avg_lines) -> Column:
    """On which side of the healthy band (25 to 150 lines) the average file lies."""
    avg = col(avg_lines)
    return F.when(avg > 150, "files too large").when(avg < 25, "files too fragmented").otherwise("in band")


def many_direct(ecosystem) -> Column:
    """The number of direct dependencies above which an ecosystem counts as large."""
    out = F.lit(MANY_DIRECT_ELSE)
    for name, bound in MANY_DIRECT.items():
        out = F.when(col(ecosystem) == name, bound).otherwise(out)
    return out.cast("bigint")


def in_pruned(path, walk: str) -> Column:
    """Whether a path lies below a folder that the walk of an operator leaves out."""
    return F.exists(F.slice(F.split(col(path), "/"), 1, F.size(F.split(col(path), "/")) - 1), lambda name: is_pruned(name, walk))


def is_pruned(name, walk: str) -> Column:
    """Whether the walk of an operator leaves a folder of this name out."""
    hidden = col(name).startswith(".") if walk == "packages" else F.lit(False)
    return col(name).isin(*PRUNED_DIRS[walk]) | hidden


def looks_like_path(subject) -> Column:
    """Whether a subject names a file: its last part has an extension and it is relative to the root."""
    subject = col(subject)
    base = F.element_at(F.split(subject, "/"), -1)
    outside = subject.contains("\\") | subject.contains("://") | subject.startswith("/") | (F.substring(subject, 2, 1) == ":")
    return ~outside & base.rlike(r"^.+\.[^.]+$") & ~base.isin(".", "..")


def hotspot_reason(language="language", lines="code_lines", churn="churn", level="level", measured="complexity_measured", confirmed="confirmed", least_lines: int = 500, least_churn: int = 30, least_level: str = "high") -> Column:
    """Why a large file is a confirmed hotspot, or which of the three tests it fails."""
    sure = F.format_string(f"%d code lines (at least {least_lines}), %d changed (at least {least_churn}), %s complexity (at least {least_level})", col(lines), col(churn), col(level))
    failed = F.array(
        F.when(col(lines) < least_lines, F.format_string(f"%d of {least_lines} lines", col(lines))),
        F.when(col(churn) < least_churn, F.format_string(f"%d of {least_churn} changed lines", col(churn))),
        F.when(~col(measured), F.concat(F.lit("complexity not measured for "), col(language))).when(~col(level).isin("high", "very_high"), F.concat(col(level), F.lit(f" complexity, below {least_level}"))),
    )
    return F.when(col(confirmed), sure).otherwise(F.concat(F.format_string("%d code lines; not confirmed: ", col(lines)), F.array_join(F.array_compact(failed), ", ")))


def otel_time(text) -> Column:
    """A span's time: nanoseconds since the epoch, or one of the ISO shapes exporters write; else null."""
    text = col(text)
    digits = text.rlike("^[0-9]{10,19}$")
    nanos = F.when(digits, F.timestamp_micros(F.floor(F.when(digits, text).cast("decimal(20,0)") / 1000).cast("bigint")))
    return F.coalesce(nanos, F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]Z")))


def bracketed(parts: Column, sep: str = ", ") -> Column:
    """Texts that apply, joined; null where none does."""
    kept = F.array_compact(parts)
    return F.when(F.size(kept) > 0, F.array_join(kept, sep))
