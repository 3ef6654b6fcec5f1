"""Settings of a repository: a YAML file beside it and variables of the environment.

An option of the command line counts before the environment, that before the file, that
before the default.  The file is looked for in the folder, then in the folders above it, a
few levels up, then in the home folder; one that cannot be read leaves the defaults and
says so.  Numbers that bound a gate may be zero; None means that the gate is off.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

import yaml

NAMES = (".repolytics.yml", ".repolytics.yaml")
PREFIX = "REPOLYTICS_"
LEVELS = 6

#: Keys, what they are read as, and their defaults.
KEYS: dict[str, tuple[type, object]] = {
    "git_window_days": (int, 90), "hotspot_threshold": (int, 400), "enable_complexity": (bool, True), "max_file_bytes": (int, 2 << 20), "ignore_dirs": (list, None), "timeout_seconds": (int, 60), "detect_workspace": (bool, False),
    "history_limit": (int, 10), "database_path": (str, None), "compare_root": (str, ""), "watch_debounce_ms": (int, 250), "watch_interval_seconds": (int, 0),
    "min_health_score": (float, None), "max_health_drop": (float, None), "max_complexity_increase": (float, None), "max_risk_count": (int, None), "max_hotspots": (int, None), "fail_on_drift": (bool, False), "require_tests": (bool, False),
}
POSITIVE = ("git_window_days", "hotspot_threshold", "max_file_bytes", "history_limit")
NOT_NEGATIVE = ("timeout_seconds", "watch_debounce_ms", "watch_interval_seconds", "max_health_drop", "max_complexity_increase", "max_risk_count", "max_hotspots")


def _read(kind: type, value):
    if kind is list:
        return [str(x) for x in value] if isinstance(value, (list, tuple)) else [x for x in str(value).split(",") if x]
    if kind is bool:
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "t", "true", "yes", "on")
    return kind(value)


def _file(folder: str, home: str | None) -> str | None:
    at = os.path.abspath(folder)
    for _ in range(LEVELS):
        for name in NAMES:
            if os.path.isfile(os.path.join(at, name)):
                return os.path.join(at, name)
        if (above := os.path.dirname(at)) == at:
            break
        at = above
    return next((p for n in NAMES if home and os.path.isfile(p := os.path.join(home, n))), None)


def load(folder: str, environment: Mapping[str, str] | None = None, path: str | None = None, **options) -> tuple[dict[str, object], list[str]]:
    """The settings for a folder, and warnings.  options that are None do not count."""
    environment = os.environ if environment is None else environment
    out, warnings = {k: default for k, (_, default) in KEYS.items()}, []
    found, given = path or _file(folder, environment.get("HOME")), {}
    if found:
        try:
            with open(found, encoding="utf-8") as file:
                given = yaml.safe_load(file) or {}
            if not isinstance(given, dict):
                raise ValueError("not a mapping")
        except (OSError, ValueError, yaml.YAMLError) as error:
            warnings.append(f"{found} is left out: {error}")
            given = {}
    named = {k: environment[PREFIX + k.upper()] for k in KEYS if PREFIX + k.upper() in environment}
    for source in (given, named, {k: v for k, v in options.items() if v is not None}):
        for key, value in source.items():
            if key not in KEYS or value is None:
                continue
            try:
                out[key] = _read(KEYS[key][0], value)
            except (TypeError, ValueError):
                warnings.append(f"{key}: {value!r} is left out")
    return out, warnings


def check(settings: dict[str, object]) -> None:
    """Refuse what no run can mean."""
    for key in POSITIVE:
        if settings[key] <= 0:
            raise ValueError(f"{key} must be positive, not {settings[key]}")
    for key in NOT_NEGATIVE:
        if settings[key] is not None and settings[key] < 0:
            raise ValueError(f"{key} must not be negative, not {settings[key]}")
    score = settings["min_health_score"]
    if score is not None and not 0 <= score <= 100:
        raise ValueError(f"min_health_score must lie between 0 and 100, not {score}")
