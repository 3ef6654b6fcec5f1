"""The figures of one analysis over HTTP: health, risks, hotspots, history, version.

The responses are rendered once from frames of few rows; a request only filters them.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, functions as F

from repolytics.functions.predicates import SEVERITIES
from repolytics.plans import reports
from repolytics.plans.history import page

MOST_HISTORY = 500


def rows(frame: DataFrame, limit: int = reports.MOST_ROWS) -> list[dict]:
    return json.loads(reports.document({"rows": frame}, limit))["rows"]


def health_view(snapshot: DataFrame, metrics: DataFrame, languages: DataFrame) -> dict:
    return {**(rows(snapshot, 1) or [{}])[0], "metrics": rows(metrics), "languages": rows(languages)}


def risks_view(risks: list[dict], counts: dict[str, int], severity: str | None = None) -> dict:
    """Counts of all risks, and the first of one severity; an unknown severity is an error."""
    wanted = (severity or "").strip().lower()
    if wanted and wanted not in SEVERITIES:
        raise ValueError(f"unknown severity {severity!r}")
    shown = [r for r in risks if not wanted or r["severity"] == wanted]
    return {**{s: counts[s] for s in ("total", "critical", "high", "medium", "low")}, "left_out": (counts[wanted] if wanted else counts["total"]) - len(shown), "risks": shown}


def hotspots_view(hotspots: list[dict], churn: list[dict], counts: dict[str, int], confirmed: str | None = None) -> dict:
    if confirmed not in (None, "", "true", "false", "1", "0"):
        raise ValueError("confirmed must be true or false")
    kept = hotspots if not confirmed else [h for h in hotspots if h["confirmed"] == (confirmed in ("true", "1"))]
    return {**counts, "hotspots": kept, "churn": churn}


def history_view(records: list[dict], limit: str | None = None) -> dict:
    """The newest records, oldest first, and what moved from the first to the last of them."""
    n = int(limit) if limit else 60
    if n < 0:
        raise ValueError("limit must not be negative")
    kept = records[-min(n, MOST_HISTORY):] if n else records
    delta = None
    if len(kept) >= 2:
        a, b = kept[0], kept[-1]
        delta = {"score": round(b["score"] - a["score"], 2), "complexity": round((b.get("avg_complexity") or 0) - (a.get("avg_complexity") or 0), 2), "risks": b["risk_count"] - a["risk_count"]}
    return {"count": len(kept), "records": kept, "delta": delta}


class Site:
    """answer(path) gives (status, document) of the five routes and /healthz."""

    def __init__(self, found: dict[str, DataFrame], snapshot: DataFrame, stored: DataFrame | None, version: str):
        self.health = health_view(snapshot, found["metrics"], found["languages"])
        by_severity = [found["risks"].filter(F.col("severity") == s) for s in SEVERITIES]
        self.risks = [r for own in reversed(by_severity) for r in rows(own)]  # the first of every severity
        self.hotspots, self.churn = (rows(found[k]) for k in ("hotspots", "churn"))
        self.counted = reports.counted(found["risks"])
        self.heat = found["hotspots"].agg(F.count(F.lit(1)).alias("total"), F.count_if("confirmed").alias("confirmed")).first().asDict()
        root = self.health.get("root", "")
        self.records = rows(page(stored, root, MOST_HISTORY), MOST_HISTORY) if stored is not None else []
        self.version = {"version": version, "schema": reports.SCHEMA_VERSION}

    def answer(self, target: str) -> tuple[int, dict]:
        asked = urlsplit(target)
        query = {k: v[0] for k, v in parse_qs(asked.query).items()}
        routes = {
            "/healthz": lambda: {"status": "ok"}, "/api/v1/health": lambda: self.health, "/api/v1/version": lambda: self.version,
            "/api/v1/risks": lambda: risks_view(self.risks, self.counted, query.get("severity")),
            "/api/v1/hotspots": lambda: hotspots_view(self.hotspots, self.churn, self.heat, query.get("confirmed")),
            "/api/v1/history": lambda: history_view(self.records, query.get("limit")),
        }
        if asked.path not in routes:
            return 404, {"error": f"no such route: {asked.path}"}
        try:
            return 200, routes[asked.path]()
        except ValueError as error:
            return 400, {"error": str(error)}


def serve(found: dict[str, DataFrame], snapshot: DataFrame, stored: DataFrame | None, port: int, version: str, host: str = "127.0.0.1") -> None:
    site = Site(found, snapshot, stored, version)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, document = site.answer(self.path)
            body = json.dumps(document, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    ThreadingHTTPServer((host, port), Handler).serve_forever()
