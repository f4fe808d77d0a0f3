"""JSON endpoints as a pure function, and a local HTTP adapter."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

from ..operators.storage import written
from .repository import Repository, RepositoryError


def diff_json(repo: Repository, a: str, b: str) -> dict:
    changes = written(repo.diff(a, b), "diff")
    rows = changes.where("change <> 'unchanged'").orderBy("path").collect()
    pick = lambda kind: [r.path for r in rows if r.change == kind]
    total = changes.where("change = 'unchanged'").count()
    return {"added": pick("added"), "from": repo.resolve(a), "modified": pick("modified"), "removed": pick("removed"), "to": repo.resolve(b), "unchanged_count": total}


def verify_json(repo: Repository) -> dict:
    bad = sorted(r.obj_hash for r in repo.verify().collect())
    return {"corrupted": bad, "objects_checked": repo.stored().count(), "quarantined_packs": [{"pack": k, "reason": v} for k, v in sorted(repo.quarantine().items())], "result": "corrupted" if bad or repo.quarantine() else "ok"}


def route(repo: Repository, url: str) -> tuple[int, dict]:
    """(status, body) of a GET: 200, 400 for bad input, 404 for anything else."""
    parts = urlsplit(url)
    ask = {k: v[0] for k, v in parse_qs(parts.query).items()}
    try:
        if parts.path == "/":
            return 200, {"endpoints": ["/api/status", "/api/snapshots", "/api/explain", "/api/diff", "/api/verify"]}
        if parts.path == "/api/status":
            return 200, repo.status()
        if parts.path == "/api/snapshots":
            return 200, {"snapshots": repo.list()}
        if parts.path == "/api/explain":
            return 200, repo.explain(ask["id"])
        if parts.path == "/api/diff":
            return 200, diff_json(repo, ask["from"], ask["to"])
        if parts.path == "/api/verify":
            return 200, verify_json(repo)
    except KeyError as missing:
        return 400, {"error": f"missing parameter {missing}"}
    except RepositoryError as error:
        return 400, {"error": str(error)}
    return 404, {"error": f"no endpoint {parts.path}"}


def serve(repo: Repository, port: int = 8765) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            status, body = route(repo, self.path)
            data = json.dumps(body, sort_keys=True, indent=2).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    return HTTPServer(("127.0.0.1", port), Handler)
