"""GET /health, /tools, /impact?target=, /signals?type=&min_severity= over a stored graph."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TYPE_CHECKING
from urllib.parse import parse_qs, urlparse

from .plans import queries

if TYPE_CHECKING:
    from .cli import Reader

TOOLS = [{"name": "impact", "parameters": ["target"]}, {"name": "signals", "parameters": ["type", "min_severity"]}]


def answer(reader: Reader, url: str) -> tuple[int, object]:
    """Status and JSON value of a request."""
    parts = urlparse(url)
    given = {k: v[0] for k, v in parse_qs(parts.query).items()}
    try:
        if parts.path == "/health":
            return 200, {"status": "ok", **json.loads(reader.stats().toJSON().first())}
        if parts.path == "/tools":
            return 200, {"tools": TOOLS}
        if parts.path == "/impact":
            return 200, json.loads(reader.impact(given["target"]).toJSON().first())
        if parts.path == "/signals":
            found = queries.signals_where(reader.signals, given.get("type"), float(given["min_severity"]) if "min_severity" in given else None)
            return 200, {"signals": [json.loads(x) for x in found.toJSON().collect()]}
        return 404, {"error": "no such path"}
    except Exception as e:
        return 500, {"error": str(e)}


def serve(reader: Reader, port: int) -> None:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, value = answer(reader, self.path)
            body = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    ThreadingHTTPServer(("0.0.0.0", port), Handler).serve_forever()
