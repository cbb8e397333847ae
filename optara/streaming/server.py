"""A thin HTTP wrapper over a decision function: health, and POST /decide with checked requests."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from ..operators.rows import MAX_OPTIONS, PROBLEMS

MAX_BODY = 1 << 20


def problem(body) -> str | None:
    """First problem of one request, by the tests and names of operators.rows."""
    if not isinstance(body, dict):
        return "body must be an object"
    blank = lambda x: not isinstance(x, str) or not x.strip()
    listed = body["candidates"] if isinstance(body.get("candidates"), list) else []
    options = [o if isinstance(o, dict) else {} for o in listed]
    ids = [str(o.get("id", "")) for o in options]
    found = (blank(body.get("state")), blank(body.get("question")), not 2 <= len(options) <= MAX_OPTIONS, any(blank(o.get("text")) for o in options), "" in ids or len(set(ids)) < len(ids))
    return next((name for name, bad in zip(PROBLEMS, found, strict=True) if bad), None)


def make(decide: Callable[[dict], dict], port: int = 0, examples: list | None = None) -> ThreadingHTTPServer:
    """A server whose POST /decide runs decide under a lock; GET /health and /examples."""
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def reply(self, status: int, payload) -> None:
            data = json.dumps(payload, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            known = {"/health": {"status": "ok"}, "/examples": examples or []}
            self.reply(200, known[self.path]) if self.path in known else self.reply(404, {"error": "not found"})

        def do_POST(self) -> None:
            if self.path != "/decide":
                return self.reply(404, {"error": "not found"})
            length = self.headers.get("Content-Length", "")
            if not length.isdigit():
                return self.reply(400, {"error": "bad length"})
            if int(length) > MAX_BODY:
                return self.reply(413, {"error": "body too large"})
            try:
                body = json.loads(self.rfile.read(int(length)))
            except ValueError:
                return self.reply(400, {"error": "body must be JSON"})
            if found := problem(body):
                return self.reply(422, {"error": found})
            began = time.perf_counter()
            with lock:
                answer = decide(body)
            self.reply(200, answer | {"latency_ms": round((time.perf_counter() - began) * 1000, 3)})

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
