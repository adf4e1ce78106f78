"""Requests by method and path, as a pure function, and a small HTTP server over it.

Replies are (status, {code, msg, data}); the code is 0 for success, 1 for a refused request
and 2 for a malformed one.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from .engine import Engine

OK, FAILED, ERROR = 0, 1, 2


def _reply(code: int, msg: str = "ok", data: Any = None, status: int = 200) -> tuple[int, dict[str, Any]]:
    return status, {"code": code, "msg": msg, "data": data}


def route(engine: Engine, method: str, path: str, body: str | bytes | None = None) -> tuple[int, Any]:
    """Carry out one request."""
    parts = [p for p in path.split("?")[0].split("/") if p]
    try:
        value = json.loads(body) if body else None
    except ValueError as e:
        return _reply(ERROR, f"the body is not JSON: {e}")
    try:
        return _dispatch(engine, method, parts, value)
    except (ValueError, RuntimeError) as e:
        return _reply(FAILED, str(e))
    except (KeyError, TypeError, AttributeError) as e:
        return _reply(ERROR, f"bad request: {e!r}")
    except Exception as e:  # a failed job is an answer, too
        return _reply(FAILED, f"failed: {type(e).__name__}: {str(e)[:500]}", status=500)


def _dispatch(engine: Engine, method: str, parts: list[str], value: Any) -> tuple[int, Any]:
    match method, parts:
        case "GET", ["_status"]:
            return 200, engine.status()
        case "GET", ["_search"]:
            return _reply(OK, data=engine.search_documents(value or {}))
        case "GET", [db, table, key]:
            return _reply(OK, data=engine.get(db, table, key))
        case "POST", [db]:
            engine.create_database(db)
        case "POST", [db, table]:
            engine.create_table(db, table, value or [])
        case "POST", [db, table, key]:
            return _reply(OK, data=engine.insert(db, table, key, value))
        case "PUT", [db, table, key]:
            engine.update(db, table, key, value)
        case "DELETE", [db]:
            engine.drop_database(db)
        case "DELETE", [db, table]:
            engine.drop_table(db, table)
        case "DELETE", [db, table, key]:
            engine.delete(db, table, key)
        case "PATCH", [db, table]:
            name = value["field"]["name"]
            if value["type"] == "addField":
                engine.add_field(db, table, name, value["field"]["type"])
            elif value["type"] == "delField":
                engine.drop_field(db, table, name)
            else:
                return _reply(ERROR, f"unknown change {value['type']!r}")
        case ("GET" | "POST" | "PUT" | "DELETE" | "PATCH"), _:
            return _reply(ERROR, "no such path", status=404)
        case _:
            return _reply(ERROR, "no such method", status=501)
    return _reply(OK)


def server(engine: Engine, host: str = "127.0.0.1", port: int = 9528) -> ThreadingHTTPServer:
    """A server ready to ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _serve(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, value = route(engine, self.command, self.path, body)
            raw = json.dumps(value, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = _serve

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
