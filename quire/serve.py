"""The engine over HTTP (POST /search, /mcp) and as a tool server on stdio, with the standard library only."""

from __future__ import annotations

import ipaddress
import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from quire.engine import Engine
from quire.plans import dsl
from quire.plans.filters import Filters
from quire.sources.corpus import CorpusError, NoIndex

TOOLS = {
    "search": "Search the lines: q in the query language, or clauses with a mode.",
    "verify_quote": "Is a quote a line of the corpus; if not, which lines are closest.",
    "get_passage": "A line with its neighbours, a chapter, or a citation (action get, read or cite).",
    "catalog": "Works, filtered.",
    "info": "The opened index.",
}


_TEXT, _WHOLE = {"type": "string"}, {"type": "integer", "minimum": 0}
_TEXTS = {"type": "array", "items": _TEXT}
_FILTERS = {name: _TEXTS for name in ("canons", "works", "authors", "categories", "types", "titles")} | {"juans": {"type": "array", "items": _WHOLE}}
_MODE = {"enum": ["keyword", "phrase", "near", "before"]}
#: The arguments of each tool; all that are not required may be left out.
ARGUMENTS = {
    "search": {"properties": {"q": _TEXT, "clauses": _TEXTS, "mode": _MODE, "limit": _WHOLE | {"default": 50}, **_FILTERS}, "anyOf": [{"required": ["q"]}, {"required": ["clauses"]}]},
    "verify_quote": {"properties": {"quote": _TEXT}, "required": ["quote"]},
    "get_passage": {
        "properties": {"action": {"enum": ["get", "read", "cite"], "default": "get"}, "line_id": _TEXT, "context": _WHOLE | {"default": 0}, "work_id": _TEXT, "juan": _WHOLE},
        "anyOf": [{"required": ["line_id"]}, {"required": ["work_id", "juan"]}],
    },
    "catalog": {"properties": _FILTERS},
    "info": {"properties": {}},
}


def filters_of(request: dict) -> Filters:
    names = ("canons", "works", "authors", "categories", "types", "titles")
    return Filters(**{n: tuple(request.get(n) or ()) for n in names}, juans=tuple(int(j) for j in request.get("juans") or ()))


def parsed_of(request: dict) -> dsl.ParsedQuery:
    """``clauses`` win over ``q``; near and before as a mode of ``q`` change nothing."""
    mode = request.get("mode")
    if request.get("clauses"):
        return dsl.from_clauses(list(request["clauses"]), mode)
    if not isinstance(request.get("q"), str):
        raise dsl.ParseError("q or clauses is needed")
    if mode not in (None, "near", "before", "keyword", "phrase"):
        raise dsl.ParseError(f"unknown mode {mode!r}")
    return dsl.with_mode(dsl.parse(request["q"]), mode if mode in ("keyword", "phrase") else None)


def _rows(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def passage(rows: list[dict]) -> dict:
    """Rows of a line and its neighbours as ``hit`` (null if there is none), ``before`` and ``after``."""
    rows = sorted(rows, key=lambda r: r["line_id"])
    plain = [{k: v for k, v in r.items() if k != "role"} for r in rows]
    of = lambda role: [p for p, r in zip(plain, rows, strict=True) if r["role"] == role]
    return {"hit": (of("hit") or [None])[0], "before": of("before"), "after": of("after")}


def call(engine: Engine, tool: str, request: dict) -> dict:
    if tool == "search":
        return {"hits": _rows(engine.search(parsed_of(request), filters_of(request), int(request.get("limit") or 50)))}
    if tool == "verify_quote":
        return vars(engine.verify(str(request.get("quote") or "")))
    if tool == "get_passage":
        action = request.get("action", "get")
        if action == "read":
            return {"hits": _rows(engine.read(request["work_id"], int(request["juan"])))}
        if action == "cite":
            return {"citation": engine.cite(request["line_id"])}
        if action != "get":
            raise dsl.ParseError(f"unknown action {action!r}")
        return passage(_rows(engine.get(request["line_id"], int(request.get("context") or 0))))
    if tool == "catalog":
        return {"entries": _rows(engine.entries(filters_of(request)))}
    if tool == "info":
        return engine.info()
    raise dsl.ParseError(f"unknown tool {tool!r}")


def answer(engine: Engine | None, message: dict) -> dict | None:
    """One JSON-RPC message of the tool protocol."""
    number, method, params = message.get("id"), message.get("method"), message.get("params") or {}
    if number is None:
        return None
    reply = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "quire", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", **ARGUMENTS[n]}} for n, d in TOOLS.items()]}}
    if method == "tools/call":
        try:
            if engine is None:
                raise NoIndex("no index")
            found = call(engine, params.get("name", ""), params.get("arguments") or {})
            return reply | {"result": {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False)}], "isError": False}}
        except (dsl.ParseError, CorpusError, KeyError, ValueError) as problem:
            return reply | {"result": {"content": [{"type": "text", "text": str(problem)}], "isError": True}}
    return reply | {"error": {"code": -32601, "message": f"unknown method {method}"}}


def serve_stdio(engine: Engine | None, source=None, sink=None) -> None:
    source, sink = source or sys.stdin, sink or sys.stdout
    for line in source:
        if line.strip():
            try:
                reply = answer(engine, json.loads(line))
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if reply is not None:
                print(json.dumps(reply, ensure_ascii=False), file=sink, flush=True)


def check_bind(host: str, allow_remote: bool = False) -> None:
    local = host == "localhost" or (host.replace(".", "").replace(":", "").isalnum() and _loopback(host))
    if not local and not allow_remote:
        raise ValueError(f"{host} is no loopback address; allow it explicitly")


def _loopback(host: str) -> bool:
    try:
        return ipaddress.ip_address(host).is_loopback
    except ValueError:
        return False


def server(engine: Engine | None, host: str = "127.0.0.1", port: int = 0, hosts: tuple[str, ...] = (), allow_remote: bool = False) -> ThreadingHTTPServer:
    """200 for an answer, empty or not; 400 for a bad request, 403 for another host's name, 503 without an index, 500 else."""
    check_bind(host, allow_remote)
    allowed = {"localhost", "127.0.0.1", "[::1]", host, *hosts}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_args) -> None:
            pass

        def say(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:
            named = self.headers.get("Host", "")
            if (named.rpartition(":")[0] if named.rpartition(":")[2].isdigit() else named) not in allowed:
                return self.say(403, {"error": "host not allowed"})
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                if not isinstance(request, dict):
                    raise ValueError("an object is needed")
            except ValueError as problem:
                return self.say(400, {"error": str(problem)})
            if self.path == "/mcp":
                return self.say(200, answer(engine, request) or {})
            if self.path != "/search":
                return self.say(404, {"error": "not found"})
            if engine is None:
                return self.say(503, {"error": "no index"})
            try:
                self.say(200, call(engine, "search", request))
            except (dsl.ParseError, TypeError, ValueError) as problem:
                self.say(400, {"error": str(problem)})
            except Exception as problem:  # noqa: BLE001  a request must not end the server
                self.say(500, {"error": str(problem)[:300]})

    return ThreadingHTTPServer((host, port), Handler)


def serve_in_thread(engine: Engine | None, **how) -> ThreadingHTTPServer:
    found = server(engine, **how)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    return found
