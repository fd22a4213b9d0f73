"""The store's HTTP routes and command line, as plain functions: what a network service would wrap."""

from __future__ import annotations

import argparse
import json
import sys

from .model import APPEND_STATUS, READ_STATUS
from .store import Store, StoreError

# The body's limit, field names, paths and the confirmation of the protocol.
MAX_BODY = 8 << 20
APPEND_FIELDS = {"thread_id", "checkpoint_id", "checkpoint_no", "parent_checkpoint_id", "messages"}


def route(store: Store, method: str, path: str, body: str = "") -> tuple[int, str]:
    """Status and answer of a request; errors answer as JSON with their kind."""
    status, answer = _route(store, method, path, body)
    store._count(http_requests=1, http_errors=int(status >= 400))
    return status, answer


def _route(store: Store, method: str, path: str, body: str) -> tuple[int, str]:
    path, _, query = path.partition("?")
    if len(body.encode()) > MAX_BODY:
        return 413, _error("TooLarge", "the body is too large")
    try:
        given = json.loads(body) if body and path != "/api/import" else {}
        if not isinstance(given, dict):
            raise StoreError("Invalid", "the body must be a JSON object")
        match method, path:
            case "GET", "/":
                return 200, _page(store)
            case "POST", "/api/import":  # the body is JSON lines
                lines = [(i, x) for i, x in enumerate(body.split("\n"), 1) if x.strip()]
                return 200, json.dumps(store.import_lines(store.spark.createDataFrame(lines, "line_no long, line string")))
            case "GET", "/api/health":
                return 200, json.dumps({"status": "ok"})
            case "GET", "/api/stats":
                return 200, json.dumps(store.stats() | {"workload": store.geometry().first().asDict()})
            case "GET", "/api/checkpoints":
                limit = [v for k, _, v in (x.partition("=") for x in query.split("&")) if k == "limit"]
                return 200, json.dumps([r.asDict() for r in store.list(int(limit[0]) if limit else 100).collect()])
            case "GET", "/metrics":
                return 200, store.metrics_text()
            case "GET", "/api/export":
                return 200, "[" + ",".join(exported(store)) + "]"
            case "POST", "/api/checkpoints":
                _only(given, APPEND_FIELDS)
                if not isinstance(given.get("messages"), list):
                    raise StoreError("Invalid", "messages must be a JSON array")
                dumped = [json.dumps(m, ensure_ascii=False, separators=(",", ":")) for m in given["messages"]]
                store.put(_text(given, "thread_id"), _text(given, "checkpoint_id"), given.get("checkpoint_no"), given.get("parent_checkpoint_id"), dumped)
                return 201, json.dumps({"checkpoint_id": given["checkpoint_id"]})
            case "POST", "/api/read":
                _only(given, {"thread_id", "checkpoint_id"})
                return 200, store.get(_text(given, "thread_id"), _text(given, "checkpoint_id"))
            case "POST", "/api/delete":
                _only(given, {"thread_id", "checkpoint_id", "confirm"})
                if given.get("confirm") != "delete-subtree":
                    raise StoreError("Invalid", 'confirm must equal "delete-subtree"')
                return 200, json.dumps({"deleted": store.prune(_text(given, "thread_id"), _text(given, "checkpoint_id"))})
            case "POST", "/api/verify":
                return 200, json.dumps(store.verify())
            case "POST", "/api/seal":
                return 200, json.dumps({"generation": store.seal()})
            case _:
                return 404, _error("NotFound", "no such route")
    except json.JSONDecodeError as e:
        return 400, _error("Invalid", str(e))
    except StoreError as e:
        return (APPEND_STATUS if path == "/api/checkpoints" else READ_STATUS).get(e.kind, 500), _error(e.kind, str(e))


def exported(store: Store):
    """All states as JSON texts, in order of their keys, a partition at a time: what a service would stream. Large stores
    export() to files."""
    for r in store.states().orderBy("thread_id", "checkpoint_id").toLocalIterator():
        yield r["state"]


def _page(store: Store) -> str:
    cells = "".join(f"<tr><td>{k}</td><td>{v}</td></tr>" for k, v in (store.stats() | store.geometry().first().asDict()).items())
    return f"<!doctype html><title>palimpsest</title><h1>Checkpoints</h1><table>{cells}</table>"


def _error(kind: str, message: str) -> str:
    return json.dumps({"error": message, "kind": kind})


def _only(given: dict, allowed: set[str]) -> None:
    if unknown := sorted(set(given) - allowed):
        raise StoreError("Invalid", f"unknown field {unknown[0]}")


def _text(given: dict, name: str) -> str:
    if not isinstance(given.get(name), str) or not given[name]:
        raise StoreError("Invalid", f"{name} must be a non-empty string")
    return given[name]


def command(store: Store, args: list[str], stdin=sys.stdin, out=sys.stdout) -> int:
    """put THREAD ID NO [PARENT], get THREAD ID, list [N], verify, fsck, stats, seal, export PATH, import PATH, import-jsonl PATH."""
    p = argparse.ArgumentParser(prog="palimpsest")
    p.add_argument("verb", choices=["put", "get", "list", "verify", "fsck", "stats", "seal", "export", "import", "import-jsonl", "prune"])
    p.add_argument("rest", nargs="*")
    a = p.parse_args(args)
    say = lambda x: print(x if isinstance(x, str) else json.dumps(x), file=out)
    try:
        match a.verb:
            case "put":
                thread, checkpoint, number, *parent = a.rest
                messages = json.load(stdin)
                if not isinstance(messages, list):
                    raise StoreError("Invalid", "messages must be a JSON array")
                store.put(thread, checkpoint, int(number), parent[0] if parent else None, [json.dumps(m, ensure_ascii=False, separators=(",", ":")) for m in messages])
            case "get":
                say(store.get(*a.rest))
            case "list":
                for r in store.list(int(a.rest[0]) if a.rest else 100).collect():
                    say(r.asDict())
            case "verify" | "fsck" | "stats":
                say(getattr(store, a.verb)())
            case "seal":
                say({"generation": store.seal()})
            case "prune":
                say({"deleted": store.prune(*a.rest)})
            case "export":
                store.export(*a.rest)
            case "import":
                say({"checkpoints": store.import_export(*a.rest)})
            case "import-jsonl":
                say(store.import_jsonl(*a.rest))
    except StoreError as e:
        print(e, file=sys.stderr)
        return 1
    return 0
