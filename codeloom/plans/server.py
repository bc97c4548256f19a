"""Questions by name over newline-delimited JSON-RPC 2.0: one request a line, one answer a line."""

from __future__ import annotations

import json
from typing import IO

from pyspark.sql import DataFrame

from codeloom.plans.engine import Engine

#: Rows of a table that an answer holds; whether there are more is said beside them.
ROWS = 200
# The tools by name, with the parameters each takes.
TOOLS = {
    "search_codebase": ("query", "limit"),
    "get_node_impact": ("target", "depth"),
    "get_capability_chain": ("target",),
    "list_api_endpoints": (),
    "get_architecture_overview": (),
    "get_code_quality": (),
    "get_documentation_health": (),
    "get_graph_diff": (),
    "execute_graph_query": ("mode", "text"),
}
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS, FAILED = -32700, -32600, -32601, -32602, -32603


def _table(df: DataFrame) -> dict:
    rows = df.limit(ROWS + 1).collect()
    return {"rows": [r.asDict(recursive=True) for r in rows[:ROWS]], "truncated": len(rows) > ROWS}


def answer(engine: Engine, line: str) -> dict | None:
    """The answer to one line; None to a notification."""
    try:
        request = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "no JSON"}}
    if not isinstance(request, dict) or not isinstance(request.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID_REQUEST, "message": "no request"}}
    method, params, key = request["method"], request.get("params") or {}, request.get("id")
    fail = lambda code, message: {"jsonrpc": "2.0", "id": key, "error": {"code": code, "message": message}}
    if method == "tools/list":
        result = {"tools": [{"name": n, "parameters": list(p)} for n, p in TOOLS.items()]}
    else:
        if method == "tools/call":
            method, params = (params.get("name"), params.get("arguments") or {}) if isinstance(params, dict) else (None, {})
        if method not in TOOLS:
            return fail(NO_METHOD, f"no tool {method}")
        if not isinstance(params, dict) or not set(params) <= set(TOOLS[method]):
            return fail(INVALID_PARAMS, f"{method} takes {', '.join(TOOLS[method]) or 'nothing'}")
        try:
            result = _table(getattr(engine, method)(**params))
        except TypeError as e:
            return fail(INVALID_PARAMS, str(e))
        except Exception as e:
            return fail(FAILED, str(e).split("\n")[0])
    return None if "id" not in request else {"jsonrpc": "2.0", "id": key, "result": result}


def serve(engine: Engine, source: IO[str], sink: IO[str]) -> None:
    """Answer lines until the source ends; blank lines are passed over."""
    for line in source:
        if line.strip() and (out := answer(engine, line)) is not None:
            sink.write(json.dumps(out, default=str) + "\n")
            sink.flush()
