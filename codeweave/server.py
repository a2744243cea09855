"""The read side over HTTP: JSON for overview, tree, graph, symbol, file, search and source."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from codeweave.plans.index import Views
from codeweave.sources.files import source_text


def answer(views: Views, root: str, url: str) -> tuple[int, object]:
    """(status, JSON value or text) of a path with its query."""
    parts = urlsplit(url)
    path = unquote(parts.path)
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    try:
        if path == "/api/overview":
            return 200, views.overview()
        if path == "/api/tree":
            return 200, rows(views.tree())
        if path == "/api/graph":
            nodes, edges = views.graph()
            return 200, {"nodes": rows(nodes), "edges": rows(edges)}
        if path == "/api/search":
            q = parse_qs(parts.query).get("q", [""])[0]
            return (200, rows(views.search(q))) if q else (422, {"error": "q is empty"})
        if path == "/api/patterns":
            return 200, views.patterns()
        if path.startswith("/api/symbol/"):
            found = rows(views.symbol(path.removeprefix("/api/symbol/")))
            return (200, found[0]) if found else (404, {"error": "no such symbol"})
        if path.startswith("/api/file/"):
            found = rows(views.file(path.removeprefix("/api/file/")))
            return (200, found[0]) if found else (404, {"error": "no such file"})
        if path.startswith("/api/source/"):
            return 200, source_text(root, path.removeprefix("/api/source/"))
    except PermissionError as e:
        return 403, {"error": str(e)}
    except FileNotFoundError:
        return 404, {"error": "no such file"}
    return 404, {"error": "no such page"}


def serve(views: Views, root: str, port: int = 8420) -> None:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, value = answer(views, root, self.path)
            data = value.encode() if isinstance(value, str) else json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; charset=utf-8" if isinstance(value, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    print(f"http://127.0.0.1:{port}/api/overview")
    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
