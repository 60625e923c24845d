"""The engine behind HTTP: JSON answers for listing, search, sources, collection, benchmark and import."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame

from haggle.engine import Engine


def rows(df: DataFrame) -> list[dict]:
    """Rows of a limited result."""
    return [json.loads(r) for r in df.toJSON().collect()]


def number(asked: dict, name: str, default: int) -> int:
    return int(asked.get(name, [default])[0])


def text(asked: dict, name: str, default: str | None = None) -> str | None:
    return asked.get(name, [default])[0]


#: Method, path, and what it does with the engine, the parameters and the path's name.
ROUTES = (
    ("GET", r"/", lambda e, q, _: {"service": "haggle", "collectors": sorted(e.collectors)}),
    ("GET", r"/products", lambda e, q, _: rows(e.products(limit=number(q, "limit", 50), offset=number(q, "offset", 0), platform=text(q, "platform"), data_source=text(q, "data_source")))),
    ("GET", r"/search", lambda e, q, _: rows(e.search(text(q, "q", ""), number(q, "limit", 50)))),
    ("GET", r"/sources", lambda e, q, _: rows(e.sources())),
    ("POST", r"/collect/([^/]+)", lambda e, q, name: e.collect(name, text(q, "q"), number(q, "limit", 50))),
    ("POST", r"/collect/([^/]+)/benchmark", lambda e, q, name: rows(e.benchmark(name, q.get("queries", ["coffee", "laptop", "shirt"]), number(q, "limit", 20)))),
    (
        "POST", r"/import/products",
        lambda e, q, _: {"saved_count": e.import_products(text(q, "file_path", ""), text(q, "data_source", ""), text(q, "source_url"), text(q, "source_license"), limit=number(q, "limit", 20))},
    ),
    ("POST", r"/import/saved", lambda e, q, _: e.import_saved(text(q, "file_path", ""), text(q, "data_source", "saved_html_import"), text(q, "source_url"))),
)


def answer(engine: Engine, method: str, path: str) -> tuple[int, object]:
    """Status and body of a request: 404 for unknown paths and names, 422 for bad parameters, 502 for a failed collection."""
    address = urlsplit(path)
    asked = parse_qs(address.query, keep_blank_values=True)
    for verb, pattern, act in ROUTES:
        found = re.fullmatch(pattern, address.path)
        if found and verb == method:
            try:
                return 200, act(engine, asked, unquote(found[1]) if found.groups() else None)
            except KeyError as error:
                return 404, {"detail": str(error.args[0])}
            except ValueError as error:
                return 422, {"detail": str(error)}
            except RuntimeError as error:
                return 502, {"detail": str(error)}
    return 404, {"detail": "not found"}


def server(engine: Engine, port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _run(self):
            status, body = answer(engine, self.command, self.path)
            raw = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _run  # noqa: N815

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
