"""Searches and documents as JSON, page by page, as a search box needs them."""

from __future__ import annotations

import json
import threading

from ..plans.query import build_query
from ..sources.schema import InvalidArgumentError
from .reader import IndexReader
from .writer import IndexWriter

PAGE_SIZE = 10
SHOWN = ("title", "url", "site", "description", "category")


def search_page(reader: IndexReader, text: str, page: int = 1, *, page_size: int = PAGE_SIZE) -> dict:
    """A page of hits with the stored fields that are shown, best first. ``total_hits`` counts hits up to this page's end; ``total_matches`` counts all."""
    page = max(1, page)
    query = build_query(text)
    result = reader.search(query, page * page_size, count_matches=True)
    rows = reader.search_with_stored(query, page_size, offset=(page - 1) * page_size).collect() if result.total_hits > (page - 1) * page_size else []
    hits = [{"doc_id": r.external_id, "score": f"{r.score:.4f}"} | {k: r[k] for k in SHOWN if k in r.__fields__} for r in rows]
    return {"query": text, "page": page, "page_size": page_size, "total_hits": result.total_hits, "total_matches": result.total_matches, "elapsed_ms": f"{result.elapsed_us / 1000:.2f}", "results": hits}


def search_json(reader: IndexReader, text: str, page: int = 1, **options) -> str:
    return json.dumps(search_page(reader, text, page, **options), ensure_ascii=False)


class Engine:
    """One writer and its current reader."""

    def __init__(self, writer: IndexWriter, *, first_id: int = 1000):
        self.writer, self._next, self._lock = writer, first_id, threading.Lock()
        self.reader = writer.refresh_reader()

    def add(self, document: str | dict) -> dict:
        """Add one document, given as JSON or a dict with a title or a content, and make it visible. Many should come as one DataFrame."""
        got = json.loads(document) if isinstance(document, str) else dict(document)
        if not got.get("title") and not got.get("content"):
            raise InvalidArgumentError("a document needs a title or a content")
        with self._lock:
            id_field = self.writer.options.external_id_field
            got.setdefault(id_field, str(self._next))
            self._next += 1
            self.writer.add_document({k: str(v) for k, v in got.items()})
            self.reader = self.writer.refresh_reader()
        return {"doc_id": got[id_field]}

    def search(self, text: str, page: int = 1) -> dict:
        return search_page(self.reader, text, page)

    def document(self, external_id: str) -> dict | None:
        return self.reader.get_document(external_id)


def serve(engine: Engine, port: int = 8080):
    """An HTTP server (not started): GET /api/search?q=&page=, GET /api/document/ID, POST /api/document."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, unquote, urlsplit

    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, body: dict) -> None:
            raw = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args) -> None:
            pass

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path == "/api/search":
                args = parse_qs(url.query)
                page = args.get("page", ["1"])[0]
                self.reply(200, engine.search(args.get("q", [""])[0], int(page) if page.lstrip("-").isdigit() else 1))
            elif url.path.startswith("/api/document/"):
                found = engine.document(unquote(url.path.removeprefix("/api/document/")))
                self.reply(200, found) if found is not None else self.reply(404, {"error": "not found"})
            else:
                self.reply(404, {"error": "not found"})

        def do_POST(self) -> None:
            try:
                self.reply(200, engine.add(self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()))
            except ValueError as e:
                self.reply(400, {"error": str(e)})

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
