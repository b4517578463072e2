"""Queries over HTTP: POST a statement to /query, or a JSON plan to /plan; the answer is {"size", "0" .. "n-1", "meta"}.

A fixed number of handlers share one Spark session; each request is a job group of its own, in the fair pool
``queries``, so a short statement doesn't wait for a long one. The engine keeps nothing between requests.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, HTTPServer

from .plans.dialect import Engine
from .plans.logical import Runner
from .results import QueryResult

PORT, HANDLERS = 9999, 16


class _Pooled(HTTPServer):
    def __init__(self, address: tuple[str, int], handler: type, workers: int) -> None:
        super().__init__(address, handler)
        self.pool = ThreadPoolExecutor(workers)

    def process_request(self, request: object, client_address: object) -> None:
        self.pool.submit(self._handle, request, client_address)

    def _handle(self, request: object, client_address: object) -> None:
        try:
            self.finish_request(request, client_address)
        except OSError:  # the client went
            pass
        finally:
            self.shutdown_request(request)


class QueryServer:
    """``QueryServer(engine).start()`` serves until ``stop()``. Port 0 takes a free one."""

    def __init__(self, engine: Engine, host: str = "127.0.0.1", port: int = PORT, handlers: int = HANDLERS) -> None:
        self.engine = engine
        self.http = _Pooled((host, port), self._handler(), handlers)
        self.port = self.http.server_address[1]
        self._thread = threading.Thread(target=self.http.serve_forever, daemon=True)

    def start(self) -> QueryServer:
        self._thread.start()
        return self

    def stop(self) -> None:
        self.http.shutdown()
        self.http.server_close()
        self.http.pool.shutdown(wait=False)

    def answer(self, path: str, text: str) -> dict:
        routes: dict[str, Callable[[], QueryResult]] = {"/query": lambda: self.engine.query(text), "/plan": lambda: QueryResult(Runner(self.engine.spark).run(text))}
        if path not in routes:
            raise ValueError(f"no such path: {path}")
        context = self.engine.spark.sparkContext
        context.setJobGroup(uuid.uuid4().hex, text[:200])
        context.setLocalProperty("spark.scheduler.pool", "queries")
        return routes[path]().as_wire()

    def _handler(self) -> type[BaseHTTPRequestHandler]:
        server = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self) -> None:  # noqa: N802
                text = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
                try:
                    code, out = 200, server.answer(self.path, text)
                except Exception as e:  # whatever is wrong with a request is its client's to know
                    code, out = 400, {"error": str(e).split("\n")[0]}
                body = json.dumps(out).encode()
                self.send_response(code)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args: object) -> None:
                pass

        return Handler
