"""HTTP service over a corpus: GET /health and POST /ask.

A request is one small batch of the engine: validated as a table, searched, drafted, resolved and logged.  For one question after another
over a hand-kept corpus; many questions at once are what ``plans.ask`` is for.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock

from pyspark.sql import DataFrame

from .operators import answers, validate
from .operators.plugins import hashed_embedding
from .operators.results import ResultStore
from .plans import ask as asking
from .plans.search import STRATEGIES, chunk_vectors, searcher
from .sources import writers
from .sources.schemas import LOG
from .storage import mark, release, scratch


class RequestError(Exception):
    """An answer with an HTTP status other than 200."""

    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


class Service:
    """chunks: an indexable corpus.  drafter and embedder: plugins.  log: a folder that request records are appended to.  store: vectors kept between services.

    The corpus is embedded once, for the first request that needs it; a request embeds its question.
    """

    def __init__(self, chunks: DataFrame, drafter: Callable, embedder: Callable | None = None, log: str | None = None, store: ResultStore | None = None):
        began = time.perf_counter()
        self.spark, self.chunks, self.log = chunks.sparkSession, chunks.cache(), log
        self.drafter, self.embedder, self.store, self.vectors = drafter, embedder or hashed_embedding(256), store, None
        self.turn = Lock()  # one request at a time: each removes the intermediate tables that it wrote
        self.strategies = sorted([*STRATEGIES, "stuffed", "refuse"])
        self.size = self.chunks.count()
        self.index_build_ms = int(1000 * (time.perf_counter() - began))

    def health(self) -> dict:
        return {"status": "ok", "corpus_chunks": self.size, "index_build_ms": self.index_build_ms, "strategies": self.strategies}

    def ask(self, request: dict) -> dict:
        with self.turn:
            if request.get("strategy") in ("dense", "hybrid") and self.vectors is None:
                self.vectors = scratch(chunk_vectors(self.chunks, self.embedder, self.store), "service-vectors")
            since = mark()
            try:
                return self.answer(request)
            finally:
                release(self.spark, since)

    def answer(self, request: dict) -> dict:
        question, strategy, max_chunks = request.get("question"), request.get("strategy", "bm25"), request.get("max_chunks", answers.MAX_CHUNKS)
        if not isinstance(question, str) or not isinstance(strategy, str) or not isinstance(max_chunks, int):
            raise RequestError(422, "question and strategy are strings, max_chunks is a number")
        one = self.spark.createDataFrame([(0, question, strategy, max_chunks)], "question_id long, question string, strategy string, max_chunks int")
        error = validate.request_errors(one, self.strategies).first().error
        if error:
            raise RequestError(422, f"{error} is not valid" + (f"; strategies: {self.strategies}" if error == "strategy" else ""))
        one, began = one.select("question_id", "question"), time.perf_counter()
        if strategy == "refuse":
            done = answers.refusals(one)
        elif strategy == "stuffed":
            done = asking.ask_stuffed(one, self.chunks, self.drafter)
        else:
            done = asking.ask(one, self.chunks, self.drafter, strategy, max_chunks, searcher(strategy, self.embedder, self.store, self.vectors))
        answer = done.first()
        took = int(1000 * (time.perf_counter() - began))
        given = self.spark.createDataFrame([(0, answer.citations)], "question_id long, citations array<string>")
        known = {r.chunk_id: r for r in answers.resolve_citations(given, self.chunks).collect()}
        unresolved = [c for c in answer.citations if c not in known]
        self.record(question, strategy, answer, took, unresolved)
        if unresolved:
            raise RequestError(500, f"the answer cites unknown chunks {unresolved}")
        shown = ("chunk_id", "url", "title", "source_type", "published")
        citations = [{k: known[c][k] for k in shown} for c in answer.citations]
        return {"answer": answer.text, "citations": citations, "refused": answer.refused, "confidence": answer.confidence, "strategy": strategy, "latency_ms": took}

    def record(self, question: str, strategy: str, answer, took: int, unresolved: list[str]) -> None:
        if self.log:
            row = (datetime.now(UTC), question, strategy, answer.retrieved, answer.citations, answer.refused, answer.confidence, took, unresolved)
            writers.append_log(self.spark.createDataFrame([row], LOG), self.log)

    def server(self, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
        """A server that is bound and not yet running; port 0 takes a free one."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def reply(self, status: int, body: dict) -> None:
                data = json.dumps(body, ensure_ascii=False).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self) -> None:
                self.reply(200, service.health()) if self.path == "/health" else self.reply(404, {"detail": "not found"})

            def do_POST(self) -> None:
                if self.path != "/ask":
                    self.reply(404, {"detail": "not found"})
                    return
                try:
                    request = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                    self.reply(200, service.ask(request if isinstance(request, dict) else {}))
                except json.JSONDecodeError:
                    self.reply(422, {"detail": "the body is not JSON"})
                except RequestError as e:
                    self.reply(e.status, {"detail": e.detail})

            def log_message(self, *args) -> None:
                pass

        return ThreadingHTTPServer((host, port), Handler)
