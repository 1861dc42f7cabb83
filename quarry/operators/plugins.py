"""Model calls behind functions: embed, draft, grade and extract, each with a deterministic stand-in.

A plugin is a function of a pandas batch that runs in mapInPandas, so a client is made once per
task.  Rows that a plugin fails on twice come back null.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call(df: DataFrame, column: str, schema: str, make: Callable, attempts: int = 2, timed: str | None = None, strict: bool = False) -> DataFrame:
    """``df`` with ``result``: make() gives a function of one value; null after ``attempts`` failures.

    A tuple may lack the schema's last fields.  timed: a column for the milliseconds that a row took.  strict: a failure ends the run.
    """
    from pyspark.sql import types as T

    result = T._parse_datatype_string(schema)
    width = len(result.fields) if isinstance(result, T.StructType) else 0
    out = T.StructType([*df.schema.fields, T.StructField("result", result), *([T.StructField(timed, T.LongType())] if timed else [])])

    def run(batches):
        f = make()

        def one(x):
            for attempt in range(attempts):
                try:
                    found = f(x)
                    return (*found, *[None] * (width - len(found))) if width and isinstance(found, tuple) else found
                except Exception:  # a failed call or an answer that doesn't parse
                    if strict and attempt == attempts - 1:
                        raise
            return None

        for pdf in batches:
            results, took = [], []
            for x in pdf[column]:
                began = time.perf_counter()
                results.append(one(x))
                took.append(int(1000 * (time.perf_counter() - began)))
            columns = {"result": pd.Series(results, index=pdf.index, dtype=object)} | ({timed: took} if timed else {})
            yield pdf.assign(**columns)

    return df.mapInPandas(run, out)


def hashed_embedding(dim: int = 16) -> Callable:
    """Stand-in embedder: signed token hashes."""

    def make():
        def embed(text: str) -> list[float]:
            v = [0.0] * dim
            for w in text.lower().split():
                h = hashlib.md5(w.encode()).digest()
                v[h[0] % dim] += 1.0 if h[1] & 1 else -1.0
            return v

        return embed

    return make


def cache_misses(items: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """items (key, text) without a vector of ``model``; one row per key."""
    have = cache.where(F.col("model") == model).select("key")
    return items.dropDuplicates(["key"]).join(have, "key", "left_anti")


def cache_hits(asked: DataFrame, cache: DataFrame, model: str, order: str = "pos") -> DataFrame:
    """asked (key, and its place among the requests) with the cached vectors of ``model``, in the order of the requests."""
    return asked.join(cache.where(F.col("model") == model).drop("model"), "key").orderBy(order)


def http_answerer(base_url: str, strategy: str, max_chunks: int = 5, timeout: float = 180.0) -> Callable:
    """Plugin from a question to (text, citations, refused, confidence) of a running service; an HTTP error is raised."""

    def make():
        from urllib.request import Request, urlopen

        def answer(question: str) -> tuple:
            body = json.dumps({"question": question, "strategy": strategy, "max_chunks": max_chunks}).encode()
            request = Request(base_url.rstrip("/") + "/ask", body, {"Content-Type": "application/json"})
            with urlopen(request, timeout=timeout) as response:
                data = json.load(response)
            return data["answer"], [c["chunk_id"] for c in data["citations"]], data["refused"], float(data["confidence"])

        return answer

    return make
