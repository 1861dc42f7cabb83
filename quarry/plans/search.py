"""One search function per strategy name, over a corpus and an embedder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import question_key
from ..operators import plugins, retrieve
from ..operators.postings import PostingIndex
from ..operators.results import ResultStore

STRATEGIES = ("stub", "bm25", "dense", "hybrid")


def embedded(df: DataFrame, key: str, text: str, embedder: Callable, store: ResultStore | None = None, hashed: Column | None = None) -> DataFrame:
    """(key, embedding) of every row; with a store only texts that it lacks are embedded.  hashed: the text's key there, if a column holds it."""
    if store:
        source = df.select(key, text, *([hashed.alias("__hash")] if hashed is not None else []))
        found = store.ask(source, text, embedder, key=F.col("__hash") if hashed is not None else None)
    else:
        found = plugins.call(df.select(key, text), text, "array<float>", embedder)
    return found.select(key, F.col("result").alias("embedding"))


def chunk_vectors(chunks: DataFrame, embedder: Callable, store: ResultStore | None = None) -> DataFrame:
    """(id, embedding); a chunk's content hash is the key of its text."""
    return embedded(chunks, "id", "text", embedder, store, F.col("content_hash") if "content_hash" in chunks.columns else None)


def searcher(strategy: str, embedder: Callable | None = None, store: ResultStore | None = None, vectors: DataFrame | None = None, index: PostingIndex | None = None) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """(questions, chunks, k) to a ranking.  dense and hybrid embed the chunks' text with ``embedder``.

    store: where vectors of chunks and questions are kept between searches.  vectors: (id, embedding) of the chunks, if they are there already.
    index: kept postings of the chunks, for bm25.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {sorted(STRATEGIES)}")
    embedder = embedder or plugins.hashed_embedding(256)

    def dense(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
        mine = embedded(questions, "question_id", "question", embedder, store, question_key(F.col("question")))
        return retrieve.dense(mine, chunk_vectors(chunks, embedder, store) if vectors is None else vectors, k)

    if strategy == "dense":
        return dense
    if strategy == "hybrid":
        return lambda q, c, k: retrieve.hybrid(q, c, lambda depth: dense(q, c, depth), k)
    if strategy == "bm25" and index:
        return lambda q, c, k: retrieve.ranked(index.search(q, k).select("question_id", "id", F.col("id").alias("order"), "score"), q, c, k, "id", True)
    return lambda q, c, k: retrieve.retriever(strategy)(q, c, k)
