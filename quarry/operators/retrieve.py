"""Ranked retrieval of many questions at once.

Questions: (question_id, question).  Chunks: (id, text) with optional title; ties go to the
smaller ``order`` column, by default the id.  Every retriever gives (question_id, id, score, rank).
Scores are rounded to six decimals before ranking, so the order of summation can't swap ranks.

A chunk is one row, so nothing of it needs to travel: ``match`` reads and tokenises the chunks once, counts the questions' terms
in each of them and writes (id, length, terms, counts), a fraction of the texts.  Document frequencies and the mean length come from
that table, and both rankings score it in place: a task keeps the k best of each question, and only those are shuffled.
Up to BROADCAST_ROWS terms of questions are broadcast; more go through postings and joins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_set, tokens
from ..storage import broadcast, scratch
from .common import is_small, parts_of, small, top_k

BM25_K1, BM25_B = 1.5, 0.75
RRF_K, RRF_DEPTH = 60, 30
DIGITS = 6
BLOCK_CHUNKS, BLOCK_QUESTIONS = 512, 4096  # scored at once: 16 MB
DENSE_QUESTIONS, DENSE_VECTORS = 1024, 512  # of a matrix product: 4 MB
_TOKEN = re.compile("[a-z0-9]+")


def question_terms(questions: DataFrame) -> DataFrame:
    """(question_id, term, qtf)."""
    return questions.select("question_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qtf"))


def _body(chunks: DataFrame, order: str = "id") -> DataFrame:
    text = F.concat_ws(" ", F.col("title"), F.col("text")) if "title" in chunks.columns else F.col("text")
    return chunks.select(*dict.fromkeys(("id", order)), text.alias("body"))


def matched_postings(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, id, tf, dl) of the wanted terms only: with terms broadcast other tokens never leave the scan's stage."""
    docs = _body(chunks).select("id", tokens(F.col("body")).alias("words"))
    docs = docs.select("id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    return docs.join(terms, "term").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


POSTINGS_AT_ONCE = 100_000  # rows of a batch


def build_postings(chunks: DataFrame) -> DataFrame:
    """The whole inverted list (term, id, tf, dl).  Terms are counted where the text is, so nothing is shuffled."""
    from pyspark.sql import types as T

    def run(batches):
        import pyarrow as pa

        def batch(places, terms, tfs, dls, ids):
            taken = ids.take(pa.array(places, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), taken, pa.array(tfs, pa.int64()), pa.array(dls, pa.int32())], ["term", "id", "tf", "dl"])

        for b in batches:
            rows = [], [], [], []
            for place, text in enumerate(b.column(1)):
                words = _TOKEN.findall((text.as_py() or "").lower())
                held = Counter(words)
                for column, values in zip(rows, ([place] * len(held), held.keys(), held.values(), [len(words)] * len(held)), strict=True):
                    column.extend(values)
                if len(rows[0]) >= POSTINGS_AT_ONCE:
                    yield batch(*rows, b.column(0))
                    rows = [], [], [], []
            yield batch(*rows, b.column(0))

    schema = T.StructType([T.StructField("term", T.StringType()), chunks.schema["id"], T.StructField("tf", T.LongType()), T.StructField("dl", T.IntegerType())])
    return _body(chunks).select("id", "body").mapInArrow(run, schema)


def corpus_stats(chunks: DataFrame) -> tuple[int, float]:
    """Number of chunks and mean number of tokens: one row from one scan."""
    n, mean = _body(chunks).agg(F.count("*"), F.avg(F.size(tokens(F.col("body"))))).first()
    return n, mean or 0.0


def term_stats(postings: DataFrame, n: int) -> DataFrame:
    """(term, df, idf)."""
    df = F.col("df")
    idf = F.greatest(F.lit(0.0), F.ln(1 + (n - df + 0.5) / (df + 0.5)))
    return postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf)


@dataclass
class Matches:
    """Where chunks hold the terms of questions.  table: id, order, dl, terms (numbers) and tfs of every chunk."""

    table: DataFrame
    order: str
    questions: list  # ids
    asked: list  # (question's place, term's number, times it is asked)
    n: int
    mean: float
    df: np.ndarray  # of each term


def match(questions: DataFrame, chunks: DataFrame, order: str = "id") -> Matches | None:
    """One pass over the chunks for all questions; None where the questions' terms are too many to broadcast."""
    from pyspark.sql import types as T

    asked = question_terms(questions)
    if not is_small(asked):
        return None
    spark = chunks.sparkSession
    rows = asked.collect()  # BROADCAST_ROWS at most
    ids = sorted({r.question_id for r in rows})
    place = {q: i for i, q in enumerate(ids)}
    number: dict[str, int] = {}
    pairs = [(place[r.question_id], number.setdefault(r.term, len(number)), r.qtf) for r in rows]
    shared = broadcast(spark, number)

    def run(batches):
        import pyarrow as pa

        known = shared.value
        for b in parts_of(batches):
            lengths, offsets, terms, counts = [], [0], [], []
            for text in b.column(2):
                words = _TOKEN.findall((text.as_py() or "").lower())
                held = Counter(words)
                found = sorted((known[w], c) for w, c in held.items() if w in known)
                lengths.append(len(words))
                terms += [t for t, _ in found]
                counts += [c for _, c in found]
                offsets.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lengths, pa.int32()), *lists], ["id", "order", "dl", "terms", "tfs"])

    kinds = [T.StructField(n, chunks.schema[c].dataType) for n, c in (("id", "id"), ("order", order))]
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([*kinds, T.StructField("dl", T.IntegerType()), T.StructField("terms", numbers), T.StructField("tfs", numbers)])
    body = _body(chunks, order).select("id", F.col(order).alias("order"), "body")
    table = scratch(body.mapInArrow(run, schema), "matches")
    n, mean = table.agg(F.count("*"), F.avg("dl")).first()
    df = np.zeros(len(number))
    for t, c in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term
        df[t] = c
    return Matches(table, order, ids, pairs, n, mean or 0.0, df)


def best_of(found: Matches, k: int, weight: np.ndarray, value: Callable) -> DataFrame:
    """(question_id, id, order, score) of each task's k best chunks of each question.

    A chunk's score is the sum of weight (of an asked term) times value(tf, dl).
    """
    from pyspark.sql import types as T

    asked = np.array(found.asked, dtype=np.int64).reshape(-1, 3)
    blocks = []
    for low in range(0, len(found.questions), BLOCK_QUESTIONS):
        mine = np.flatnonzero((asked[:, 0] >= low) & (asked[:, 0] < low + BLOCK_QUESTIONS))
        mine = mine[np.argsort(asked[mine, 1], kind="stable")]
        first = np.searchsorted(asked[mine, 1], np.arange(len(found.df) + 1))
        blocks.append((low, min(BLOCK_QUESTIONS, len(found.questions) - low), first, asked[mine, 0] - low, weight[mine]))
    shared = broadcast(found.table.sparkSession, (found.questions, blocks))
    fields = [found.table.schema["id"], found.table.schema["order"]]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        questions, blocks = shared.value
        kinds = [to_arrow_type(f.dataType) for f in fields]
        held = [(np.zeros(0, int), np.zeros(0), np.zeros(0, object), np.zeros(0, object)) for _ in blocks]

        def first_k(q, score, order, ids):
            """The k best of each question."""
            at = sorted(range(len(q)), key=lambda i: (q[i], -score[i], order[i])) if order.dtype == object else np.lexsort((order, -score, q))
            q, score, order, ids = q[at], score[at], order[at], ids[at]
            start = np.searchsorted(q, q, "left")
            on = np.arange(len(q)) - start < k
            return q[on], score[on], order[on], ids[on]

        for b in batches:
            ids, orders = (plain(b.column(i)) for i in (0, 1))
            dl = b.column(2).to_numpy(zero_copy_only=False)
            sizes = np.diff(b.column(3).offsets.to_numpy())
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            terms, tfs = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (3, 4))
            for low in range(0, len(ids), BLOCK_CHUNKS):
                high = min(len(ids), low + BLOCK_CHUNKS)
                a, z = offsets[low], offsets[high]
                chunk = np.repeat(np.arange(high - low), sizes[low:high])
                values = value(tfs[a:z].astype(float), np.repeat(dl[low:high], sizes[low:high]).astype(float))
                for n, (_, width, first, who, w) in enumerate(blocks):
                    times = first[terms[a:z] + 1] - first[terms[a:z]]
                    at = np.repeat(first[terms[a:z]] - np.cumsum(times) + times, times) + np.arange(times.sum())
                    cell = np.repeat(chunk, times) * width + who[at]
                    sums = np.bincount(cell, np.repeat(values, times) * w[at], (high - low) * width).reshape(high - low, width)
                    sums = np.round(np.where(np.bincount(cell, minlength=sums.size).reshape(sums.shape) > 0, sums, -1.0), DIGITS)
                    least = np.zeros(width) if high - low <= k else np.maximum(0.0, -np.partition(-sums, k - 1, axis=0)[k - 1])
                    c, q = np.nonzero(sums >= least)
                    old = held[n]
                    new = (q, sums[c, q], orders[low:high][c], ids[low:high][c])
                    held[n] = first_k(*(np.concatenate(x) if len(x[0]) else x[1] for x in zip(old, new, strict=True)))
        for (low, *_), (q, score, order, ids) in zip(blocks, held, strict=True):
            names = [questions[low + i] for i in q]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(ids.tolist(), kinds[0]), pa.array(order.tolist(), kinds[1]), pa.array(score)], ["question_id", "id", "order", "score"]
            )

    kind = T._infer_type(found.questions[0]) if found.questions else T.LongType()
    schema = T.StructType([T.StructField("question_id", kind), *fields, T.StructField("score", T.DoubleType())])
    return found.table.mapInArrow(run, schema)


def plain(column) -> np.ndarray:
    """An Arrow column as a numpy array; strings as objects."""
    import pyarrow as pa

    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        return column.to_numpy(zero_copy_only=False)
    out = np.empty(len(column), dtype=object)
    out[:] = column.to_pylist()
    return out


def fill_zeros(best: DataFrame, questions: DataFrame, chunks: DataFrame, k: int, order: str) -> DataFrame:
    """Rank by score; questions with under k scored chunks get the first others, scored 0.

    best: (question_id, id, order, score), the k best scored ones of each question at least.  Of the first k chunks in corpus order
    at most the scored ones can't serve, so no others are needed.
    """
    first = chunks.select("id", F.col(order).alias("__order")).orderBy("__order").limit(k).collect()  # k ids
    kinds = f"array<struct<id:{chunks.schema['id'].dataType.simpleString()},order:{chunks.schema[order].dataType.simpleString()}>>"
    rows = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(o).alias("order")) for i, o in first]).cast(kinds) if first else F.array().cast(kinds)
    blank = questions.select("question_id", F.inline(rows)).join(best.select("question_id", "id"), ["question_id", "id"], "left_anti")
    return best.unionByName(blank.withColumn("score", F.lit(0.0)))


def ranked(best: DataFrame, questions: DataFrame, chunks: DataFrame, k: int, order: str, zero_fill: bool) -> DataFrame:
    if zero_fill:
        best = fill_zeros(best, questions, chunks, k, order)
    return top_k(best, ["question_id"], [F.desc("score"), F.asc("order")], k).select("question_id", "id", "score", "rank")


def with_order(scored: DataFrame, chunks: DataFrame, order: str) -> DataFrame:
    return scored.join(chunks.select("id", F.col(order).alias("order")), "id") if order != "id" else scored.withColumn("order", F.col("id"))


def lexical(questions: DataFrame, chunks: DataFrame, k: int = 10, zero_fill: bool = True, matches: Matches | None = None) -> DataFrame:
    """Number of distinct question tokens that text and title hold; ties by id.  matches: of these questions and chunks, to share one pass."""
    matches = matches or match(questions, chunks)
    if matches:
        best = best_of(matches, k, np.ones(len(matches.asked)), lambda tf, dl: np.ones_like(tf))
    else:
        asked = questions.select("question_id", F.explode(token_set(F.col("question"))).alias("term"))
        docs = _body(chunks).select("id", F.explode(token_set(F.col("body"))).alias("term"))
        scored = docs.join(small(asked), "term").groupBy("question_id", "id").agg(F.count("*").cast("double").alias("score"))
        best = with_order(scored, chunks, "id")
    return ranked(best, questions, chunks, k, "id", zero_fill)


def bm25_scores(questions: DataFrame, chunks: DataFrame, k1: float = BM25_K1, b: float = BM25_B, postings: DataFrame | None = None) -> DataFrame:
    """(question_id, id, score) of all chunks that hold a question token, by joins; repeated question tokens count again."""
    n, mean = corpus_stats(chunks)
    asked = question_terms(questions)
    hint = F.broadcast if is_small(asked) else lambda df: df  # what is joined below has no more rows than asked
    terms = hint(asked.select("term").distinct())
    hits = matched_postings(chunks, terms) if postings is None else postings.join(terms, "term", "left_semi")
    idf = term_stats(hits, n).select("term", "idf")  # df of a term counts all its chunks: hits hold every one
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean or 1.0))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / norm
    joined = hits.join(hint(asked.join(idf, "term")), "term")
    return joined.groupBy("question_id", "id").agg(F.round(F.sum(part), DIGITS).alias("score"))


def bm25(
    questions: DataFrame, chunks: DataFrame, k: int = 10, zero_fill: bool = True, order: str = "id", postings: DataFrame | None = None, k1: float = BM25_K1, b: float = BM25_B,
    matches: Matches | None = None,
) -> DataFrame:
    """Okapi BM25; with zero_fill every question gets k chunks if there are so many.

    matches: of these questions and chunks, to share one pass.  postings: the whole inverted list, written before.
    """
    matches = matches or (match(questions, chunks, order) if postings is None else None)
    if matches and matches.order == order:
        idf = np.maximum(0.0, np.log(1 + (matches.n - matches.df + 0.5) / (matches.df + 0.5)))
        weight = np.array([qtf * idf[t] for _, t, qtf in matches.asked])
        mean = matches.mean or 1.0
        best = best_of(matches, k, weight, lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean)))
    else:
        best = with_order(bm25_scores(questions, chunks, k1, b, postings), chunks, order)
    return ranked(best, questions, chunks, k, order, zero_fill)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def best_cells(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best scores of each row, ties to the smaller key; -inf is none."""
    least = np.full(len(scores), -2.0) if len(keys) <= k else -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    q, c = np.nonzero(scores >= np.maximum(least, -2.0)[:, None])
    at = np.lexsort((keys[c], -scores[q, c], q)) if keys.dtype != object else np.array(sorted(range(len(q)), key=lambda i: (q[i], -scores[q[i], c[i]], keys[c[i]])), dtype=int)
    q, c = q[at], c[at]
    on = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[on], c[on]


def best_products(asked: np.ndarray, questions: np.ndarray, keys: np.ndarray, v: np.ndarray, k: int, exclude_self: bool):
    """(places of questions, places of vectors, scores): the k best vectors of each question, from products of DENSE_QUESTIONS by DENSE_VECTORS.

    Past the first product only scores that can reach a question's k-th are rounded and kept, and the kept are ranked anew once they are twice the wanted.
    """
    for low in range(0, len(asked), DENSE_QUESTIONS):
        names, block = asked[low : low + DENSE_QUESTIONS], questions[low : low + DENSE_QUESTIONS]
        q, at, held, least = np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.full(len(names), -2.0)
        for first in range(0, len(keys), DENSE_VECTORS):
            mine = keys[first : first + DENSE_VECTORS]
            scores = block @ v[first : first + DENSE_VECTORS].T
            if exclude_self:
                scores[names[:, None] == mine[None, :]] = -np.inf
            near = np.flatnonzero(scores >= (least - 10**-DIGITS)[:, None]) if first else None  # what may be rounded up to the k-th, too
            if near is None or len(near) > 4 * k * len(names):
                scores = np.round(scores, DIGITS)
                new, c = best_cells(scores, mine, k)
                found = scores[new, c]
            else:
                new, c = np.divmod(near, len(mine))
                found = np.round(scores.ravel()[near], DIGITS)
            q, at, held = np.concatenate([q, new]), np.concatenate([at, c + first]), np.concatenate([held, found])
            if first and (len(q) > 2 * k * len(names) or first + DENSE_VECTORS >= len(keys)):
                o = np.lexsort((keys[at], -held, q)) if keys.dtype != object else np.array(sorted(range(len(q)), key=lambda i: (q[i], -held[i], keys[at[i]])), dtype=int)  # noqa: B023
                o = o[np.arange(len(o)) - np.searchsorted(q[o], q[o], "left") < k]
                q, at, held = q[o], at[o], held[o]
            elif first:
                continue
            full = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q, "left") == k - 1)
            least[q[full]] = held[full]  # what a later vector must reach
        yield q + low, at, held


def dense(question_vectors: DataFrame, vectors: DataFrame, k: int = 10, exclude_self: bool = False, block_bytes: int = 64 << 20) -> DataFrame:
    """Exact cosine top k.  question_vectors: (question_id, embedding), vectors: (id, embedding).

    Questions are broadcast in blocks of up to ``block_bytes``, each of which reads the vectors once; a task takes matrix
    products of 1,024 questions and 512 vectors at a time and keeps the k best of each question in a batch.  Ties go to the smaller id; a zero vector scores 0.
    """
    spark = vectors.sparkSession
    kinds = [question_vectors.schema["question_id"].dataType, vectors.schema["id"].dataType]
    schema = f"question_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score double"

    def search(block):
        asked = plain_ids([r[0] for r in block])
        shared = broadcast(spark, (asked, unit(np.array([r[1] for r in block], dtype=np.float64)).reshape(len(block), -1)))

        def run(batches):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_type

            arrow = [to_arrow_type(k) for k in kinds]
            asked, questions = shared.value
            for b in batches:
                keys = plain(b.column(0))
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                v = unit(v.reshape(len(keys), -1))
                for q, c, scores in best_products(asked, questions, keys, v, k, exclude_self):
                    yield pa.RecordBatch.from_arrays([pa.array(asked[q].tolist(), arrow[0]), pa.array(keys[c].tolist(), arrow[1]), pa.array(scores)], ["question_id", "id", "score"])

        return vectors.select("id", "embedding").where("size(embedding) > 0").mapInArrow(run, schema)

    out, block, held = None, [], 0
    for r in question_vectors.select("question_id", "embedding").where("size(embedding) > 0").toLocalIterator():
        block.append(r)
        held += 8 * len(r[1])
        if held >= block_bytes:
            out, block, held = search(block) if out is None else out.unionByName(search(block)), [], 0
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    if out is None:
        out = spark.createDataFrame([], schema)
    return top_k(out, ["question_id"], [F.desc("score"), F.asc("id")], k)


def neighbours(vectors: DataFrame, k: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """Exact cosine top k of every vector of ``vectors`` (id, embedding) among the vectors of other ids: (question_id, id, score, rank), ties and zero vectors as in ``dense``.

    Vectors are packed into blocks of about ``block_bytes`` by a hash of their ids, and each pair of blocks is one task: a task holds two blocks whatever the table's size, the vectors
    are shuffled once for all pairs, and none pass through the driver.  The work is the square of the number of vectors, as every pair is scored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["id"].dataType
    schema = f"question_id {kind.simpleString()}, id {kind.simpleString()}, score double"
    rows = vectors.select("id", "embedding").where("id is not null and size(embedding) > 0")
    n, parts = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    tasks = 3 * spark.sparkContext.defaultParallelism  # pairs of blocks, where there are vectors enough for so many
    blocks = max(1, -(-8 * n * parts // block_bytes), min(math.isqrt(tasks - 1) + 1, -(-n // DENSE_VECTORS)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartitionById(blocks, "block")
    packed = scratch(dealt.groupBy("block").agg(F.collect_list(F.struct("id", "embedding")).alias("held")), "vectors").repartitionById(blocks, "block")
    pairs = packed.toDF("block", "asked").hint("shuffle_replicate_nl").crossJoin(packed.toDF("other", "held"))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)

        def unpacked(cell):
            keys = plain(cell.values.field(0))
            return keys, unit(cell.values.field(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1))

        for b in batches:
            for one, asked, other, held in zip(*b.columns, strict=True):
                names, questions = unpacked(asked)
                keys, v = unpacked(held)
                for q, c, scores in best_products(names, questions, keys, v, k, one == other):  # equal ids are in one block
                    yield pa.RecordBatch.from_arrays([pa.array(names[q].tolist(), arrow), pa.array(keys[c].tolist(), arrow), pa.array(scores)], ["question_id", "id", "score"])

    return top_k(pairs.mapInArrow(run, schema), ["question_id"], [F.desc("score"), F.asc("id")], k)


def plain_ids(ids: list) -> np.ndarray:
    if all(isinstance(i, int) for i in ids):
        return np.array(ids, dtype=np.int64)
    out = np.empty(len(ids), dtype=object)
    out[:] = ids
    return out


def fuse(rankings: list[DataFrame], k: int = 10, depth: int = RRF_DEPTH, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of the first ``depth`` of each ranking; ties by id."""
    votes = None
    for r in rankings:
        r = r.where(F.col("rank") <= depth).select("question_id", "id", "rank")
        votes = r if votes is None else votes.unionByName(r)
    score = F.round(F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))), DIGITS + 2)
    fused = votes.groupBy("question_id", "id").agg(score.alias("score"))
    return top_k(fused, ["question_id"], [F.desc("score"), F.asc("id")], k)


def hybrid(questions: DataFrame, chunks: DataFrame, first: Callable[[int], DataFrame], k: int = 10, depth: int = RRF_DEPTH, matches: Matches | None = None) -> DataFrame:
    """Fusion of another ranking (first(depth)) with BM25, fillers included: they earn votes as any other place does."""
    return fuse([first(depth), bm25(questions, chunks, depth, matches=matches)], k, depth)


def rerank(ranked: DataFrame, scorer, depth: int = 30, k: int = 5) -> DataFrame:
    """The first ``depth`` reordered by scorer(Column of question, Column of text), cut to k."""
    scored = ranked.where(F.col("rank") <= depth).withColumn("score", scorer(F.col("question"), F.col("text"))).drop("rank")
    return top_k(scored, ["question_id"], [F.desc("score"), F.asc("id")], k)


def rerank_by_model(ranked: DataFrame, make: Callable, depth: int = 30, k: int = 5, pairs: int = 64) -> DataFrame:
    """As rerank, by a model that scores many pairs at once: make() loads it, once for each task, and gives a function of (questions, texts) to scores.

    A task hands it ``pairs`` pairs at a time, those of like length together, and puts the scores back in their rows.
    """
    from pyspark.sql import types as T

    first = ranked.where(F.col("rank") <= depth).drop("rank", "score")
    schema = T.StructType([*first.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        score = make()
        for pdf in batches:
            order = np.argsort(pdf["text"].str.len().fillna(0).to_numpy(), kind="stable")
            scores = np.empty(len(pdf))
            for low in range(0, len(pdf), pairs):
                at = order[low : low + pairs]
                part = pdf.iloc[at]
                scores[at] = score(part["question"].tolist(), part["text"].tolist())
            yield pdf.assign(score=np.round(scores, DIGITS))

    return top_k(first.mapInPandas(run, schema), ["question_id"], [F.desc("score"), F.asc("id")], k)


RETRIEVERS: dict[str, Callable] = {"stub": lexical, "bm25": bm25, "dense": dense, "hybrid": hybrid}


def retriever(name: str) -> Callable:
    if name not in RETRIEVERS:
        raise ValueError(f"unknown retriever {name!r}; one of {sorted(RETRIEVERS)}")
    return RETRIEVERS[name]
