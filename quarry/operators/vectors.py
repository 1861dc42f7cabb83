"""Exact dense search that turns most vectors away: vectors are kept around centres, and the triangle inequality decides which centres a question opens.

A centre's vectors lie within its radius. On the unit sphere a vector of that centre is at least (question to centre) - radius away from the question, so once a
question has k vectors, centres that begin beyond the k-th can't add any. What is scored is scored as retrieve.dense does, and the result is the same; how much is turned away
depends on how far apart the data's clusters are. Zero vectors score 0 for every question and are kept apart.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import broadcast
from .common import top_k
from .retrieve import best_products, plain, plain_ids, unit

CENTRES = 64  # vectors of the data, the first by a hash of their ids: a documented, bounded sample
PROBES = 2  # centres that each question opens first
ZERO = -1  # the centre of zero vectors
SLACK = 1e-5  # of a distance, for rounding


class VectorIndex:
    """Vectors (id, embedding) below ``path``, by centre."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, vectors: DataFrame, centres: int = CENTRES) -> None:
        """Deal the vectors to their nearest centres.  Vectors without components are left out, as in retrieve.dense."""
        rows = vectors.select("id", "embedding").where("size(embedding) > 0")
        chosen = rows.orderBy(F.xxhash64("id"), "id").limit(centres).collect()
        middle = unit(np.array([r.embedding for r in chosen], dtype=np.float64).reshape(len(chosen), -1))
        middle = np.unique(middle[np.any(middle != 0, axis=1)], axis=0)
        shared = broadcast(self.spark, middle)

        def deal(batches):
            import pyarrow as pa

            for b in batches:
                v = unit(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1))
                near = v @ shared.value.T if len(shared.value) else np.full((len(v), 1), 0.0)
                at = np.where(np.any(v != 0, axis=1), near.argmax(axis=1), ZERO)
                away = np.sqrt(np.maximum(0.0, 2 - 2 * near.max(axis=1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(away), pa.array(at.astype(np.int32))], ["id", "embedding", "away", "centre"])

        schema = T.StructType([rows.schema["id"], rows.schema["embedding"], T.StructField("away", T.DoubleType()), T.StructField("centre", T.IntegerType())])
        rows.mapInArrow(deal, schema).hint("rebalance", "centre").write.partitionBy("centre").parquet(f"{self.path}/vectors")
        dealt = self.spark.read.parquet(f"{self.path}/vectors")
        names = self.spark.createDataFrame([(i, v) for i, v in enumerate(middle.tolist())], "centre int, middle array<double>")
        dealt.groupBy("centre").agg(F.max("away").alias("radius"), F.count("*").alias("n")).join(names, "centre", "left").write.parquet(f"{self.path}/centres")

    def scored(self, rows: DataFrame, asked: np.ndarray, questions: np.ndarray, opened: np.ndarray, places: list[int], k: int, exclude_self: bool, schema: T.StructType) -> DataFrame:
        """(question_id, id, score): each task's k best of each question in the centres that it opens.  opened: questions by ``places``."""
        wanted = {c: np.flatnonzero(opened[:, j]) for j, c in enumerate(places) if opened[:, j].any()}
        shared = broadcast(self.spark, (asked, questions, wanted))

        def run(batches):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_type

            arrow = [to_arrow_type(f.dataType) for f in schema.fields]
            asked, questions, wanted = shared.value
            for b in batches:
                keys, centre = plain(b.column(0)), b.column(2).to_numpy(zero_copy_only=False)
                v = unit(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1))
                for c in np.unique(centre):
                    mine = np.flatnonzero(centre == c)
                    who = wanted[c]
                    for q, at, scores in best_products(asked[who], questions[who], keys[mine], v[mine], k, exclude_self):
                        yield pa.RecordBatch.from_arrays([pa.array(asked[who[q]].tolist(), arrow[0]), pa.array(keys[mine[at]].tolist(), arrow[1]), pa.array(scores)], schema.names)

        return rows.where(F.col("centre").isin([int(c) for c in wanted])).select("id", "embedding", "centre").mapInArrow(run, schema)

    def search(self, question_vectors: DataFrame, k: int = 10, exclude_self: bool = False, block_bytes: int = 64 << 20) -> DataFrame:
        """(question_id, id, score, rank), as retrieve.dense.  Questions go in blocks of up to ``block_bytes``; of a block its k best so far pass through the driver."""
        rows = self.spark.read.parquet(f"{self.path}/vectors")
        known = sorted(self.spark.read.parquet(f"{self.path}/centres").collect(), key=lambda r: r.centre)  # a row for each centre
        places = [r.centre for r in known]
        middle = np.array([r.middle for r in known if r.centre != ZERO])
        radius, n = np.array([r.radius for r in known if r.centre != ZERO]), np.array([r.n for r in known])
        schema = T.StructType([T.StructField("question_id", question_vectors.schema["question_id"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])
        self.read = [0, 0]
        parts = []

        def block(held: list) -> None:
            asked, q = plain_ids([r[0] for r in held]), unit(np.array([r[1] for r in held], dtype=np.float64))
            away = np.sqrt(np.maximum(0.0, 2 - 2 * q @ middle.T)) if len(middle) else np.zeros((len(q), 0))
            begins = np.where(np.any(q != 0, axis=1)[:, None], away - radius[None, :], 0.0)
            first = np.zeros((len(q), len(places)), dtype=bool)
            skip = len(places) - len(middle)  # the place of zero vectors comes first
            first[:, :skip] = True
            nearest = np.argsort(begins, axis=1, kind="stable")[:, :PROBES] + skip
            np.put_along_axis(first, nearest, True, axis=1)
            best = top_k(self.scored(rows, asked, q, first, places, k, exclude_self, schema), ["question_id"], [F.desc("score"), F.asc("id")], k).drop("rank").collect()
            best = self.spark.createDataFrame(best, schema)
            least = {r.question_id: r.least for r in best.groupBy("question_id").agg(F.min("score").alias("least"), F.count("*").alias("c")).where(F.col("c") >= k).collect()}
            reach = np.array([np.sqrt(max(0.0, 2 - 2 * least[a])) if a in least else np.inf for a in asked.tolist()])
            then = np.zeros_like(first)
            then[:, skip:] = begins <= reach[:, None] + SLACK
            then &= ~first
            self.read[0] += int((first | then).astype(np.int64) @ n @ np.ones(len(q), np.int64))
            self.read[1] += int(n.sum() * len(q))
            parts.append(best)
            if then.any():
                parts.append(self.scored(rows, asked, q, then, places, k, exclude_self, schema))

        held, size = [], 0
        for r in question_vectors.select("question_id", "embedding").where("size(embedding) > 0").toLocalIterator():
            held.append(r)
            size += 8 * len(r[1])
            if size >= block_bytes:
                block(held)
                held, size = [], 0
        if held:
            block(held)
        out = self.spark.createDataFrame([], schema)
        for part in parts:
            out = out.unionByName(part)
        return top_k(out, ["question_id"], [F.desc("score"), F.asc("id")], k)

    def share_read(self) -> float:
        """Of the vectors that a scan would score, the share that the last search scored."""
        return self.read[0] / max(1, self.read[1])
