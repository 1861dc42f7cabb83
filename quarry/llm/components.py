"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, new_scratch_path, scratch_at


ROWS_PER_FILE = 1_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b).  Large: neighbours above a node, small: those below it, move to the least one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    moved = both.join(low, "a")
    if large:
        return moved.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    kept = moved.select(F.col("b").alias("a"), F.col("low").alias("b"))
    own = low.select("a", F.col("low").alias("b"))
    return kept.unionByName(own).where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) to (id, component): the least id that edges lead to.

    Only ids with an edge to another id are returned.  Every round is written to the shared
    folder; the number of rounds grows with the logarithm of the components' size.
    """
    spark = edges.sparkSession
    path = new_scratch_path(spark, "edges")
    now = scratch_at(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    before, files = None, now.count() // ROWS_PER_FILE + 1  # rounds never add edges
    for _ in range(max_rounds):
        last, path = path, new_scratch_path(spark, "edges")
        now = scratch_at(_star(_star(now, True), False).coalesce(files), path)
        n, s = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_path(spark, last)
        if (n, s) == before:
            return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(
                now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        before = (n, s)
    raise RuntimeError("components did not settle")
