"""Review gate and manual entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_key, slug
from .validate import require_none, review_argument_errors


def decided_ids(approved: DataFrame, rejected: DataFrame) -> DataFrame:
    return approved.select("id").union(rejected.select("id")).distinct()


def pending(candidates: DataFrame, approved: DataFrame, rejected: DataFrame) -> DataFrame:
    return candidates.join(decided_ids(approved, rejected), "id", "left_anti")


def approve(candidates: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """The chosen candidates as approved chunks, with the time of review."""
    return candidates.join(ids.select("id").distinct(), "id", "left_semi").withColumns({"status": F.lit("approved"), "reviewed_at": at})


def decide(candidates: DataFrame, approve_ids: DataFrame, reject_ids: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(approved chunks, rejected ids); unknown ids and ids in both lists are errors."""
    require_none(review_argument_errors(approve_ids, reject_ids, candidates), "review arguments")
    return approve(candidates, approve_ids, at), reject_ids.select("id").distinct()


def tally(candidates: DataFrame, approved: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: approved, rejected, undecided."""
    a, r = approved.select("id").distinct().withColumn("a", F.lit(1)), rejected.select("id").distinct().withColumn("r", F.lit(1))
    both = candidates.select("id").distinct().join(a, "id", "left").join(r, "id", "left")
    return both.agg(F.count("a").alias("approved"), F.count("r").alias("rejected"), F.count_if(F.col("a").isNull() & F.col("r").isNull()).alias("undecided"))


def manual_chunks(entries: DataFrame) -> DataFrame:
    """Chunks of (question, answer, url, author, added_at), ids from the question unless given as ``id``."""
    text = F.concat("question", F.lit("\n\n"), "answer")
    own = F.concat(F.lit("manual:"), slug(F.col("question")))
    return entries.select(
        (F.coalesce("id", own) if "id" in entries.columns else own).alias("id"),
        F.lit("manual").alias("source_type"),
        F.col("question").alias("title"),
        text.alias("text"),
        "url",
        F.struct("question", "answer", "author", "added_at").alias("meta"),
        content_key(text).alias("content_hash"),
    )


def id_clashes(new: DataFrame, existing: DataFrame) -> DataFrame:
    return new.join(existing.select("id"), "id", "left_semi")


def replace_latest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, where a new row takes the place of an old one of its id."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("id").orderBy(F.desc("__age"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__age")
