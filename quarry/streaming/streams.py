"""Streams: gap sessions, request-log windows, first rows of an id, resumable review, embedding misses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.plugins import cache_misses
from ..sources.schemas import LOG


def read_log_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).json(path)


def gap_session_stream(events: DataFrame, ts: str, key: str, minutes: int = 45, late: str = "1 hour") -> DataFrame:
    """(key, start, finish, messages): sessions that end when no message follows within ``minutes``.

    A message exactly ``minutes`` later still belongs to the session.  Sessions are by event time and
    are given once the watermark has passed them.
    """
    windows = events.withWatermark(ts, late).groupBy(F.session_window(ts, f"{minutes} minutes").alias("w"), key)
    return windows.agg(F.count("*").alias("messages")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "messages")


def log_windows(log: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, strategy, requests, refusal_rate, mean_latency_ms) per window."""
    g = log.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "strategy")
    out = g.agg(F.count("*").alias("requests"), F.avg(F.col("refused").cast("double")).alias("refusal_rate"), F.avg("latency_ms").alias("mean_latency_ms"))
    return out.select(F.col("w.start").alias("start"), "strategy", "requests", "refusal_rate", "mean_latency_ms")


def first_of_id(stream: DataFrame, id_col: str, ts: str, late: str = "1 day") -> DataFrame:
    """The first row of each id; state is dropped after ``late``."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_col])


def review_stream(candidates: DataFrame, decided: Callable[[], DataFrame], handle: Callable[[DataFrame], None], checkpoint: str):
    """Give each micro-batch's undecided candidates to ``handle``; decisions are read anew every time."""

    def batch(df: DataFrame, _: int) -> None:
        handle(df.join(decided().select("id"), "id", "left_anti"))

    return candidates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embedding_stream(items: DataFrame, read_cache: Callable[[], DataFrame], model: str, embed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Append vectors of the keys that ``model``'s cache lacks.  items: key, text; embed gives (model, key, embedding).

    A batch that is run again after a failure finds its vectors in the cache and adds none.
    """

    def batch(df: DataFrame, _: int) -> None:
        embed(cache_misses(df, read_cache(), model)).write.mode("append").parquet(path)

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run what is available now into Parquet files under ``path`` (append mode), and read them."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run what is available now into an in-memory table; for tests and small reports."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
