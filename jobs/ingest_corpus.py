"""Incremental ingest: new documents of a landing folder become chunks of a search corpus.

    python -m jobs.ingest_corpus --source LANDING --output CORPUS --checkpoint CHECKPOINT

LANDING is a folder (or one file) of Parquet documents (doc_id, text, lang, source); every run takes the files that no run before took, as
the stream's checkpoint knows.  Texts are tidied, split into chunks, hashed, and chunks whose content the corpus has already are
left out; of equal chunks in one batch the first by doc_id and part stays.  The corpus is what this writes:

    chunks/batch=N/source=S     id, doc_id, part, lang, text, chars, content_hash
    rejects/batch=N             doc_id, problem
    report/batch=N              docs, rejected, chunks, copies

A batch that runs again after a failure takes the same files, sees only earlier batches and overwrites its own partitions, so nothing
is lost or doubled.  A corpus and a checkpoint belong together: one that has batches which the checkpoint hasn't made is an error.
"""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.functions.chunking import split_prose
from quarry.functions.text import content_key, tidy
from quarry.operators.common import BROADCAST_ROWS, is_small, top_k
from quarry.storage import mark, release, scratch

from .settings import command, settings

log = logging.getLogger("ingest_corpus")

DEFAULTS = {"chunk_chars": 1500, "least_chars": 1, "files_per_batch": 1000}
DOCUMENT = "doc_id bigint, text string, lang string, source string"
CHUNKS = "id string, doc_id bigint, part int, lang string, text string, chars int, content_hash string, batch bigint, source string"
REJECTS = "doc_id bigint, problem string, batch bigint"
REPORT = "docs bigint, rejected bigint, chunks bigint, copies bigint, batch bigint"


def read(spark: SparkSession, output: str, name: str) -> DataFrame:
    """One of the tables below ``output``, with its partition columns."""
    schema = {"chunks": CHUNKS, "rejects": REJECTS, "report": REPORT}[name]
    return spark.read.schema(schema).parquet(f"{output}/{name}")


def _write(df: DataFrame, output: str, name: str, by: list[str], mode: str = "overwrite") -> None:
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{output}/{name}")


def problem_of(least_chars: int) -> Column:
    """Why a document with the tidied text ``body`` can't be taken, or null."""
    return F.when(F.col("doc_id").isNull(), "no id").when(F.length(F.coalesce("body", F.lit(""))) < least_chars, "no text")


def maybe_rejected(least_chars: int) -> Column:
    """False where a text has enough characters that tidying keeps, which is seen at its start; other documents must be tidied to know."""
    if least_chars > 100:  # too long a pattern
        return F.lit(True)
    return F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(rf"(?s)^(?:[^!-~]*+[!-~]){{{least_chars}}}")


def chunked(docs: DataFrame) -> DataFrame:
    """Chunks of documents from their ``pieces``; a missing source is ``unknown``."""
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))
    parts = docs.select("doc_id", "lang", source.alias("source"), F.posexplode("pieces").alias("part", "text"))
    return parts.withColumns({"chars": F.length("text"), "content_hash": content_key(F.col("text"))})


def unknown_only(chunks: DataFrame, corpus: DataFrame) -> DataFrame:
    """``chunks`` whose content_hash the corpus lacks.

    A small batch is sent to the corpus, which then gives back only hashes of that batch and moves nothing; a large one meets it in a shuffled join.
    """
    known, mine = corpus.select("content_hash"), chunks.select("content_hash")
    if is_small(mine, BROADCAST_ROWS):
        known = F.broadcast(known.join(F.broadcast(mine), "content_hash", "left_semi").distinct())
    return chunks.join(known, "content_hash", "left_anti")


def ingest_batch(docs: DataFrame, number: int, output: str, config: dict) -> None:
    """Write one batch into its partitions."""
    spark, since = docs.sparkSession, mark()
    if not read(spark, output, "report").where(F.col("batch") > number).isEmpty():
        raise RuntimeError(f"{output} has batches after {number}: it was written with another checkpoint")
    seen = Observation(f"documents-{number}")
    rejects = docs.where(maybe_rejected(config["least_chars"])).withColumn("body", tidy(F.col("text"))).withColumn("problem", problem_of(config["least_chars"]))
    docs = docs.withColumn("body", tidy(F.col("text"))).withColumn("problem", problem_of(config["least_chars"]))
    docs = docs.withColumn("pieces", F.when(F.col("problem").isNull(), split_prose(F.col("body"), config["chunk_chars"])))
    docs = docs.observe(seen, F.count(F.lit(1)).alias("docs"), F.count("problem").alias("rejected"), F.sum(F.when(F.col("problem").isNull(), F.size("pieces"))).alias("pieces"))
    chunks = chunked(docs.where("problem is null"))
    first = scratch(top_k(chunks, ["content_hash"], [F.col("doc_id"), F.col("part"), F.col("source")], 1).drop("rank"), "ingest")
    counts = seen.get
    new = unknown_only(first, read(spark, output, "chunks").where(F.col("batch") < number))
    new = new.select(F.concat_ws(":", "source", "doc_id", "content_hash").alias("id"), "doc_id", "part", "lang", "text", "chars", "content_hash", F.lit(number).cast("long").alias("batch"), "source")
    _write(new.hint("rebalance", "source"), output, "chunks", ["batch", "source"])
    _write(rejects.where("problem is not null").select("doc_id", "problem", F.lit(number).cast("long").alias("batch")), output, "rejects", ["batch"])
    written = read(spark, output, "chunks").where(F.col("batch") == number).count()
    row = (counts["docs"], counts["rejected"], written, (counts["pieces"] or 0) - written, number)
    _write(spark.createDataFrame([row], REPORT).coalesce(1), output, "report", ["batch"])
    log.info("batch %s: read %s documents, rejected %s; wrote %s chunks to %s, left out %s copies", number, row[0], row[1], row[2], output, row[3])
    release(spark, since)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Take what is new in ``source``, and return the corpus's chunks as they stand then."""
    config = settings(DEFAULTS, config or {})
    for name, schema, by in (("chunks", CHUNKS, ["batch", "source"]), ("rejects", REJECTS, ["batch"]), ("report", REPORT, ["batch"])):
        _write(spark.createDataFrame([], schema), output, name, by, "append")  # so that the tables can be read
    stream = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda df, n: ingest_batch(df, n, output, config))
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    chunks = read(spark, output, "chunks")
    total = read(spark, output, "report").agg(F.count("*"), F.sum("docs"), F.sum("chunks")).first()
    log.info("%s holds %s batches: %s documents, %s chunks; rules %s", output, *total, config)
    return chunks


main = command(
    "ingest_corpus",
    {"source": "folder of Parquet documents", "output": "folder of the corpus", "checkpoint": "folder of the stream's checkpoint"},
    Path(__file__).with_suffix(".toml"),
    run,
)

if __name__ == "__main__":
    raise SystemExit(main())
