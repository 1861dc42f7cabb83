"""The corpus pipeline's stages: each takes documents and gives documents, the last one pieces.

Defined results, for every stage but the last: the columns of documents and no others; every row is judged by its own text, whatever its id, as stages
number the rows that they decide on: of equal rows and of rows without an id one stays where they are copies, and none where they leak; a null
text counts as empty and fails the quality rules; an empty table gives an empty table; columns that a stage uses inside
never reach its result, and clashing ones pass through as they came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table
from .decontamination import decontaminate
from .jaccard import jaccard_components
from .lines import dedup_lines
from .packing import pack_documents
from .rules import MIN_WORDS, quality_rules, train_field

#: Up to so many ids (8 bytes each) are broadcast to the documents; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def listed(docs: DataFrame, ids: DataFrame, label: str, how: str, key: str = "doc_id") -> DataFrame:
    """docs whose key is in ids (one column, __id; how: left_semi), or is not (left_anti: null keys stay)."""
    ids = scratch(ids.distinct(), label)
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[key] == ids["__id"], how)


def numbered(docs: DataFrame) -> DataFrame:
    """docs, written, with a number for each row."""
    return scratch(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")


def shielded(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the columns of docs: doc_id and text as work leaves them, the others as they came, whatever their names."""
    own = ("doc_id", "text")
    aside = {c: f"__aside{i}" for i, c in enumerate(docs.columns) if c not in own}
    out = work(docs.select(*own, *[F.col(f"`{c}`").alias(n) for c, n in aside.items()]))
    return out.select(*[F.col(aside[c]).alias(c) if c in aside else F.col(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    field = train_field(docs, table(spark, sf_dir, "labels"))
    return shielded(docs, lambda d: quality_rules(d, field, keep_text=True).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, least: int = MIN_WORDS) -> DataFrame:
    """Documents without the lines that an earlier document holds; n_chars follows.

    A document that loses lines and keeps under ``least`` words, the quality rules' own minimum, goes whole: what is left of a
    copy is no document.
    """

    def work(d: DataFrame) -> DataFrame:
        out = dedup_lines(d).where((F.col("n_dropped") == 0) | (F.col("words_left") >= least))
        return out.withColumnRenamed("kept_text", "text")

    out = shielded(docs, work)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of each component of near copies.

    Line dedup has cut lines out of near copies, and what it left of them links no more.  So the
    documents at hand are joined by their texts in ``documents`` first, where ids lead, and the rows that stay by the texts they have now.
    """
    source = table(spark, sf_dir, "documents").select("doc_id", "text")
    source = listed(source, docs.select(F.col("doc_id").alias("__id")).where("__id is not null"), "pipeline-kept", "left_semi")
    copies = jaccard_components(source).where("component_id < doc_id")
    docs = listed(docs, copies.select(F.col("doc_id").alias("__id")), "pipeline-near", "left_anti")

    def work(d: DataFrame) -> DataFrame:
        rows = numbered(d)
        groups = jaccard_components(rows, "__row").where("n_shingles > 0").select(F.col("__row").alias("__id"), "component_id")
        met = groups.join(groups.where("__id <> component_id").select("component_id").distinct(), "component_id", "left_semi")  # of several rows
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
        named = met.join(rows.select(F.col("__row").alias("__id"), order.alias("order")), "__id")
        first = named.groupBy("component_id").agg(F.min("order").alias("first"))
        gone = named.join(first, "component_id").where(F.col("__id") != F.col("first.__row")).select("__id")
        return listed(rows, gone, "pipeline-copies", "left_anti", "__row")

    return shielded(docs, work)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold a passage of the benchmark."""

    def work(d: DataFrame) -> DataFrame:
        rows = numbered(d)
        leaks = decontaminate(rows, table(spark, sf_dir, "benchmark"), "__row")
        return listed(rows, leaks.select(F.col("doc_id").alias("__id")), "pipeline-leaks", "left_anti", "__row")

    return shielded(docs, work)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack_documents(docs)
