"""Validation: each check gives the rows that break it; ``require_none`` turns them into an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import CATEGORIES, CATEGORY_MINIMUMS, LEAST_CASES, SOURCE_TYPES


class ValidationError(ValueError):
    """A check found rows that break it."""


def require_none(broken: DataFrame, what: str, show: int = 5) -> None:
    rows = broken.limit(show).collect()
    if rows:
        raise ValidationError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def _blank(c: str):
    return F.coalesce(F.col(c), F.lit("")) == ""


def chunk_violations(chunks: DataFrame) -> DataFrame:
    """(id, problem) of chunks that lack a field or have an unknown source."""
    problems = F.array(
        F.when(_blank("id"), "id"),
        F.when(~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False)), "source_type"),
        F.when(_blank("text"), "text"),
        F.when(_blank("url"), "url"),
        F.when(_blank("content_hash"), "content_hash"),
    )
    return chunks.select("id", F.explode(F.array_compact(problems)).alias("problem"))


def case_violations(cases: DataFrame) -> DataFrame:
    """(id, problem) of cases with a bad id, category or question, or answerable without expected ids."""
    problems = F.array(
        F.when(~F.coalesce(F.col("id").rlike(r"^g\d{3}$"), F.lit(False)), "id"),
        F.when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "category"),
        F.when(_blank("question"), "question"),
        F.when((F.col("category") == "answerable") & (F.size("expected_chunk_ids") <= 0), "expected_chunk_ids"),
    )
    return cases.select("id", F.explode(F.array_compact(problems)).alias("problem"))


def duplicate_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.groupBy(id_col).count().where("count > 1")


def duplicate_places(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, file, line) of every row (with file and line) whose id an earlier one has."""
    w = Window.partitionBy(id_col).orderBy("file", "line")
    return rows.select(id_col, "file", "line", F.row_number().over(w).alias("__n")).where("__n > 1").drop("__n")


def unresolved_expected(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, chunk_id) of every alternate that no chunk has."""
    wanted = cases.select(F.col("id").alias("case_id"), F.explode(F.flatten("expected_chunk_ids")).alias("chunk_id"))
    return wanted.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").select("case_id", "chunk_id").distinct()


def unresolved_citations(answers: DataFrame, chunks: DataFrame, key: str = "case_id") -> DataFrame:
    cited = answers.select(key, F.explode("citations").alias("chunk_id"))
    return cited.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").select(key, "chunk_id")


def category_shortfalls(cases: DataFrame) -> DataFrame:
    """(category, cases, least) where a category, or all of them, has too few cases."""
    spark = cases.sparkSession
    least = spark.createDataFrame([*CATEGORY_MINIMUMS.items(), ("all", LEAST_CASES)], "category string, least long")
    counts = cases.groupBy("category").count().unionByName(cases.agg(F.count("*").alias("count")).select(F.lit("all").alias("category"), "count"))
    joined = least.join(counts, "category", "left").select("category", F.coalesce("count", F.lit(0)).alias("cases"), "least")
    return joined.where("cases < least")


def request_errors(requests: DataFrame, strategies: list[str], max_question: int = 2000, max_chunks: int = 20) -> DataFrame:
    """``requests`` (question, strategy, max_chunks) with ``error``: null where the request is valid."""
    n = F.length("question")
    error = (
        F.when(F.col("question").isNull() | (n < 1) | (n > max_question), "question")
        .when(~F.coalesce(F.col("max_chunks").between(1, max_chunks), F.lit(False)), "max_chunks")
        .when(~F.coalesce(F.col("strategy").isin(*strategies), F.lit(False)), "strategy")
    )
    return requests.withColumn("error", error)


def review_argument_errors(approve: DataFrame, reject: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, problem): unknown ids, and ids both approved and rejected."""
    named = approve.select("id").union(reject.select("id")).distinct()
    unknown = named.join(candidates.select("id"), "id", "left_anti").withColumn("problem", F.lit("unknown"))
    both = approve.select("id").intersect(reject.select("id")).withColumn("problem", F.lit("both"))
    return unknown.unionByName(both)
