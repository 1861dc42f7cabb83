"""Retrieval report: how well each strategy finds the documents that hold a passage.

    python -m jobs.retrieval_report --documents DOCUMENTS --questions QUESTIONS --output REPORT

DOCUMENTS (an id column, text) and QUESTIONS (an id column, text) are Parquet.  A question's right documents are those that hold its text as it stands;
questions that no document holds are counted in the log and left out.  Each strategy ranks all documents for all questions, the texts being
read and tokenised once for all of them, and its measures are written to ``strategy=S/level=L``: level ``case`` has a row for each question, ``category`` one for
questions with a single right document and one for the others, ``all`` one row.  A rerun overwrites the partitions of the strategies it runs
and leaves others, so a strategy can be added later; the same input gives the same rows.
"""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunks, metrics, retrieve
from quarry.storage import mark, release, scratch

from .settings import command, settings

log = logging.getLogger("retrieval_report")

DEFAULTS = {"strategies": ["lexical", "bm25", "hybrid"], "depth": 10, "id_column": "doc_id", "question_column": "item_id"}
KS = metrics.KS
MEASURES = [*(f"recall_{k}" for k in KS), "rr"]
REPORT = f"name string, cases bigint, holders bigint, {', '.join(f'{m} double' for m in MEASURES)}, retrieved string, strategy string, level string"
LEVELS = ("case", "category", "all")


def rankings(names: list[str], questions: DataFrame, documents: DataFrame, depth: int) -> dict[str, DataFrame]:
    """(question_id, id, score, rank) of each strategy, over one pass of the texts."""
    shared = retrieve.match(questions, documents)
    lexical = lambda k: retrieve.lexical(questions, documents, k, matches=shared)
    known = {
        "lexical": lambda: retrieve.lexical(questions, documents, depth, zero_fill=False, matches=shared),
        "bm25": lambda: retrieve.bm25(questions, documents, depth, zero_fill=False, matches=shared),
        "hybrid": lambda: retrieve.hybrid(questions, documents, lexical, depth, matches=shared),
    }
    if unknown := sorted(set(names) - set(known)):
        raise ValueError(f"unknown strategies {unknown}; known are {sorted(known)}")
    return {name: known[name]() for name in names}


def scored(cases: DataFrame, held: DataFrame, ranking: DataFrame) -> DataFrame:
    """cases (question_id, category, holders) with the measures of a ranking; only right documents that were ranked are gathered."""
    found = ranking.join(held, ["question_id", "id"], "left_semi").groupBy("question_id").agg(F.collect_list("id").alias("found"))
    joined = cases.join(metrics.ranked_ids(ranking), "question_id", "left").join(found, "question_id", "left")
    nothing = F.array(F.lit(None).cast(ranking.schema["id"].dataType))
    return metrics.score_cases(joined.withColumn("expected", F.array(F.coalesce("found", nothing))), KS)


def levels(scores: DataFrame) -> DataFrame:
    """All rows of one strategy's report."""
    rounded = [F.round(m, 6).alias(m) for m in MEASURES]
    case = scores.select(F.col("question_id").cast("string").alias("name"), F.lit(1).cast("long").alias("cases"), "holders", *rounded, F.array_join("retrieved", ",").alias("retrieved"), F.lit("case").alias("level"))
    means = [F.count("*").alias("cases"), F.sum("holders").alias("holders"), *[F.round(F.avg(m), 4).alias(m) for m in MEASURES]]
    sets = scores.groupingSets([["category"], []], "category").agg(*means, F.grouping("category").alias("total"))
    total = sets.select(
        F.when(F.col("total") == 0, F.col("category")).alias("name"), "cases", "holders", *MEASURES, F.lit(None).cast("string").alias("retrieved"),
        F.when(F.col("total") == 0, "category").otherwise("all").alias("level"),
    )
    return case.unionByName(total)


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(output)


def run(spark: SparkSession, documents: str, questions: str, output: str, config: dict | None = None) -> DataFrame:
    """Write the report of the configured strategies, and return the whole report as it stands then."""
    config, since = settings(DEFAULTS, config or {}), mark()
    docs = spark.read.parquet(documents).select(F.col(config["id_column"]).alias("id"), "text")
    asked = spark.read.parquet(questions).select(F.col(config["question_column"]).alias("question_id"), F.col("text").alias("question"))
    items = asked.select(F.col("question_id").alias("item_id"), F.col("question").alias("item"))
    held = scratch(chunks.holders(docs, items).select(F.col("item_id").alias("question_id"), "id").distinct(), "report-held")
    category = F.when(F.col("holders") == 1, "single").otherwise("several")
    cases = scratch(held.groupBy("question_id").agg(F.count("*").alias("holders")).withColumn("category", category), "report-cases")
    n, right = asked.select("question_id").distinct().count(), cases.count()
    log.info("read %s questions from %s, %s of them held by documents of %s", n, questions, right, documents)
    wanted = asked.join(cases, "question_id", "left_semi")
    for name, ranking in rankings(config["strategies"], wanted, docs, config["depth"]).items():
        rows = scratch(levels(scored(cases, held, scratch(ranking, "report-ranking"))), "report-rows")
        rows = rows.withColumn("strategy", F.lit(name)).select(*[f.split(" ")[0] for f in REPORT.split(", ")])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy", "level").parquet(output)
        total = rows.where("level = 'all'").first()
        log.info("%s: %s cases to %s/strategy=%s; %s", name, total.cases, output, name, {m: total[m] for m in MEASURES})
        for row in rows.where("level = 'case' AND rr < 1").orderBy("rr", F.length("name"), "name").limit(5).collect():
            log.info("%s: among the worst: case %s, reciprocal rank %s", name, row.name, row.rr)
    release(spark, since)
    return read(spark, output)


main = command(
    "retrieval_report",
    {"documents": "Parquet documents", "questions": "Parquet questions", "output": "folder of the report"},
    Path(__file__).with_suffix(".toml"),
    run,
)

if __name__ == "__main__":
    raise SystemExit(main())
