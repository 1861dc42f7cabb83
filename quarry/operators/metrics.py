"""Retrieval metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rank import recall_at_k, reciprocal_rank
from .common import by_and_total

KS = (1, 3, 5, 10)


def ranked_ids(ranking: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, retrieved): ids of each question in rank order; at most k each."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return ranking.groupBy(key).agg(F.transform(pairs, lambda p: p["id"]).alias("retrieved"))


def score_cases(cases: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """``cases`` (expected, retrieved) with recall_<k> and rr; cases without expected ids go."""
    scored = cases.where(F.size("expected") > 0)
    retrieved = F.coalesce("retrieved", F.array().cast(cases.schema["retrieved"].dataType))
    scored = scored.withColumn("retrieved", retrieved)
    return scored.withColumns({f"recall_{k}": recall_at_k(F.col("expected"), F.col("retrieved"), k) for k in ks} | {"rr": reciprocal_rank(F.col("expected"), F.col("retrieved"))})


def summarise(scored: DataFrame, by: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """Means overall and by ``by`` (null: overall), rounded to four decimals, in one aggregation."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    measures = [F.count("*").alias("cases"), *(mean(f"recall_{k}").alias(f"recall_{k}") for k in ks), mean("rr").alias("mrr")]
    return by_and_total(scored, by, measures)


def micro_by_source(cases: DataFrame, chunks: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Share of expected groups hit in the first k, by the source of each group's first alternate."""
    groups = cases.select("retrieved", F.explode("expected").alias("group"))
    groups = groups.join(chunks.select(F.col("id").alias("first"), "source_type"), F.get("group", F.lit(0)) == F.col("first"))
    hit = lambda k: F.arrays_overlap(F.slice("retrieved", 1, k), F.col("group")).cast("int")
    return groups.groupBy("source_type").agg(F.count("*").alias("entries"), *(F.round(F.avg(hit(k)), 4).alias(f"recall_{k}") for k in ks))


def worst_cases(scored: DataFrame, n: int = 5, key: str = "case_id") -> DataFrame:
    return scored.orderBy("rr", key).limit(n)


def run_retrieval_eval(cases: DataFrame, ranking: DataFrame, chunks: DataFrame, key: str = "case_id") -> dict[str, DataFrame]:
    """per_case, by_category (null: overall) and by_source_type of one retriever's ranking."""
    lists = ranked_ids(ranking.withColumnRenamed("question_id", key), key)
    joined = cases.join(lists, key, "left")
    per_case = score_cases(joined)
    return {"per_case": per_case, "by_category": summarise(per_case, "category"), "by_source_type": micro_by_source(per_case, chunks)}
