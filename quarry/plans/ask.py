"""Answer questions in batch, and evaluate answers: retrieve, prompt, draft, normalise, check, summarise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers, plugins
from ..operators.results import ResultStore
from ..operators.retrieve import retriever
from ..storage import new_scratch_path, scratch

DRAFT = "response_type string, answer string, citations array<string>, confidence double, tokens_in bigint, tokens_out bigint"
ANSWER = "text string, citations array<string>, refused boolean, confidence double"


def called(df: DataFrame, column: str, kind: str, make: Callable, ledger: str | None, model: str, **options) -> DataFrame:
    """plugins.call, each distinct prompt once, and the results written before anybody reads them.

    ledger: a folder that keeps them for later runs; without one they go with the other intermediate tables.
    """
    spark = df.sparkSession
    store = ResultStore(spark, ledger or new_scratch_path(spark, "ledger"), model, kind)
    return store.ask(scratch(df, "prompts"), column, make, **options)


def _answered(prompts: DataFrame, drafter: Callable, strategy: str, ledger: str | None = None, model: str = "drafter") -> DataFrame:
    """Drafts of prompts (question_id, retrieved, context, question) as answers."""
    prompts = prompts.withColumn("prompt", answers.answer_prompt(F.col("context"), F.col("question")))
    drafts = called(prompts, "prompt", DRAFT, drafter, ledger, model, timed="answer_ms").select("question_id", "retrieved", "answer_ms", "result.*")
    return answers.normalise_drafts(drafts).select(
        "question_id", "text", F.col("kept_citations").alias("citations"), "refused", F.col("clamped_confidence").alias("confidence"), F.lit(strategy).alias("strategy"),
        "retrieved", "dropped_citations", "answer_ms", F.col("response_type").isNull().alias("parse_failed"), "tokens_in", "tokens_out",
    )


def ask(
    questions: DataFrame, chunks: DataFrame, drafter: Callable, strategy: str = "bm25", max_chunks: int = answers.MAX_CHUNKS, search: Callable | None = None,
    ledger: str | None = None, model: str = "drafter",
) -> DataFrame:
    """Answers (question_id, text, citations, refused, confidence, strategy, retrieved, dropped_citations, answer_ms, parse_failed, tokens_in, tokens_out).

    drafter: plugin from a prompt to DRAFT, whose token counts may be missing.  search: (questions, chunks, k) to a ranking, for
    strategies that need more than these, such as dense.  A question without any chunk is asked with an empty context.  Every distinct prompt is
    asked once, here and not when the answers are read; ledger and model: where drafts are kept for later runs, and whose they are.
    """
    ranking = (search or retriever(strategy))(questions, chunks, max_chunks)
    prompts = questions.join(answers.render_prompts(ranking, chunks, max_chunks), "question_id", "left")
    none = F.array().cast("array<string>")
    return _answered(prompts.withColumns({"context": F.coalesce("context", F.lit("")), "retrieved": F.coalesce("retrieved", none)}), drafter, strategy, ledger, model)


def ask_stuffed(questions: DataFrame, chunks: DataFrame, drafter: Callable, ledger: str | None = None, model: str = "drafter") -> DataFrame:
    """As ask, with the whole corpus in the prompt; nothing counts as retrieved, so no citation is dropped."""
    prompts = questions.join(F.broadcast(answers.stuffed_prompt(chunks)))
    return _answered(prompts.withColumn("retrieved", F.array().cast("array<string>")), drafter, "stuffed", ledger, model)


def ask_endpoint(questions: DataFrame, base_url: str, strategy: str, max_chunks: int = answers.MAX_CHUNKS) -> DataFrame:
    """As ask, by a running service; what it retrieved is not told, and an HTTP error ends the run."""
    make = plugins.http_answerer(base_url, strategy, max_chunks)
    done = scratch(plugins.call(questions, "question", ANSWER, make, attempts=1, timed="answer_ms", strict=True), "endpoint")
    zero = F.lit(None).cast("bigint")
    return done.select(
        "question_id", "result.*", F.lit(f"http-{strategy}").alias("strategy"), F.array().cast("array<string>").alias("retrieved"), F.lit(0).alias("dropped_citations"),
        "answer_ms", F.lit(False).alias("parse_failed"), zero.alias("tokens_in"), zero.alias("tokens_out"),
    )


def select_cases(cases: DataFrame, categories: list[str] | None = None, limit: int | None = None, key: str = "id") -> DataFrame:
    """Cases of the named categories, and of these the first ``limit`` by id."""
    if categories:
        cases = cases.where(F.col("category").isin(*categories))
    return cases.orderBy(key).limit(limit) if limit else cases


GRADE = "grounded boolean, correct boolean, cited boolean, appropriate_refusal boolean, rationale string"


def evaluate_answers(cases: DataFrame, given: DataFrame, chunks: DataFrame, grader: Callable, ledger: str | None = None, model: str = "grader") -> dict[str, DataFrame]:
    """per_case, by_category and run of answers (question_id = case id); grader: plugin from answers.grader_prompt to GRADE.

    run: latency, parse failures and tokens, if ``given`` has them.  Grades are asked for once, as drafts are in ask().
    """
    joined = cases.join(given.withColumnRenamed("question_id", "id"), "id")
    known = chunks.select(F.col("id").alias("cid"))
    cited = joined.select("id", F.explode("citations").alias("cid"))
    missing = cited.join(known, "cid", "left_anti").groupBy("id").agg(F.collect_list("cid").alias("lost"))
    blocks = answers.cited_chunks(joined.select(F.col("id").alias("case"), "citations"), chunks, "case")
    joined = joined.join(missing, "id", "left").join(blocks.select(F.col("case").alias("id"), F.col("cited").alias("blocks")), "id", "left")
    found = F.array_except("citations", F.coalesce("lost", F.array().cast("array<string>")))
    column = lambda c: F.col(c) if c in joined.columns else F.lit(None).cast("string")
    blocks = F.coalesce("blocks", F.array().cast(joined.schema["blocks"].dataType))
    prompt = answers.grader_prompt(column("category"), column("notes"), column("question"), F.col("refused"), F.col("text"), blocks)
    checked = answers.deterministic_checks(joined, found).withColumn("grading", prompt).drop("blocks")
    graded = called(checked, "grading", GRADE, grader, ledger, model).select("*", F.col("result").isNull().alias("grading_failed"), "result.*").drop("result", "lost", "grading")
    out = {"per_case": graded, "by_category": answers.summarise_grades(graded, "category")}
    return out | ({"run": answers.run_report(given)} if "answer_ms" in given.columns else {})


def health(chunks: DataFrame, strategies: list[str], index_build_ms: int) -> DataFrame:
    return chunks.agg(F.count("*").alias("corpus_size")).withColumns({"index_build_ms": F.lit(index_build_ms), "strategies": F.array(*[F.lit(s) for s in sorted(strategies)])})
