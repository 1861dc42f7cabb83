import pytest
from pyspark.sql import functions as F

from quarry.operators import answers, metrics, plugins
from quarry.plans import ask


def test_metrics_reports(spark):
    rows = [("g1", "a", [["1"]], ["1", "2"]), ("g2", "a", [["2", "3"], ["4"]], ["9", "3"]), ("g3", "b", [["7"]], None), ("g4", "b", [], ["1"])]
    cases = spark.createDataFrame(rows, "case_id string, category string, expected array<array<string>>, retrieved array<string>")
    scored = metrics.score_cases(cases)
    assert {r.case_id: (r.recall_1, r.recall_3, r.rr) for r in scored.collect()} == {"g1": (1.0, 1.0, 1.0), "g2": (0.0, 0.5, 0.5), "g3": (0.0, 0.0, 0.0)}
    summary = {r.category: r for r in metrics.summarise(scored, "category").collect()}
    assert summary[None].cases == 3 and summary[None].mrr == 0.5 and summary["a"].recall_3 == 0.75 and summary["b"].mrr == 0.0
    chunks = spark.createDataFrame([("1", "faq"), ("2", "faq"), ("4", "blog"), ("7", "blog")], "id string, source_type string")
    micro = {r.source_type: (r.entries, r.recall_3) for r in metrics.micro_by_source(scored, chunks).collect()}
    assert micro == {"faq": (2, 1.0), "blog": (2, 0.0)}
    assert [r.case_id for r in metrics.worst_cases(scored, 2).collect()] == ["g3", "g2"]
    assert metrics.summarise(scored.limit(0), "category").where("category is null").first().mrr == 0.0


def drafts(spark, rows):
    return spark.createDataFrame(rows, "id int, response_type string, answer string, citations array<string>, confidence double, retrieved array<string>")


def test_draft_normalisation(spark):
    df = drafts(
        spark,
        [
            (1, "answer", "A", ["x", "z", "x"], 1.7, ["x", "y"]),
            (2, "refuse", "no", ["x"], 0.4, ["x"]),
            (3, "clarify", "which?", ["x"], -1.0, ["x"]),
            (4, None, None, None, None, ["x"]),
            (5, "answer", "S", ["made-up"], 0.5, []),
        ],
    )
    got = {r.id: (r.kept_citations, r.dropped_citations, r.refused, r.clamped_confidence) for r in answers.normalise_drafts(df).collect()}
    assert got == {1: (["x", "x"], 1, False, 1.0), 2: ([], 0, True, 0.4), 3: ([], 0, False, 0.0), 4: ([], 0, True, 0.0), 5: (["made-up"], 0, False, 0.5)}
    assert answers.normalise_drafts(df).where("id = 4").first().text == answers.REFUSAL_TEXT


def test_checks(spark):
    rows = [(1, "Use the homescreen", False, ["a", "b"], ["Home Screen", "wallet"], ["home-screen"]), (2, "no", True, [], ["wallet"], ["no"])]
    df = spark.createDataFrame(rows, "id int, text string, refused boolean, citations array<string>, must_mention array<string>, must_not_mention array<string>")
    got = {r.id: r for r in answers.deterministic_checks(df, F.array(F.lit("a"))).collect()}
    assert got[1].unresolved_citations == ["b"] and got[1].must_mention_missing == ["wallet"] and got[1].must_not_mention_hit == ["home-screen"]
    assert got[2].must_mention_missing == [] and got[2].must_not_mention_hit == ["no"] and got[2].citations_resolve


def test_grades_ignore_nulls(spark):
    rows = [("a", True, None, False), ("a", None, None, True), ("b", False, None, False)]
    df = spark.createDataFrame(rows, "category string, grounded boolean, correct boolean, grading_failed boolean")
    got = {r.category: r for r in answers.summarise_grades(df, "category").collect()}
    assert (got["a"].grounded, got["a"].grounded_graded, got["a"].correct, got["a"].correct_graded, got["a"].grading_failures) == (1.0, 1, 0.0, 0, 1)
    assert got[None].cases == 3 and got[None].grounded == 0.5


def test_latency_of_nothing(spark):
    r = answers.latency(spark.createDataFrame([], "answer_ms long")).first()
    assert (r.mean_ms, r.max_ms) == (0, 0)
    assert answers.latency(spark.createDataFrame([(1,), (2,)], "answer_ms long")).first().mean_ms == 1


CHUNKS = [("c1", "faq", "Wallet", "reset the wallet"), ("c2", "blog", "Video", "upload a video"), ("c3", "faq", "Vote", "how to vote")]


def test_ask_end_to_end(spark):
    chunks = spark.createDataFrame(CHUNKS, "id string, source_type string, title string, text string")
    questions = spark.createDataFrame([(1, "wallet reset"), (2, "boom")], "question_id long, question string")

    def drafter():
        def draft(prompt):
            if "boom" in prompt:
                raise ValueError("no parse")
            return ("answer", "do it", ["c1", "invented"], 2.0)

        return draft

    out = {r.question_id: r for r in ask.ask(questions, chunks, drafter, "bm25", 2).collect()}
    assert out[1].citations == ["c1"] and out[1].dropped_citations == 1 and out[1].confidence == 1.0 and len(out[1].retrieved) == 2
    assert out[2].refused and out[2].text == answers.REFUSAL_TEXT
    stuffed = {r.question_id: r for r in ask.ask_stuffed(questions, chunks, drafter).collect()}
    assert stuffed[1].citations == ["c1", "invented"] and stuffed[1].retrieved == []


def test_prompts_hold_the_rules_and_runs_are_measured(spark):
    chunks = spark.createDataFrame(CHUNKS, "id string, source_type string, title string, text string")
    questions = spark.createDataFrame([(1, "wallet reset"), (2, "vote")], "question_id long, question string")

    def drafter():
        def draft(prompt):
            assert prompt.startswith(answers.RULES) and "Reference chunks:" in prompt and prompt.endswith("</question>")
            if "vote\n</question>" in prompt:
                return ("answer", "so", ["c3", "ghost"], 1.0, 100, 7)
            raise ValueError

        return draft

    done = ask.ask(questions, chunks, drafter, "bm25", 2).cache()
    run = ask.answers.run_report(done).first()
    assert (run.cases, run.parse_failures, run.tokens_in, run.tokens_out, run.dropped_citations) == (2, 1, 100, 7, 1) and run.max_ms >= run.mean_ms
    empty = {r.question_id: r for r in ask.ask(questions, chunks.limit(0), drafter, "bm25", 2).collect()}
    assert set(empty) == {1, 2} and empty[1].refused and empty[1].retrieved == [] and empty[2].citations == ["c3", "ghost"]
    with pytest.raises(ValueError, match="one prompt"):
        answers.stuffed_prompt(chunks, limit=5)


def test_prompt_keeps_rank_order(spark):
    chunks = spark.createDataFrame(CHUNKS, "id string, source_type string, title string, text string")
    ranking = spark.createDataFrame([(1, "c3", 1), (1, "c1", 2), (1, "c2", 3)], "question_id long, id string, rank int")
    r = answers.render_prompts(ranking, chunks, 2).first()
    assert r.retrieved == ["c3", "c1"]
    assert r.context == '<chunk id="c3" source="faq" title="Vote">\nhow to vote\n</chunk>\n\n<chunk id="c1" source="faq" title="Wallet">\nreset the wallet\n</chunk>'


def test_evaluate_answers(spark):
    cases = spark.createDataFrame([("g001", "answerable", "how?", ["vote"], []), ("g002", "refusal", "why?", [], [])], "id string, category string, question string, must_mention array<string>, must_not_mention array<string>")
    given = spark.createDataFrame([("g001", "you vote", ["c1", "ghost"], False), ("g002", "no", [], True)], "question_id string, text string, citations array<string>, refused boolean")
    chunks = spark.createDataFrame(CHUNKS, "id string, source_type string, title string, text string")

    def grader():
        def grade(prompt):
            assert prompt.startswith(answers.GRADING)
            if "<answer>\nno\n</answer>" in prompt:
                raise RuntimeError
            assert prompt.endswith("Refused: false\n<answer>\nyou vote\n</answer>\n\nCited chunks:\n<chunk id=\"c1\">\nreset the wallet\n</chunk>")
            assert "Category: answerable\nNotes: (none)\n\n<question>\nhow?\n</question>" in prompt
            return (True, True, None, True, "")

        return grade

    out = ask.evaluate_answers(cases, given, chunks, grader)
    per = {r.id: r for r in out["per_case"].collect()}
    assert per["g001"].unresolved_citations == ["ghost"] and per["g001"].grounded and per["g002"].grading_failed
    total = out["by_category"].where("category is null").first()
    assert (total.cases, total.grading_failures, total.citation_failures, total.grounded_graded) == (2, 1, 1, 1)


def test_cache_misses(spark):
    items = spark.createDataFrame([("k1", "a b"), ("k2", "c"), ("k2", "c")], "key string, text string")
    cache = spark.createDataFrame([("m", "k1", [1.0])], "model string, key string, embedding array<float>")
    assert [r.key for r in plugins.cache_misses(items, cache, "m").collect()] == ["k2"]
    assert plugins.cache_misses(items, cache, "other").count() == 2
