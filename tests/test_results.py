import os
from threading import Thread

import pytest
from pyspark.sql import functions as F

from quarry.operators import plugins, results
from quarry.plans import ask
from quarry.plans.search import searcher


def counted(path, f):
    """A plugin that notes every call in a file, as calls run in other processes."""

    def make():
        def one(x):
            with open(path, "a") as out:
                out.write("x\n")
            return f(x)

        return one

    return make


def calls(path):
    return len(open(path).readlines()) if os.path.exists(path) else 0


@pytest.fixture
def log(tmp_path):
    return str(tmp_path / "calls")


@pytest.fixture
def chunks(spark):
    rows = [(f"c{i}", "faq", "", f"{w} text {i % 4}") for i, w in enumerate(["wallet", "video", "vote", "video", "wallet", "feed", "wallet", "video"])]
    return spark.createDataFrame(rows, "id string, source_type string, title string, text string")


def embedder(log):
    return counted(log, plugins.hashed_embedding(16)())


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")


def test_only_missing_texts_are_embedded(spark, tmp_path, log, chunks):
    store = results.vector_store(spark, str(tmp_path / "store"), "model/a")
    distinct = chunks.select("text").distinct().count()
    dense = searcher("dense", embedder(log), store)
    first = dense(asked(spark, "wallet?"), chunks, 3).collect()
    assert calls(log) == distinct + 1 < chunks.count() + 1
    again = searcher("dense", embedder(log), results.vector_store(spark, str(tmp_path / "store"), "model/a"))
    assert again(asked(spark, "wallet?"), chunks, 3).collect() == first and calls(log) == distinct + 1  # nothing is embedded again
    again(asked(spark, "video please"), chunks, 3).collect()
    assert calls(log) == distinct + 2  # its question only
    more = chunks.unionByName(spark.createDataFrame([("c9", "faq", "", "a brand new text")], chunks.schema))
    again(asked(spark, "wallet?"), more, 3).collect()
    assert calls(log) == distinct + 3  # the new chunk only
    assert searcher("dense", plugins.hashed_embedding(16))(asked(spark, "wallet?"), chunks, 3).collect() == first
    other = results.vector_store(spark, str(tmp_path / "store"), "model/b")
    assert other.rows().count() == 0  # models don't share vectors


def test_two_writers_at_once_keep_all(spark, tmp_path, log):
    texts = [[f"writer {w} text {i}" for i in range(40)] for w in range(3)]
    store = lambda: results.vector_store(spark, str(tmp_path / "store"), "m")

    def write(mine):
        store().ask(spark.createDataFrame([(x,) for x in mine], "text string"), "text", embedder(log)).count()

    threads = [Thread(target=write, args=(t + texts[0][:5],)) for t in texts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = store().rows()
    assert rows.count() == rows.select("key").distinct().count() == 120
    done = calls(log)
    for mine in texts:
        write(mine)
    assert calls(log) == done


def test_compaction_keeps_rows_and_later_writes(spark, tmp_path, log):
    path = str(tmp_path / "store")
    store = results.vector_store(spark, path, "m")
    put = lambda s, *x: s.ask(spark.createDataFrame([(t,) for t in x], "text string"), "text", embedder(log)).collect()
    put(store, "one", "two"), put(store, "three")
    before = sorted(map(str, store.rows().collect()))
    store.compact()
    assert sorted(map(str, store.rows().collect())) == before
    put(store, "three", "four")
    assert calls(log) == 4 and store.rows().count() == 4
    store.vacuum()
    fresh = results.vector_store(spark, path, "m")  # another session finds the table by its snapshot
    assert fresh.rows().count() == 4 and put(fresh, "one", "four") and calls(log) == 4
    fresh.compact()
    fresh.vacuum()
    assert fresh.rows().count() == 4 and fresh.writes().count() == 0
    keys = spark.createDataFrame([(r.key,) for r in fresh.rows().collect()], "key string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = keys.join(fresh.merged(fresh.snapshot()[0]), "key")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1  # the keys only: vectors stay where they are
    store.close(), fresh.close()


CASES = [(f"g{i:03}", "answerable", f"question {i}", ["x"], []) for i in range(5)]


def evaluation(spark, log, chunks, ledger=None):
    cases = spark.createDataFrame(CASES, "id string, category string, question string, must_mention array<string>, must_not_mention array<string>")
    drafter = counted(log + "-drafts", lambda p: ("answer", f"x {p[-40:]}", ["c1"], 0.5))
    grader = counted(log + "-grades", lambda p: (True, True, True, True, ""))
    given = ask.ask(cases.select(F.col("id").alias("question_id"), "question"), chunks, drafter, "bm25", 2, ledger=ledger)
    return ask.evaluate_answers(cases, given, chunks, grader, ledger=ledger)


def test_five_cases_are_five_drafts_and_five_grades(spark, log, chunks):
    report = evaluation(spark, log, chunks)
    for _ in range(2):
        assert report["per_case"].count() == 5 and report["by_category"].where("category is null").first().cases == 5
        assert report["run"].first().cases == 5
    assert (calls(log + "-drafts"), calls(log + "-grades")) == (5, 5)


def test_a_rerun_asks_only_what_is_not_there(spark, tmp_path, log, chunks):
    ledger = str(tmp_path / "ledger")
    first = evaluation(spark, log, chunks, ledger)["per_case"].drop("answer_ms").collect()
    second = evaluation(spark, log, chunks, ledger)["per_case"].drop("answer_ms").collect()
    assert sorted(map(str, first)) == sorted(map(str, second)) and len(first) == 5
    assert (calls(log + "-drafts"), calls(log + "-grades")) == (5, 5)


def test_failed_calls_are_asked_again_next_time(spark, tmp_path, log):
    store = results.ResultStore(spark, str(tmp_path / "ledger"), "m", "string")
    df = spark.createDataFrame([("good",), ("bad",), (None,)], "text string")

    def flaky(x):
        if x == "bad" and len(open(log).readlines()) < 4:
            raise ValueError
        return x.upper()

    assert sorted(str(r.result) for r in store.ask(df, "text", counted(log, flaky)).collect()) == ["GOOD", "None", "None"]
    assert calls(log) == 3  # the bad one twice
    assert sorted(str(r.result) for r in store.ask(df, "text", counted(log, flaky)).collect()) == ["BAD", "GOOD", "None"]
    assert calls(log) == 4


def test_a_run_that_dies_keeps_finished_tasks(spark, tmp_path, log, monkeypatch):
    monkeypatch.setattr(results, "TASK_CALLS", 1)
    store = results.ResultStore(spark, str(tmp_path / "ledger"), "m", "string")
    df = spark.createDataFrame([(f"t{i}",) for i in range(12)] + [("poison",)], "text string")

    def dies(x):
        if x == "poison":
            while len(open(log).readlines()) < 6:
                pass
            raise ValueError
        return x

    with pytest.raises(Exception, match="ValueError"):
        store.ask(df, "text", counted(log, dies), attempts=1, strict=True)
    kept = store.rows().count()
    assert 0 < kept <= 12
    before = calls(log)
    assert store.ask(df, "text", counted(log, lambda x: x)).where("result is null").count() == 0
    assert calls(log) - before == 13 - kept


def test_tasks_of_a_fill_stay_a_number_of_times_the_cores(spark, tmp_path, log, monkeypatch):
    monkeypatch.setattr(results, "TASK_CALLS", 1)
    store = results.ResultStore(spark, str(tmp_path / "ledger"), "m", "string")
    df = spark.range(600).select(F.concat(F.lit("t"), "id").alias("text"))
    assert store.ask(df, "text", counted(log, lambda x: x.upper())).where("result = upper(text)").count() == 600
    assert calls(log) == 600
    assert len(list((tmp_path / "ledger").rglob("write=*/part-*.parquet"))) <= results.CORE_TASKS * spark.sparkContext.defaultParallelism
