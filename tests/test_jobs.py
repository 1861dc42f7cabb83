import logging
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jobs import ingest_corpus, queries, retrieval_report, settings


def rows_of(df):
    return sorted(map(str, df.collect()))


def land(spark, folder, name, rows):
    """One more file in a landing folder."""
    spark.createDataFrame(rows, ingest_corpus.DOCUMENT).coalesce(1).write.parquet(f"{folder}-{name}")
    folder.mkdir(exist_ok=True)
    for f in (folder.parent / f"{folder.name}-{name}").glob("*.parquet"):
        shutil.copy(f, folder / f"{name}.parquet")


@pytest.fixture
def places(tmp_path):
    return tmp_path / "landing", str(tmp_path / "corpus"), str(tmp_path / "checkpoint")


FIRST = [(1, "One text.", "en", "a"), (2, "One  text. ", "en", "b"), (3, None, "en", "a"), (4, " \n ", "en", "a"), (None, "No id.", "en", "a"), (5, "A sentence. " * 300, "de", "")]
SECOND = [(6, "One text.", "en", "a"), (7, "Another text.", "en", "a"), (7, "Another text.", "en", "a"), (8, "Null source.", None, None)]


def test_only_what_is_new(spark, places):
    landing, corpus, checkpoint = places
    land(spark, landing, "one", FIRST)
    first = rows_of(ingest_corpus.run(spark, str(landing), corpus, checkpoint))
    assert rows_of(ingest_corpus.run(spark, str(landing), corpus, checkpoint)) == first  # nothing new
    land(spark, landing, "two", SECOND)
    both = ingest_corpus.run(spark, str(landing), corpus, checkpoint)
    assert set(first) < set(rows_of(both))
    assert sorted((r.doc_id, r.source, r.batch) for r in both.collect() if r.doc_id != 5) == [(1, "a", 0), (7, "a", 1), (8, "unknown", 1)]
    long = [r for r in both.collect() if r.doc_id == 5]
    assert len(long) > 0 and all(r.chars <= 1500 and r.source == "unknown" for r in long)
    report = {r.batch: (r.docs, r.rejected, r.chunks + r.copies) for r in ingest_corpus.read(spark, corpus, "report").collect()}
    assert report[0][:2] == (6, 3) and report[1] == (4, 0, 4)
    problems = {(r.doc_id, r.problem) for r in ingest_corpus.read(spark, corpus, "rejects").collect()}
    assert problems == {(3, "no text"), (4, "no text"), (None, "no id")}


def test_growing_input_equals_one_run_over_content(spark, places, sf, tmp_path):
    """The given documents in three deliveries hold the same contents as in one."""
    landing, corpus, checkpoint = places
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    for n in range(3):
        land(spark, landing, f"part{n}", [tuple(r) for r in docs.where(F.col("doc_id") % 3 == n).collect()])
        grown = ingest_corpus.run(spark, str(landing), corpus, checkpoint)
    whole = ingest_corpus.run(spark, f"{sf}/documents.parque[t]", str(tmp_path / "whole"), str(tmp_path / "whole-checkpoint"))
    hashes = lambda df: sorted(r.content_hash for r in df.select("content_hash").collect())
    assert hashes(grown) == hashes(whole)


def test_a_batch_that_failed_runs_again(spark, places, monkeypatch):
    landing, corpus, checkpoint = places
    land(spark, landing, "one", FIRST)
    ingest_corpus.run(spark, str(landing), corpus, checkpoint)
    land(spark, landing, "two", SECOND)
    write = ingest_corpus._write

    def fails(df, output, name, by, mode="overwrite"):
        if name == "report" and mode == "overwrite":
            raise OSError("the driver was lost")
        write(df, output, name, by, mode)

    monkeypatch.setattr(ingest_corpus, "_write", fails)
    with pytest.raises(Exception, match="the driver was lost"):
        ingest_corpus.run(spark, str(landing), corpus, checkpoint)
    monkeypatch.undo()
    again = ingest_corpus.run(spark, str(landing), corpus, checkpoint)
    assert sorted(r.doc_id for r in again.where("batch = 1").collect()) == [7, 8]
    assert again.count() == again.select("content_hash").distinct().count()


def test_large_batches_meet_the_corpus_in_a_join(spark, places, monkeypatch):
    monkeypatch.setattr(ingest_corpus, "BROADCAST_ROWS", 1)
    test_only_what_is_new(spark, places)


def test_another_checkpoint_is_an_error(spark, places, tmp_path):
    landing, corpus, checkpoint = places
    for name, rows in (("one", FIRST), ("two", SECOND)):
        land(spark, landing, name, rows)
        ingest_corpus.run(spark, str(landing), corpus, checkpoint)
    with pytest.raises(Exception, match="another checkpoint"):
        ingest_corpus.run(spark, str(landing), corpus, str(tmp_path / "new"))


def test_report_is_rerun_and_extended(spark, sf, tmp_path):
    args = spark, f"{sf}/documents.parquet", f"{sf}/benchmark.parquet", str(tmp_path / "report")
    one = retrieval_report.run(*args, {"strategies": ["bm25"]})
    first = rows_of(one)
    assert {r.strategy for r in one.collect()} == {"bm25"} and {r.level for r in one.collect()} == set(retrieval_report.LEVELS)
    both = rows_of(retrieval_report.run(*args, {"strategies": ["lexical"]}))
    assert set(first) < set(both)
    assert rows_of(retrieval_report.run(*args, {"strategies": ["bm25"]})) == both


def test_report_measures(spark, tmp_path):
    docs = [(i, f"common words and {w} here") for i, w in enumerate(["alpha", "beta", "alpha beta", "gamma"])] + [(9, "nothing")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    asked = [(1, "alpha"), (2, "gamma here"), (3, "not held"), (4, "beta")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "asked"))
    out = retrieval_report.run(spark, str(tmp_path / "docs"), str(tmp_path / "asked"), str(tmp_path / "out"), {"strategies": ["lexical"], "depth": 3})
    case = {r.name: r for r in out.where("level = 'case'").collect()}
    assert {k: (r.holders, r.rr, r.retrieved) for k, r in case.items()} == {"1": (2, 1.0, "0,2"), "2": (1, 1.0, "3,0,1"), "4": (2, 1.0, "1,2")}
    assert {(r.name, r.cases, r.holders) for r in out.where("level <> 'case'").collect()} == {("single", 1, 1), ("several", 2, 4), (None, 3, 5)}


def test_unknown_settings_and_strategies(spark, sf, tmp_path):
    with pytest.raises(ValueError, match="unknown settings"):
        settings.settings({"a": 1}, {"b": 2})
    with pytest.raises(ValueError, match="unknown strategies"):
        retrieval_report.run(spark, f"{sf}/documents.parquet", f"{sf}/benchmark.parquet", str(tmp_path), {"strategies": ["magic"]})


def test_command_line(monkeypatch, tmp_path, caplog):
    """The command line reads the config file, gives its own session to the job, and stops it."""
    seen = {}

    class Session:
        def stop(self):
            seen["stopped"] = True

    monkeypatch.setattr(settings, "build_session", lambda name: Session())
    config = tmp_path / "c.toml"
    config.write_text("depth = 3\n")
    main = settings.command("job", {"source": "s", "output": "o"}, config, lambda spark, *args: seen.update(args=args))
    assert main(["--source", "in", "--output", "out"]) == 0
    assert seen == {"args": ("in", "out", {"depth": 3}), "stopped": True}
    for job in (ingest_corpus, retrieval_report):
        assert set(settings.tomllib.loads((settings.Path(job.__file__).with_suffix(".toml")).read_text())) == set(job.DEFAULTS)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_their_sql(spark, sf, name, caplog):
    caplog.set_level(logging.INFO)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == sorted(df.columns)
    spelled = lambda v: "%.9g" % v if isinstance(v, float) else str(v)
    assert sorted(tuple(spelled(r[c]) for c in theirs) for r in df.collect()) == sorted(tuple(map(spelled, r)) for r in cur.fetchall())
    assert "read" in caplog.text and "chunks to" in caplog.text or "cases to" in caplog.text


def test_texts_are_split_once_and_tidied_for_rejects_only_where_needed(spark, places, monkeypatch):
    landing, corpus, checkpoint = places
    odd = ["a  b", " a \t é ", "\xa0\xa0\xa0\xa0", "éé é", "ab", "", None, "abc", "\x1c\x1c\x1c", " \n\n\n x　"]
    land(spark, landing, "odd", [(i, t, "en", "a") for i, t in enumerate(odd)])
    splits = []
    split, tidy = ingest_corpus.split_prose, ingest_corpus.tidy
    monkeypatch.setattr(ingest_corpus, "split_prose", lambda *a: splits.append(a) or split(*a))
    ingest_corpus.run(spark, str(landing), corpus, checkpoint, {"least_chars": 3})
    assert len(splits) == 1
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    least = docs.withColumn("body", tidy(F.col("text"))).where(ingest_corpus.problem_of(3).isNotNull())
    assert {r.doc_id for r in ingest_corpus.read(spark, corpus, "rejects").collect()} == {r.doc_id for r in least.collect()} == {2, 4, 5, 6, 9}
    usual = docs.where(~ingest_corpus.maybe_rejected(3))  # no need to tidy these to know
    assert {r.doc_id for r in usual.collect()} == {7}
    assert docs.where(ingest_corpus.maybe_rejected(101)).count() == len(odd)
