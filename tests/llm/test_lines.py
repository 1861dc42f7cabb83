import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.llm.lines import LineStore, dedup_lines, line_hashes, sorted_runs

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    owners = defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                owners[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and min(owners[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()}


def test_matches_brute_force(docs, corpus):
    expected = brute(corpus)
    for batches in (1, 3, 7):
        assert result(dedup_lines(docs, batches=batches, fanout=2)) == expected
    assert sum(v[1] for v in expected.values()) > 10


def test_code_points_count(spark):
    rows = [(1, "ééééééééé"), (2, "ééééééééé"), (3, "éééééééééé"), (4, " ÉÉéééééééé"), (5, "éééééééééé")]
    got = result(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert [got[i][1] for i in range(1, 6)] == [0, 0, 0, 0, 1]


def test_empty_table_nulls_and_clashing_columns(spark, empty_docs):
    assert dedup_lines(empty_docs).count() == 0
    rows = [(None, "a line of some length", "x", 5), (2, "a line of some length", None, None), (3, None, "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, __gone int")
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert got[None].n_dropped == 0 and got[2].n_dropped == 1 and got[3].kept_text == ""


def batch_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(line_hashes(10), "id long, h1 long, h2 long")


def test_store_compacts_into_levels(spark):
    for buckets in (2, 4):
        store = LineStore(spark, fanout=2, buckets=buckets)
        for b in range(5):
            store.add(batch_of(spark, [(10 * b + i, f"line number {i * (b + 1)} of a text") for i in range(6)]))
            assert all(len(level) <= 2 for level in store.levels)
        store.compact()
        assert [len(level) for level in store.levels] == [1, 0, 1]
        held = store.runs()[0]
        for run in store.runs()[1:]:
            held = held.unionByName(run)
        assert held.count() == held.select("h1", "h2").distinct().count() == len({i * (b + 1) for b in range(5) for i in range(6)})
        for run in store.runs():
            part = run.withColumn("f", F.input_file_name()).collect()
            assert len({r.f for r in part}) <= buckets
            for f in {r.f for r in part}:
                keys = [(r.h1, r.h2) for r in part if r.f == f]
                assert keys == sorted(keys)
        plan = held._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan or "Bucketed: false" in plan
        store.close()


def test_a_batch_learns_what_it_loses(spark):
    store = LineStore(spark, fanout=2, buckets=4)
    lost = lambda rows: sorted((r.id, r.owner) for r in store.add(batch_of(spark, rows)).collect())
    assert lost([(5, "the first line of all"), (7, "the first line of all\nanother line of text"), (6, "one line of its own")]) == [(7, 5)]
    assert lost([(1, "another line of text\na line that is new here"), (2, "A LINE that is new here\nthe first line of all")]) == [(1, 7), (2, 1), (2, 5)]
    assert lost([(9, "nothing that was seen before")]) == []
    assert lost([(7, "another line of text"), (8, "one line of its own")]) == [(8, 6)]


def test_runs_merge_in_place(spark):
    """Neither the runs nor their compaction are exchanged again, and a run is not sorted again."""
    store = LineStore(spark, fanout=9, buckets=4)
    for b in range(2):
        store.add(batch_of(spark, [(10 * b + i, f"line number {10 * b + i} of a text") for i in range(6)]))
    own = batch_of(spark, [(100, "line number 3 of a text")]).groupBy("h1", "h2").agg(F.min("id").alias("first"))
    for i, run in enumerate(store.runs()):
        own = own.join(run.withColumnRenamed("owner", f"owner{i}").hint("merge"), ["h1", "h2"], "left")
    with sorted_runs(spark):
        plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 2
    assert plan.count("Sort [") == 1


def test_words_left_and_lost(spark):
    rows = [(1, "a line of some length\nshort"), (2, "a line of some length\nanother line with its words"), (3, "a line of some length")]
    got = {r.doc_id: (r.words_left, r.words_lost) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (None, 0), 2: (5, 5), 3: (0, 5)}
