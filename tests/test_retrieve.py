import math

import pytest

from quarry.operators import retrieve


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def ranking(df, q=1):
    return [r.id for r in df.where(df.question_id == q).orderBy("rank").collect()]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(1, "", "reset your wallet with the ERR42 code"), (2, "wallet", "a video about cats"), (3, "", "vote on things"), (4, "", "nothing here")]
    return spark.createDataFrame(rows, "id long, title string, text string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "ERR42 wallet wallet"), (2, "zzz"), (3, "Vote, vote!")], "question_id long, question string")


def test_lexical_counts_distinct_tokens_and_fills(questions, chunks):
    out = retrieve.lexical(questions, chunks, 3)
    assert ranking(out, 1) == [1, 2, 3] and ranking(out, 2) == [1, 2, 3] and ranking(out, 3)[0] == 3
    assert [r.score for r in out.where("question_id = 1").orderBy("rank").collect()] == [2.0, 1.0, 0.0]


def brute_bm25(docs, query, k1=1.5, b=0.75):
    import re

    toks = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in docs.items()}
    mean = sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, words in toks.items():
        s = 0.0
        for w in re.findall("[a-z0-9]+", query.lower()):
            df = sum(w in x for x in toks.values())
            tf = words.count(w)
            if tf:
                s += math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean))
        out[i] = round(s, 6)
    return out


def test_bm25_scores_and_fillers(questions, chunks):
    docs = {r.id: f"{r.title} {r.text}" for r in chunks.collect()}
    for postings in (None, retrieve.build_postings(chunks)):
        out = retrieve.bm25(questions, chunks, 4, postings=postings).collect()
        for q, text in ((1, "ERR42 wallet wallet"), (2, "zzz"), (3, "Vote, vote!")):
            scores = brute_bm25(docs, text)
            expected = sorted(scores, key=lambda i: (-scores[i], i))
            got = sorted((r for r in out if r.question_id == q), key=lambda r: r.rank)
            assert [r.id for r in got] == expected
            assert [r.score for r in got] == pytest.approx([scores[i] for i in expected], abs=2e-6)


def test_bm25_on_an_empty_corpus(questions, chunks):
    assert retrieve.bm25(questions, chunks.limit(0), 3).count() == 0


def test_dense_order_ties_and_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [3.0, 0.0]), (9, [0.0, 5.0])], "question_id long, embedding array<float>")
    out = retrieve.dense(q, v, 4)
    assert ranking(out, 1) == [1, 2, 3, 4] and ranking(out, 9) == [3, 1, 2, 4]
    assert ranking(retrieve.dense(q, v, 2, exclude_self=True, block_bytes=1), 1) == [2, 3]


def test_fusion_prefers_two_seconds_to_one_first(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "question_id long, id long, rank int")
    b = spark.createDataFrame([(1, 30, 1), (1, 20, 2)], "question_id long, id long, rank int")
    out = retrieve.fuse([a, b], 3)
    assert ranking(out) == [20, 10, 30]
    assert out.count() == 3
    assert ranking(retrieve.fuse([a, b], 3, depth=1)) == [10, 30]


def test_hybrid_gives_fillers_votes(spark, questions, chunks):
    first = spark.createDataFrame([(2, 4, 1)], "question_id long, id long, rank int")
    assert ranking(retrieve.hybrid(questions, chunks, lambda depth: first, 4), 2) == [4, 1, 2, 3]


def test_rerank(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(1, i, i, "q", "t" * i) for i in range(1, 6)], "question_id long, id long, rank int, question string, text string")
    assert ranking(retrieve.rerank(r, lambda q, t: F.length(t).cast("double"), depth=4, k=2)) == [4, 3]


def test_unknown_retriever():
    with pytest.raises(ValueError):
        retrieve.retriever("magic")


def test_rerank_by_model(spark, tmp_path):
    """The model is loaded once for each task, sees few pairs at a time, and its scores come back to their rows."""
    rows = [(q, i, f"question {q}", "x" * ((i * 7 + q) % 23), i) for q in (1, 2) for i in range(1, 31)] + [(3, 1, "q", None, 1)]
    ranked = spark.createDataFrame(rows, "question_id long, id long, question string, text string, rank int").coalesce(1)
    log = str(tmp_path / "log")

    def make():
        open(log, "a").write("loaded\n")

        def score(questions, texts):
            open(log, "a").write(f"{len(texts)}\n")
            return [len(t or "") / 100 for t in texts]

        return score

    got = [(r.question_id, r.id, r.score, r["rank"]) for r in retrieve.rerank_by_model(ranked, make, depth=20, k=3, pairs=8).orderBy("question_id", "rank").collect()]
    want = []
    for q in (1, 2):
        best = sorted(((-(((i * 7 + q) % 23) / 100), i) for i in range(1, 21)))[:3]
        want += [(q, i, -s, n) for n, (s, i) in enumerate(best, 1)]
    assert got == [*want, (3, 1, 0.0, 1)]
    lines = open(log).read().split()
    assert lines.count("loaded") == 1 and sum(map(int, lines[1:])) == 41 and max(map(int, lines[1:])) == 8


def test_texts_become_python_objects_a_few_at_a_time(spark, questions, chunks, monkeypatch):
    """What match and holders hold of a batch of 20 MB of text, besides the batch."""
    import tracemalloc

    import pyarrow as pa

    from quarry.operators.chunks import holders

    class Taken(Exception):
        pass

    class Given:  # a DataFrame that keeps what its tasks would run
        def __init__(self, df):
            self.df = df

        def __getattr__(self, name):
            return getattr(self.df, name)

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            raise Taken

        def mapInPandas(self, run, schema):
            self.run = lambda batches: run(b.to_pandas() for b in batches)
            raise Taken

    given = Given(chunks)
    monkeypatch.setattr(retrieve, "_body", lambda *_: given)
    ids, texts = pa.array(range(4000)), pa.array([f"reset your wallet {i} " * 200 for i in range(4000)])
    for start, columns in ((lambda: retrieve.match(questions, given), "iob"), (lambda: holders(given, questions.selectExpr("question_id item_id", "question item")), "it")):
        with pytest.raises(Taken):
            start()
        batch = pa.RecordBatch.from_arrays([ids] * (len(columns) - 1) + [texts], list(columns))
        tracemalloc.start()
        for _ in given.run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 5e6
