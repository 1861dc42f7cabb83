import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieve
from quarry.operators.vectors import VectorIndex
from quarry.plans import catalogue


def rows_of(df):
    return sorted((r.question_id, r["rank"], r.id, r.score) for r in df.collect())


@pytest.mark.parametrize("kind", ["int", "string"])
def test_equals_dense(spark, tmp_path, kind):
    """Clustered vectors with ties, zero vectors, an empty one, one huge cluster of equal vectors."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(20, 8))
    v = [(middle[i % 20] + 0.05 * rng.normal(size=8)).tolist() for i in range(600)] + [[1.0] * 8] * 300 + [[0.0] * 8] * 5 + [[]]
    name = (lambda i: i) if kind == "int" else (lambda i: f"k{i:04}")
    df = spark.createDataFrame([(name(i), x) for i, x in enumerate(v)], f"id {'long' if kind == 'int' else 'string'}, embedding array<float>").repartition(4)
    index = VectorIndex(spark, str(tmp_path / kind))
    index.build(df, centres=24)
    q = df.where(F.xxhash64("id") % 9 == 0).withColumnRenamed("id", "question_id")
    for k, own in ((1, True), (7, False)):
        assert rows_of(index.search(q, k, own)) == rows_of(retrieve.dense(q, df, k, own))
        assert 0 < index.share_read() < 0.75
    zero = spark.createDataFrame([(name(5000), [0.0] * 8), (name(5001), v[0])], q.schema)
    assert rows_of(index.search(zero, 4, block_bytes=1)) == rows_of(retrieve.dense(zero, df, 4))
    assert rows_of(index.search(zero, 2000)) == rows_of(retrieve.dense(zero, df, 2000))  # more than there are
    assert index.search(q.limit(0), 3).count() == 0


def test_nothing_but_zero_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "id long, embedding array<float>")
    index = VectorIndex(spark, str(tmp_path / "zero"))
    index.build(df)
    q = spark.createDataFrame([(9, [1.0, 0.0])], "question_id long, embedding array<float>")
    assert rows_of(index.search(q, 3)) == rows_of(retrieve.dense(q, df, 3)) == [(9, 1, 1, 0.0), (9, 2, 2, 0.0)]


@pytest.mark.parametrize("kind", [int, str])
def test_products_are_taken_in_small_blocks(monkeypatch, kind):
    """No matrix of scores is larger than a block, however many vectors a batch has, and the best are those of one product."""
    rng = np.random.default_rng(5)
    v = rng.integers(-1, 2, size=(3000, 6)).astype(float)  # with many ties
    keys = retrieve.plain_ids([kind(i) for i in rng.permutation(3000).tolist()])
    asked, q = keys[:1500], v[:1500]
    sizes, cells = [], retrieve.best_cells
    monkeypatch.setattr(retrieve, "best_cells", lambda s, *a: sizes.append(s.shape) or cells(s, *a))
    for k in (3, 700):
        some = slice(0, 1500 if k == 3 else 40)
        found = [np.concatenate(x) for x in zip(*retrieve.best_products(asked[some], q[some], keys, v, k, True), strict=True)]
        scores = np.round(q[some] @ v.T, retrieve.DIGITS)
        scores[asked[some][:, None] == keys[None, :]] = -np.inf
        rows, columns = cells(scores, keys, k)
        assert (found[0] == rows).all() and (found[1] == columns).all() and (found[2] == scores[rows, columns]).all()
    assert max(a for a, _ in sizes) == 1024 and max(b for _, b in sizes) == 512


@pytest.mark.parametrize("kind", [int, str])
@pytest.mark.parametrize("block_bytes", [16 << 20, 5000])
def test_neighbours_of_every_vector(spark, kind, block_bytes):
    """Every vector asks, whatever its id, in one block or in pairs of some: ties, equal and zero vectors, one without components, one without an id."""
    rng = np.random.default_rng(7)
    v = rng.integers(-1, 2, size=(600, 6)).astype(float).tolist() + [[1.0] * 6] * 40 + [[0.0] * 6] * 3
    rows = [(kind(i), x) for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, (kind(9000), []), (None, v[0])], f"id {'long' if kind is int else 'string'}, embedding array<float>").repartition(3)
    unit, keys = retrieve.unit(np.array(v)), [r[0] for r in rows]
    scores = np.round(unit @ unit.T, retrieve.DIGITS)
    want = []
    for i, key in enumerate(keys):
        best = sorted((-scores[i, j] + 0.0, other) for j, other in enumerate(keys) if j != i)[:7]
        want += [(key, n, other, -s + 0.0) for n, (s, other) in enumerate(best, 1)]
    assert [(a, n, b, s + 0.0) for a, n, b, s in rows_of(retrieve.neighbours(df, 7, block_bytes))] == sorted(want)
    assert retrieve.neighbours(df.limit(0), 7).count() == 0


@pytest.mark.parametrize("name", ["dense_by_label", "dense_topk"])
def test_queries_ask_every_vector(spark, sf, name):
    asked = catalogue.QUERIES[name](spark, sf).select("question_id").distinct()
    assert asked.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
