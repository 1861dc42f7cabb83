import math
import random
from collections import Counter

from quarry.llm.sharding import communication_matrix, hypergeometric, hypergeometric_shards, log_hypergeometric


def test_matrix_margins():
    for sizes in ([5, 0, 17, 300], [1], [0, 0], [1000, 999, 3]):
        m = communication_matrix(sizes, 7, 3)
        assert [sum(r) for r in m] == sizes
        columns = [sum(c) for c in zip(*m, strict=True)]
        assert max(columns) - min(columns) <= 1 and sum(columns) == sum(sizes)
        assert all(x >= 0 for r in m for x in r)


def test_draw_follows_the_distribution():
    rng = random.Random(1)
    draws = Counter(hypergeometric(rng, 5, 5, 4) for _ in range(20000))
    expected = {0: 5 / 210, 1: 50 / 210, 2: 100 / 210, 3: 50 / 210, 4: 5 / 210}
    assert all(abs(draws[k] / 20000 - p) < 0.015 for k, p in expected.items())
    assert hypergeometric(rng, 0, 9, 4) == 0 and hypergeometric(rng, 9, 0, 4) == 4


def test_law_rows(docs, corpus):
    for per_block in (500_000, 1):
        rows = hypergeometric_shards(docs, ["doc_id"], n_shards=8, rows_per_block=per_block).collect()
        assert sorted(r.doc_id for r in rows) == [i for i, _ in corpus]
        sizes = Counter(r.shard for r in rows)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
        for s, n in sizes.items():
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def test_repeated_rows_nulls_empty_and_clashes(spark, empty_docs):
    rows = [(None, None, 9)] * 3 + [(1, "a", 9)] * 10
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = hypergeometric_shards(df, ["doc_id"], ["text"], 4).collect()
    assert len(out) == 13 and Counter(r.shard for r in out).most_common(1)[0][1] == 4
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)
    assert hypergeometric_shards(empty_docs, ["doc_id"], n_shards=4).count() == 0


def test_order_is_shuffled(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    rows = hypergeometric_shards(df, ["doc_id"], n_shards=4).collect()
    first = sorted((r.slot, r.doc_id) for r in rows if r.shard == 0)
    ups = sum(a[1] < b[1] for a, b in zip(first, first[1:], strict=False))
    assert 400 < ups < 600


def test_probabilities_are_exact_at_any_size():
    rng = random.Random(2)
    for _ in range(200):
        good, bad = rng.randint(1, 3000), rng.randint(1, 3000)
        draws = rng.randint(1, good + bad - 1)
        x = rng.randint(max(0, draws - bad), min(draws, good))
        exact = math.log(math.comb(good, x)) + math.log(math.comb(bad, draws - x)) - math.log(math.comb(good + bad, draws))
        assert abs(log_hypergeometric(x, good, bad, draws) - exact) < 1e-9
    good, total, draws = 25 * 10**8, 10**11, 500_000
    mean = draws * good // total
    assert abs(sum(math.exp(log_hypergeometric(x, good, total - good, draws)) for x in range(mean - 1500, mean + 1500)) - 1) < 1e-9


def test_equal_keys_and_rows_are_spread(spark):
    """A key that all rows share, and rows that are equal: blocks, shards and slots as for any other rows."""
    df = spark.createDataFrame([(7, "same", i if i % 2 else 0) for i in range(4000)], "doc_id long, text string, n int")
    rows = hypergeometric_shards(df, ["doc_id"], ["text"], 4, min_blocks=16).collect()
    assert Counter(r.shard for r in rows) == {s: 1000 for s in range(4)}
    odd = [sum(r.n % 2 for r in rows if r.shard == s) for s in range(4)]
    assert all(430 < x < 570 for x in odd)
    first = [r.n for r in sorted((r for r in rows if r.shard == 0 and r.n), key=lambda r: r.slot)]
    ups = sum(a < b for a, b in zip(first, first[1:], strict=False))
    assert 0.42 < ups / len(first) < 0.58
