import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def shared_out(sizes, weights, share=1.5, cap=2.0):
    """Targets by repeated sharing: full sources leave, the excess goes to the others by weight."""
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        weight = sum(weights[s] for s in sizes if s not in full)
        out = {s: cap * sizes[s] if s in full else rest * weights[s] / weight for s in sizes}
        above = {s for s in sizes if s not in full and out[s] > cap * sizes[s]}
        if not above:
            return out
        full |= above


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(3000):
        source = rng.choice(["b", "b", "b", "b", "a", "ß", "é", "Z", "", "z", None])
        out.append((i, source, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 60)))))
    return out + [(4000, "a", None), (4001, "b", " \t\x1c \n x\x0by"), (4002, "only empty", ""), (4003, "long", "w " * 300_000)]


@pytest.fixture(scope="module")
def mixed(spark, rows):
    return mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()


def test_targets(rows, mixed):
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len((text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = shared_out(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for r in mixed:
        assert r.size == len((r.text or "").encode().split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-12)
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate) <= r.copies <= int(rate) + (rate % 1 > 0) and r.taken == r.size * r.copies <= 2 * r.size
    assert sum({r.source: r.target for r in mixed}.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_taken_comes_near(mixed):
    for source in {r.source for r in mixed}:
        mine = [r for r in mixed if r.source == source]
        fraction = mine[0].target / mine[0].source_size % 1 if mine[0].source_size else 0
        deviation = (fraction * (1 - fraction) * sum(r.size**2 for r in mine)) ** 0.5
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 4 * deviation + 1e-6


def test_reruns_agree(spark, rows, mixed):
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(2)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, mixed), key=str)


def test_equal_rows_meet_their_rate(spark):
    """A third of all rows are one row; some ids are null or repeated."""
    rows = [(7, "a", "one two three")] * 3000 + [(None, "a", f"t {i} x") for i in range(1000)] + [(i, s, "o p q r") for s in "bcd" for i in range(1500)]
    first, second = (mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect() for n in (3, 7))
    assert len(first) == len(rows) and sorted(map(tuple, first), key=str) == sorted(map(tuple, second), key=str)
    for source in "abcd":
        mine = [r for r in first if r.source == source]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.1)
    hot = [r for r in first if (r.doc_id, r.source) == (7, "a")]
    rate = hot[0].target / hot[0].source_size
    assert {r.copies for r in hot} == {int(rate), int(rate) + 1} and sum(r.copies for r in hot) / len(hot) == pytest.approx(rate, abs=0.05)


def test_copies_and_clashing_columns(spark):
    rows = [(i, "ab"[i % 2], "one two", "mine", i) for i in range(40)]
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA + ", target string, extra int"))
    out = mixing.emitted(found)
    assert found.columns == ["doc_id", "source", "text", "extra", *mixing.OUTPUT]
    assert Counter(r.doc_id for r in out.collect()) == {r.doc_id: r.copies for r in found.collect() if r.copies}


def test_weights_of_a_table(spark):
    rows = [(i, "abc"[i % 3], "w " * 10) for i in range(90)]
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    found = {r.source: r.target for r in mixing.mix(spark.createDataFrame(rows, SCHEMA), weights, share=0.5).collect()}
    assert found == pytest.approx({"a": 450 / 4, "b": 450 * 3 / 4, "c": 0.0})
    more = {r.source: r.target for r in mixing.mix(spark.createDataFrame(rows, SCHEMA), weights, share=9.0).collect()}
    assert more == {"a": 600.0, "b": 600.0, "c": 0.0}  # every weighted source is full


def test_empty_table(spark, empty_docs):
    assert mixing.mix(empty_docs.withColumn("source", F.lit(None).cast("string"))).collect() == []


def test_no_words_at_all(spark):
    assert [tuple(r)[-4:] for r in mixing.mix(spark.createDataFrame([(1, "a", None), (2, None, " ")], SCHEMA)).collect()] == [(0, 0.0, 0, 0)] * 2


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    found = mixing.op11_source_mixing(spark, sf)
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(f"select {', '.join(found.columns)} from ({mixing.SQL})").fetchall())
