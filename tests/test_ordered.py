import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import ordered, threads


@pytest.fixture(params=[1, 5])
def parts(spark, request):
    """Few and many ranges."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.randint(0, 50), i, rng.randint(-5, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(4)
    got = ordered.numbered(ordered.running_sums(df, [F.desc("a"), F.asc("b")], {"s": F.col("v")}), [F.desc("a"), F.asc("b")]).collect()
    total, want = 0, {}
    for n, (a, b, v) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1):
        total += v
        want[b] = (total, n)
    assert {r.b: (r.s, r.n) for r in got} == want
    assert ordered.numbered(df.limit(0), ["a", "b"]).count() == 0


@pytest.mark.parametrize("by", [[], ["who"]])
def test_gap_runs(spark, parts, by):
    """Runs that span many ranges, and one stream that holds most rows."""
    rng = random.Random(7)
    rows, at = [], 0
    for i in range(600):
        at += rng.choice([1, 1, 1, 45, 45, 46]) if i % 200 > 100 else 1
        rows.append((i, "hot" if rng.random() < 0.8 else rng.choice(["x", None]), at))
    df = spark.createDataFrame(rows, "i int, who string, minute int").withColumn("ts", F.timestamp_seconds(F.col("minute") * 60)).repartition(3)
    got = {r.i: (r["__run"], r["__first"]) for r in ordered.gap_runs(df, "ts", ["i"], by, 45 * 60_000_000, "i").collect()}
    want, run, last = {}, 0, None
    for i, who, minute in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or "") if by else 0, r[0])):
        if last is None or minute - last[1] > 45 or by and who != last[0]:
            run, first = run + 1, i
        want[i], last = (run, first), (who, minute)
    assert got == want


def walk(e, events, hops):
    """The root of event e, step by step."""
    by_message = {}
    for x in events:
        if x[1] is not None:
            by_message[x[1]] = max(by_message.get(x[1], -1), x[0])
    at = {x[0]: x for x in events}
    if e[2] is not None:
        return by_message.get(e[2])
    root, nxt = None, e[3] if e[3] in at else None
    for _ in range(hops + 1):
        if nxt is None:
            break
        x = at[nxt]
        if x[2] is not None:
            return by_message.get(x[2], x[0])
        root, nxt = x[0], x[3] if x[3] in at else None
    return root


@pytest.mark.parametrize("seed", range(3))
def test_roots_by_doubling(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        reply = rng.choice([None, i - 1, i - 1, i - 1, max(0, i - rng.randint(1, 5)), 999]) if i else None
        rows.append((i, i + 1000 if rng.random() < 0.8 else None, rng.randint(1000, 1150) if rng.random() < 0.05 else None, reply))
    df = spark.createDataFrame(rows, "index long, messageIndex long, threadRootMessageIndex long, repliesToEventIndex long")
    assert {r["index"]: r.root for r in threads.thread_roots(df).collect()} == {e[0]: walk(e, rows, threads.MAX_HOPS) for e in rows}


def test_chains_and_loops_end(spark):
    rows = [(i, None, None, i - 1 if i else None) for i in range(30)] + [(100, None, None, 101), (101, None, None, 100)]
    df = spark.createDataFrame(rows, "index long, messageIndex long, threadRootMessageIndex long, repliesToEventIndex long")
    found = threads.thread_roots(df)
    assert {r["index"]: r.root for r in found.collect()} == {e[0]: walk(e, rows, threads.MAX_HOPS) for e in rows}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1  # each step is written


def test_no_task_orders_all_rows(spark):
    rows = [(i, None, None, None, i * 60_000) for i in range(50)]
    df = spark.createDataFrame(rows, "index long, messageIndex long, threadRootMessageIndex long, repliesToEventIndex long, timestamp long")
    plan = threads.build_threads(df)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        assert "Window" not in line or "__part" in line or "thread" in line
