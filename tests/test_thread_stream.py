import random
from datetime import UTC, datetime

from pyspark.sql import functions as F

from quarry.operators.threads import build_threads
from quarry.streaming.streams import run_to_files
from quarry.streaming.threads import advance, empty, thread_stream

MIN = 60_000
START = int(datetime(2024, 1, 1, tzinfo=UTC).timestamp() * 1000)
KIND = "channel string, ts timestamp, index bigint, timestamp bigint, messageIndex bigint, threadRootMessageIndex bigint, repliesToEventIndex bigint"


def chat(channel, base, n, seed):
    """Rows of a channel: replies, thread edges, edges to nowhere, pauses, one thread of over 40 messages."""
    r, at, rows = random.Random(seed), START, []
    for i in range(n):
        at += r.choice([1, 1, 2, 5, 20, 44, 45, 46, 90]) * MIN + r.randrange(2)
        near = [x for x in rows if x[1] >= at - 600 * MIN]
        thread = reply = None
        kind = r.random()
        if near and kind < 0.35:
            reply = r.choice(near[-15:])[0]
        elif near and kind < 0.45:
            thread = r.choice(near)[2]
        elif kind < 0.5:
            reply = base + 10_000_000
        elif kind < 0.53:
            reply = base + i  # itself
        if i > 5 and i % 3 == 0:
            reply, thread = (rows[-1][0], None) if i % 2 else (rows[-3][0], None)
        rows.append((base + i, at, 1_000_000 + base + i, thread, reply))
    return [(channel, at, i, m, t, p) for i, at, m, t, p in rows]


def frame(spark, rows):
    full = [(c, datetime.fromtimestamp(at / 1000, UTC), i, at, m, t, p) for c, at, i, m, t, p in rows]
    return spark.createDataFrame(full, KIND)


def test_stream_equals_batch_on_shuffled_files(spark, tmp_path):
    rows = chat("a", 0, 260, 1) + chat("b", 5000, 120, 2) + chat("c", 9000, 3, 3)
    rows += [("d", START + i * MIN, 20_000 + i, None, None, 20_000 if i else None) for i in range(60)]
    end = max(x[1] for x in rows) + 60 * 24 * 60 * MIN
    r = random.Random(4)
    rows = sorted(rows, key=lambda x: x[1] + r.randrange(50 * MIN))  # arrival up to 50 minutes late
    files = [rows[i : i + 60] for i in range(0, len(rows), 60)] + [[("z", end, 99_999, 1, None, None)]]
    for i, part in enumerate(files):
        frame(spark, [*part, *part[:2]]).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={i}"))  # two rows come twice
    want = {(x.channel, x.thread, x["index"]) for x in build_threads(frame(spark, rows), "channel").select("channel", "thread", "index").collect()}
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("n")
    out = run_to_files(thread_stream(stream, "ts", "channel"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = [(x.channel, x.thread, x["index"]) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert max(out.groupBy("thread").count().agg(F.max("count").alias("n")).first()) == 40


def test_result_is_the_same_at_any_step_and_state_is_bounded():
    rows = [x[1:] for x in chat("a", 0, 3000, 7)]
    reply, end = 24 * 60 * MIN, rows[-1][0] + 3 * 24 * 60 * MIN
    once = empty()
    once["waiting"] = list(rows)
    want = sorted(advance(once, end, reply))
    assert not once["open"] and not once["waiting"] and not once["names"]
    got, state, most = [], empty(), 0
    for i in range(0, len(rows), 10):
        state["waiting"] += rows[i : i + 10]
        got += advance(state, rows[i][0], reply)
        most = max(most, len(state["open"]))
    got += advance(state, end, reply)
    assert sorted(got) == want
    assert most < 600


def test_late_reply_leads_nowhere():
    reply = 60 * MIN
    for gap, want in ((60, [(0, 0), (0, 1)]), (61, [(0, 0), (1, 1)])):
        state = empty()
        state["waiting"] = [(0, 0, None, None, None), (gap * MIN, 1, None, None, 0)]
        assert sorted(advance(state, 10**9, reply)) == want
