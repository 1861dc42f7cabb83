from pyspark.sql import functions as F

from quarry.operators import threads
from quarry.sources.readers import clean_events
from quarry.sources.schemas import EVENT

MIN = 60_000


def events(spark, rows):
    """rows: (index, minute, sender, text, thread_root, reply_to)."""
    full = [(i, m * MIN if isinstance(m, int) else int(m * MIN), 1000 + i, s, t, r, p, None, False, False) for i, m, s, t, r, p in rows]
    return spark.createDataFrame(full, EVENT)


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.thread, []).append(r["index"])
    return {k: sorted(v) for k, v in out.items()}


def test_cleaning(spark):
    rows = [
        (0, 0, 0, "u", "fine", None, None, None, False, False),
        (1, 0, 1, "u", "fine", None, None, None, True, False),
        (2, 0, 2, "u", "fine", None, None, None, False, True),
        (3, 0, 3, "u", "   ", None, None, None, None, None),
        (4, 0, 4, "u", "gm", None, None, None, None, None),
        (5, 0, 5, "u", "  /help me", None, None, None, None, None),
        (6, 0, 6, "u", None, None, None, None, None, None),
        (7, 0, 7, "u", "é", None, None, {"x": 1}, None, None),
    ]
    assert sorted(r["index"] for r in clean_events(spark.createDataFrame(rows, EVENT)).collect()) == [0, 7]


def test_reply_chain_root_and_bound(spark):
    rows = [(i, i, "a", "t", None, i - 1 if i else None) for i in range(13)]
    got = {r["index"]: r.root for r in threads.thread_roots(events(spark, rows)).collect()}
    assert got[0] is None and all(got[i] == 0 for i in range(1, 12))
    assert got[12] == 1  # the eleventh ancestor is the last that counts


def test_thread_edges_and_dangling_parents(spark):
    rows = [
        (0, 0, "a", "root at zero", None, None),
        (1, 1, "b", "in thread", 1000, None),
        (2, 2, "c", "reply to threaded", None, 1),
        (3, 3, "d", "thread edge nowhere", 5555, 0),
        (4, 4, "e", "reply nowhere", None, 77),
        (5, 5, "f", "itself", None, 5),
    ]
    got = {r["index"]: r.root for r in threads.thread_roots(events(spark, rows)).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: None, 4: None, 5: 5}


def test_gap_threads_and_cap(spark):
    rows = [(0, 0, "a", "x", None, None), (1, 45, "a", "x", None, None), (2, 90.0001, "b", "x", None, None)]
    assert groups(threads.build_threads(events(spark, rows))) == {0: [0, 1], 2: [2]}
    many = [(i, i, "a", "x", None, 0 if i else None) for i in range(50)]
    assert groups(threads.build_threads(events(spark, many)))[0] == list(range(40))


def test_channels_are_separate_streams(spark):
    rows = [(i, i, "a", "x", None, None) for i in range(6)]
    df = events(spark, rows).withColumn("channel", F.col("index") % 2)
    assert groups(threads.build_threads(df, "channel")) == {0: [0, 2, 4], 1: [1, 3, 5]}


def test_edges_take_messages_out_of_gap_threads(spark):
    rows = [(0, 0, "a", "x", None, None), (1, 1, "b", "x", None, None), (2, 2, "c", "x", None, 0)]
    assert groups(threads.build_threads(events(spark, rows))) == {0: [0, 2], 1: [1]}


def test_shortlist_alias_render(spark):
    rows = [
        (0, 0, "a", "How do I reset?", None, None), (1, 1, "b", "y" * 60, None, 0), (2, 2, "a", "ok", None, 0),
        (10, 500, "a", "How so?", None, None), (11, 501, "a", "y" * 80, None, 10),
        (20, 900, "a", "No question", None, None), (21, 901, "b", "y" * 80, None, 20),
        (30, 2000, "a", "what now", None, None), (31, 2001, "b", "short", None, 30),
    ]
    members = threads.build_threads(events(spark, rows))
    assert [(r.thread, r.messages) for r in threads.shortlist(members).collect()] == [(0, 3)]
    line = threads.render_threads(members.where("thread = 0")).first().rendered.split("\n")
    assert line == ["[event 0] user1: How do I reset?", f"[event 1] user2: {'y' * 60}", "[event 2] user1: ok"]
    liked = members.where("thread = 0").withColumn("reactions", F.when(F.col("index") == 1, F.create_map(F.lit("up"), F.lit(2))))
    assert "[reactions: {'up': 2}]" in threads.render_threads(liked).first().rendered


def test_candidates(spark):
    members = threads.build_threads(events(spark, [(0, 0, "a", "q?", None, None), (1, 60 * 24 * 300, "b", "an answer", None, 0)]))
    rows = [(0, True, True, True, 0.7, "Q", "A", 99, "r"), (0, True, True, True, 0.69, "Q", "A", 0, "r"), (0, True, False, True, 0.9, "Q", "A", 0, "r")]
    pairs = spark.createDataFrame(rows, "thread long, is_qa boolean, self_contained boolean, is_product_question boolean, confidence double, question string, answer string, answer_event_index long, reason string")
    kept = threads.keep_extractions(pairs)
    assert kept.count() == 1
    at = F.timestamp_millis(F.lit(60 * 24 * 580 * MIN))
    c = threads.to_candidates(kept, members, at, "https://chat.example/%s").first()
    assert (c.id, c.status, c.text, c.url, c.meta.stale, c.meta.thread_size, c.provenance.answer_event_index) == ("help:0", "pending", "Q\n\nA", "https://chat.example/1001", True, 2, 1)
