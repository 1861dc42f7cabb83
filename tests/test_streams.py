import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry.streaming import streams

T0 = datetime(2024, 1, 1)


def test_gap_sessions(spark, tmp_path):
    minutes = [0, 45, 91, 92]
    rows = [("a", T0 + timedelta(minutes=m)) for m in minutes] + [("z", T0 + timedelta(days=9))]
    spark.createDataFrame(rows, "user string, ts timestamp").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("user string, ts timestamp").parquet(str(tmp_path / "in"))
    out = streams.run_to_table(streams.gap_session_stream(s, "ts", "user"), "sess", str(tmp_path / "ck"))
    got = sorted((r.start, r.messages) for r in out.where("user = 'a'").collect())
    assert got == [(T0, 2), (T0 + timedelta(minutes=91), 2)]


def test_log_windows_and_first_of_id(spark, tmp_path):
    d = tmp_path / "log"
    d.mkdir()
    lines = [{"ts": f"2024-01-01T00:0{i}:00Z", "question": "q", "strategy": "bm25", "refused": i % 2 == 0, "latency_ms": 10 * i} for i in range(4)]
    lines.append({"ts": "2024-01-05T00:00:00Z", "question": "q", "strategy": "bm25", "refused": True, "latency_ms": 1})
    (d / "a.json").write_text("\n".join(map(json.dumps, lines)))
    log = streams.read_log_stream(spark, str(d))
    out = streams.run_to_table(streams.log_windows(log), "logw", str(tmp_path / "ck1")).orderBy("start").first()
    assert (out.requests, out.refusal_rate, out.mean_latency_ms) == (4, 0.5, 15.0)
    once = streams.run_to_table(streams.first_of_id(log, "question", "ts"), "once", str(tmp_path / "ck2"))
    assert once.count() == 1


def test_review_and_embedding_streams(spark, tmp_path):
    spark.createDataFrame([("h1",), ("h2",)], "id string").write.json(str(tmp_path / "cand"))
    seen = []
    q = streams.review_stream(
        spark.readStream.schema("id string").json(str(tmp_path / "cand")),
        lambda: spark.createDataFrame([("h1",)], "id string"),
        lambda df: seen.extend(r.id for r in df.collect()),
        str(tmp_path / "ck"),
    )
    q.awaitTermination()
    assert seen == ["h2"]
    spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k2", "b")], "key string, text string").write.json(str(tmp_path / "items"))
    cache = spark.createDataFrame([("m", "k1", [1.0])], "model string, key string, embedding array<float>")
    embed = lambda df: df.select(F.lit("m").alias("model"), "key", F.array(F.lit(0.5).cast("float")).alias("embedding"))
    q = streams.embedding_stream(spark.readStream.schema("key string, text string").json(str(tmp_path / "items")), lambda: cache, "m", embed, str(tmp_path / "vec"), str(tmp_path / "ck3"))
    q.awaitTermination()
    assert [r.key for r in spark.read.parquet(str(tmp_path / "vec")).collect()] == ["k2"]
