import json

import pytest

from quarry.cli import main
from quarry.operators.validate import ValidationError


def write(path, rows):
    path.write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    texts = {"faq:a": "reset the wallet here", "faq:b": "upload a video", "faq:c": "how to vote"}
    rows = [{"id": i, "source_type": "faq", "title": "t", "text": t, "url": "https://x", "meta": {}, "provenance": {}, "content_hash": "h"} for i, t in texts.items()]
    write(d / "faq.jsonl", rows)
    return str(d)


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.strip().split("\n") if x.startswith("{")]


@pytest.mark.parametrize("strategy", ["stub", "bm25", "dense", "hybrid", "stuffed"])
def test_ask(spark, corpus, capsys, strategy):
    assert main(["ask", "reset wallet", "--corpus", corpus, "--strategy", strategy, "--json"], spark) == 0
    r = lines(capsys)[0]
    assert r["citations"] == ["faq:a"] and r["text"] == "reset the wallet here"


def test_ask_prints_and_validates(spark, corpus, capsys):
    main(["ask", "vote", "--corpus", corpus, "--show-retrieved", "--max-chunks", "2"], spark)
    out = capsys.readouterr().out.strip().split("\n")
    assert out[:-1] == ["how to vote", "Sources:", "  [1] t", "      https://x  (faq)", "Retrieved:", "  * faq:c", "    faq:a"] and out[-1].startswith("[bm25, confidence 0.50, ")
    with pytest.raises(ValidationError):
        main(["ask", "x" * 2001, "--corpus", corpus], spark)


def test_evaluations(spark, corpus, tmp_path, capsys):
    rows = [
        {"id": "g001", "category": "answerable", "question": "wallet", "expected_chunk_ids": ["faq:a"], "must_mention": ["wallet"], "must_not_mention": [], "notes": ""},
        {"id": "g002", "category": "refusal", "question": "vote", "expected_chunk_ids": [], "must_mention": [], "must_not_mention": ["vote"], "notes": ""},
    ]
    cases = write(tmp_path / "g.jsonl", rows)
    assert main(["eval-retrieval", "--corpus", corpus, "--cases", cases, "--out", str(tmp_path / "r")], spark) == 0
    out = lines(capsys)
    assert out[0]["category"] is None and out[0]["cases"] == 1 and out[0]["mrr"] == 1.0
    assert main(["eval-answers", "--corpus", corpus, "--cases", cases], spark) == 0
    total, *_, run = lines(capsys)
    assert (run["cases"], run["parse_failures"], run["dropped_citations"]) == (2, 0, 0) and run["max_ms"] >= run["mean_ms"] >= 0
    assert main(["eval-answers", "--corpus", corpus, "--cases", cases, "--strategy", "stuffed"], spark) == 0
    assert lines(capsys)[0]["cases"] == 2
    assert (total["cases"], total["must_mention_failures"], total["must_not_mention_failures"], total["grading_failures"]) == (2, 0, 1, 2)
    assert main(["eval-answers", "--corpus", corpus, "--cases", cases, "--strategy", "refuse", "--category", "answerable", "--limit", "1"], spark) == 0


def test_review_and_manual(spark, tmp_path, capsys):
    base = {"source_type": "help_channel", "title": "t", "text": "x", "url": "u", "meta": {}, "provenance": {}, "content_hash": "h", "status": "pending"}
    cand = write(tmp_path / "c.jsonl", [{"id": f"help:{i}", **base} for i in range(3)])
    out, rej = str(tmp_path / "out"), str(tmp_path / "rej")
    assert main(["review-candidates", "--candidates", cand, "--approve", "help:0", "--reject", "help:1", "--out", out, "--out-rejected", rej], spark) == 0
    assert lines(capsys)[-1] == {"approved": 1, "rejected": 1, "undecided": 1}
    main(["review-candidates", "--candidates", cand, "--approved", out, "--rejected", rej], spark)
    assert [r["id"] for r in lines(capsys)[:-1]] == ["help:2"]
    first, second = str(tmp_path / "m1"), str(tmp_path / "m2")
    main(["add-answer", "-q", "How?", "-a", "So.", "-u", "https://u", "--out", first], spark)
    with pytest.raises(ValidationError):
        main(["add-answer", "-q", "How?", "-a", "Now so.", "-u", "https://u", "--existing", first, "--out", second], spark)
    main(["add-answer", "-q", "How?", "-a", "Now so.", "-u", "https://u", "--existing", first, "--out", second, "--force"], spark)
    assert [r.text for r in spark.read.json(second).collect()] == ["How?\n\nNow so."]


def test_ingest(spark, tmp_path, capsys):
    (tmp_path / "q.ts").write_text('allQuestions = ["a"]')
    (tmp_path / "en.json").write_text(json.dumps({"faq": {"a_q": "Q?", "a_a": "A."}}))
    assert main(["ingest", "faq", "--source", str(tmp_path / "q.ts"), "--strings", str(tmp_path / "en.json"), "--base-url", "https://f", "--out", str(tmp_path / "o1")], spark) == 0
    assert spark.read.json(str(tmp_path / "o1")).first().id == "faq:a"
    (tmp_path / "posts.ts").write_text('import P from "./First.svelte"\n{ slug: "s", title: "T", author: "x", date: new Date(2024, 0, 5), component: P, }')
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "First.svelte").write_text("<section><h2>H</h2><p>Body</p></section>")
    assert main(["ingest", "blog", "--source", str(tmp_path / "pages"), "--registry", str(tmp_path / "posts.ts"), "--base-url", "https://b", "--out", str(tmp_path / "o2")], spark) == 0
    assert spark.read.json(str(tmp_path / "o2")).first().text == "T > H\n\nBody"
    (tmp_path / "none.html").write_text("<p>nothing</p>")
    assert main(["ingest", "guidelines", "--source", str(tmp_path / "none.html"), "--out", str(tmp_path / "o3")], spark) == 1
    events = [{"index": 0, "timestamp": 0, "senderId": "a", "text": "How do I?"}, {"index": 1, "timestamp": 1, "senderId": "b", "text": "y" * 70, "repliesToEventIndex": 0}]
    (tmp_path / "ev.json").write_text(json.dumps(events))
    assert main(["ingest", "help", "--source", str(tmp_path / "ev.json"), "--out", str(tmp_path / "o4")], spark) == 0
    assert "user1: How do I?" in spark.read.json(str(tmp_path / "o4")).first().rendered


def test_duplicates_are_named_with_their_place(spark, tmp_path):
    row = {"id": "faq:a", "source_type": "faq", "title": "t", "text": "x", "url": "u", "meta": {}, "provenance": {}, "content_hash": "h"}
    (tmp_path / "a.jsonl").write_text(json.dumps(row) + "\n\n" + json.dumps(row | {"id": "faq:b"}))
    (tmp_path / "b.jsonl").write_text("\n" + json.dumps(row))
    with pytest.raises(ValidationError, match=r"faq:a.*b\.jsonl.*'line': 2"):
        main(["ask", "x", "--corpus", str(tmp_path)], spark)


def test_interactive_review(spark, tmp_path, capsys, monkeypatch):
    base = {"source_type": "help_channel", "title": "t", "text": "x", "url": "u", "meta": {}, "provenance": {}, "content_hash": "h", "status": "pending"}
    cand = write(tmp_path / "c.jsonl", [{"id": f"help:{i}", **base} for i in range(4)])
    keys = iter(["?", "a", "r", "s", "q"])
    monkeypatch.setattr("builtins.input", lambda prompt: next(keys))
    out, rej = str(tmp_path / "out"), str(tmp_path / "rej")
    assert main(["review-candidates", "--candidates", cand, "--interactive", "--out", out, "--out-rejected", rej], spark) == 0
    assert lines(capsys)[-1] == {"approved": 1, "rejected": 1, "undecided": 2}
    assert [r.id for r in spark.read.json(out).collect()] == ["help:0"]


@pytest.fixture(scope="module")
def service(spark, corpus, tmp_path_factory):
    from threading import Thread

    from quarry.cli import quoting_drafter
    from quarry.service import Service
    from quarry.sources.readers import read_corpus

    log = str(tmp_path_factory.mktemp("log"))
    server = Service(read_corpus(spark, corpus), quoting_drafter, log=log).server(port=0)
    Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", log
    server.shutdown()


def post(url, body):
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode())) as r:
            return r.status, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, json.load(e)


def test_service(spark, service):
    import urllib.request

    url, log = service
    health = json.load(urllib.request.urlopen(url + "/health"))
    assert health["status"] == "ok" and health["corpus_chunks"] == 3 and "bm25" in health["strategies"]
    status, body = post(url + "/ask", {"question": "reset wallet", "max_chunks": 2})
    assert status == 200 and body["answer"] == "reset the wallet here" and not body["refused"]
    assert body["citations"] == [{"chunk_id": "faq:a", "url": "https://x", "title": "t", "source_type": "faq", "published": None}]
    assert post(url + "/ask", {"question": ""})[0] == 422 and post(url + "/ask", {"question": "x", "strategy": "magic"})[0] == 422
    assert post(url + "/ask", {"question": "x", "max_chunks": 21})[0] == 422 and post(url + "/nothing", {})[0] == 404
    from quarry.sources.readers import read_request_log

    rows = read_request_log(spark, log).collect()
    assert [(r.question, r.cited, r.unresolved_citations) for r in rows] == [("reset wallet", ["faq:a"], [])]


@pytest.fixture(scope="module")
def endpoint():
    """Another application's service: one that shares this test's cores could not answer its own tasks."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from threading import Thread

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = {"answer": "reset the wallet here", "citations": [{"chunk_id": "faq:a"}], "refused": False, "confidence": 0.5}
            data = json.dumps(body).encode()
            self.send_response(200 if asked["strategy"] == "bm25" and asked["max_chunks"] == 5 else 422)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_answers_of_an_endpoint(spark, endpoint, corpus, tmp_path, capsys):
    rows = [{"id": "g001", "category": "answerable", "question": "wallet", "expected_chunk_ids": ["faq:a"], "must_mention": ["wallet"], "must_not_mention": [], "notes": ""}]
    cases = write(tmp_path / "g.jsonl", rows)
    assert main(["eval-answers", "--corpus", corpus, "--cases", cases, "--endpoint", endpoint], spark) == 0
    total, *_, run = lines(capsys)
    assert total["cases"] == 1 and total["must_mention_failures"] == 0 and run["tokens_in"] == 0
    with pytest.raises(Exception, match="422"):
        main(["eval-answers", "--corpus", corpus, "--cases", cases, "--endpoint", endpoint, "--strategy", "magic"], spark)
