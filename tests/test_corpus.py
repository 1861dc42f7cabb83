import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunks, review, validate
from quarry.sources import readers, writers


def chunk(i, source="faq", status=None, text="body"):
    return {"id": i, "source_type": source, "title": "t", "text": text, "url": "https://x", "meta": {"published": "2024-01-01"}, "provenance": {}, "content_hash": "h", "status": status}


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


def test_corpus_is_gated_and_ordered(spark, tmp_path):
    d = tmp_path / "corpus"
    d.mkdir()
    write(d / "b.jsonl", [chunk("b1"), "", chunk("h1", "help_channel", "approved"), chunk("h2", "help_channel", "pending"), chunk("h3", "help_channel")])
    write(d / "a.jsonl", [chunk("a1"), chunk("m1", "manual", "pending")])
    got = readers.read_corpus(spark, str(d))
    assert sorted(r.id for r in got.collect()) == ["a1", "b1", "h1", "m1"]
    from quarry.sources.schemas import CHUNK

    ordered = readers.read_ordered_jsonl(spark, str(d), CHUNK).orderBy("corpus_ord")
    assert [r.id for r in ordered.collect()] == ["a1", "m1", "b1", "h1", "h2", "h3"]
    assert got.select(F.try_variant_get("meta", "$.published", "string").alias("p")).first().p == "2024-01-01"


def test_bad_lines(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", [chunk("a"), "{broken"])
    from quarry.sources.schemas import CHUNK

    loose = readers.read_jsonl(spark, path, CHUNK, strict=False).cache()
    assert loose.where("_corrupt is not null").count() == 1
    with pytest.raises(Exception):  # noqa: B017
        readers.read_jsonl(spark, path, CHUNK).collect()


def test_cases_and_references(spark, tmp_path):
    rows = [
        {"id": "g001", "category": "answerable", "question": "q", "expected_chunk_ids": ["a", ["b", "c"]], "must_mention": [], "must_not_mention": [], "notes": ""},
        {"id": "x1", "category": "odd", "question": "", "expected_chunk_ids": [], "must_mention": [], "must_not_mention": [], "notes": ""},
    ]
    cases = readers.read_cases(spark, write(tmp_path / "g.jsonl", rows))
    assert cases.where("id = 'g001'").first().expected_chunk_ids == [["a"], ["b", "c"]]
    known = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [(r.case_id, r.chunk_id) for r in validate.unresolved_expected(cases, known).collect()] == [("g001", "c")]
    assert sorted(r.problem for r in validate.case_violations(cases).where("id = 'x1'").collect()) == ["category", "id", "question"]
    short = {r.category: r.cases for r in validate.category_shortfalls(cases).collect()}
    assert short == {"answerable": 1, "refusal": 0, "ambiguous": 0, "injection": 0, "all": 2}


def test_duplicates_are_an_error(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    assert [r.id for r in validate.duplicate_ids(df).collect()] == ["a"]
    with pytest.raises(validate.ValidationError, match="a"):
        validate.require_none(validate.duplicate_ids(df), "duplicate ids")
    validate.require_none(validate.duplicate_ids(df.distinct()), "duplicate ids")


def test_request_errors(spark):
    rows = [("q", "bm25", 5), ("", "bm25", 5), ("q" * 2001, "bm25", 5), ("q", "bm25", 0), ("q", "bm25", 21), ("q", "no", 5), (None, "bm25", 5)]
    df = spark.createDataFrame(rows, "question string, strategy string, max_chunks int")
    assert [r.error for r in validate.request_errors(df, ["bm25"]).collect()] == [None, "question", "question", "max_chunks", "max_chunks", "strategy", "question"]


def test_review_round_trip(spark, tmp_path):
    cand = spark.createDataFrame([("h1", "pending"), ("h2", "pending"), ("h3", "pending")], "id string, status string")
    pick = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    yes, no = review.decide(cand, pick("h1"), pick("h2"), F.lit("2024-01-01"))
    assert [(r.id, r.status, r.reviewed_at) for r in yes.collect()] == [("h1", "approved", "2024-01-01")]
    assert [r.id for r in review.pending(cand, yes, no).collect()] == ["h3"]
    assert review.tally(cand, yes, no).first().asDict() == {"approved": 1, "rejected": 1, "undecided": 1}
    for a, b in ((("h1",), ("h1",)), (("zz",), ())):
        with pytest.raises(validate.ValidationError):
            review.decide(cand, pick(*a), pick(*b), F.lit("x"))
    writers.append_rejections(no, str(tmp_path / "rej"), "2024-01-01T00:00:00Z")
    writers.append_rejections(pick("h9"), str(tmp_path / "rej"), "2024-01-02T00:00:00Z")
    yes_ids, no_ids = readers.read_decisions(spark, None, str(tmp_path / "rej"))
    assert yes_ids.count() == 0 and sorted(r.id for r in no_ids.collect()) == ["h2", "h9"]


def test_manual_entries_replace(spark):
    e = spark.createDataFrame([("How to export?", "Click.", "https://u", None, "2024-01-01")], "question string, answer string, url string, author string, added_at string")
    c = review.manual_chunks(e)
    r = c.first()
    assert (r.id, r.text, r.source_type) == ("manual:how_to_export", "How to export?\n\nClick.", "manual") and len(r.content_hash) == 16
    old = c.withColumn("text", F.lit("old"))
    assert review.id_clashes(c, old).count() == 1
    assert [x.text for x in review.replace_latest(old, c).collect()] == [r.text]


def test_faq_sources(spark):
    src = spark.createDataFrame([('const allQuestions = [\n "b",\n "a", "gone"\n];',)], "value string")
    keys = readers.question_keys(src)
    assert [(r.position, r.key) for r in keys.orderBy("position").collect()] == [(0, "b"), (1, "a"), (2, "gone")]
    strings = spark.createDataFrame([("a_q", "Q <b>a</b>?"), ("a_a", 'See <a href="https://e.x">it</a>.'), ("b_q", "Qb"), ("b_a", ""), ("gone_q", "x")], "name string, value string")
    out = chunks.faq_chunks(readers.faq_pairs(keys, strings), "https://faq").collect()
    assert [(r.id, r.title, r.text, r.url) for r in out] == [("faq:a", "Q a?", "Q a?\n\nSee [it](https://e.x).", "https://faq?q=a")]
    assert out[0].meta.links[0].url == "https://e.x" and out[0].meta.char_count == len("See [it](https://e.x).")


def test_article_sources(spark):
    registry = """import A from "./First.svelte"
    { slug: "one", title: "The \\"One\\"", author: "x", date: new Date(2024, 1, 31), component: A, },
    { slug: "two", title: "Two", author: "y", date: new Date(2024, 0, 1), component: Missing, },"""
    posts = readers.article_registry(spark.createDataFrame([(registry,)], "value string"))
    r = posts.collect()
    assert len(r) == 1 and (r[0].slug, r[0].title, str(r[0].date), r[0].file) == ("one", 'The "One"', "2024-03-02", "First")
    html = "<section><h2>H</h2><p>" + "Long text here. " * 150 + "</p></section><section><h2>End</h2><p>x</p></section>"
    sections = chunks.article_sections(spark.createDataFrame([("one", html)], "slug string, source string"))
    out = sorted(chunks.article_chunks(posts, sections, "https://blog").collect(), key=lambda c: c.id)
    assert [c.id for c in out] == ["blog:one:0", "blog:one:0.1", "blog:one:1"]
    assert out[0].title == 'The "One" > H' and out[0].text.startswith('The "One" > H\n\nLong text') and out[2].meta.section_index == 1


def test_guideline_and_terms_chunks(spark):
    cards = spark.createDataFrame([("1", "Be kind", "short"), ("2", "Rules", ("p" * 900 + "\n\n") * 2)], "number string, title string, text string")
    assert sorted(c.id for c in chunks.guideline_chunks(cards, "https://g").collect()) == ["guidelines:1", "guidelines:2.0", "guidelines:2.1"]
    clauses = spark.createDataFrame([("0", "Preamble", None, "agree"), ("3", "Use", "Fair Use!", ("c" * 1500 + "\n") * 2)], "section_id string, section_title string, clause_group string, text string")
    out = {c.id: c for c in chunks.terms_chunks(clauses, "https://t").collect()}
    assert set(out) == {"terms:0:intro", "terms:3:fair_use", "terms:3:fair_use.1"}
    assert out["terms:3:fair_use"].title == "Terms of use > Use > Fair Use!" and out["terms:0:intro"].url == "https://t?section=0"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("é", 1)], "id string, n int")
    writers.write_jsonl(df, str(tmp_path / "j"))
    writers.write_jsonl(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    v = spark.createDataFrame([("m", "k", [1.0])], "model string, key string, embedding array<float>")
    writers.append_embeddings(v, str(tmp_path / "e"))
    assert readers.read_embeddings(spark, str(tmp_path / "e"), "m").count() == 1
    writers.write_report({"overall": df}, str(tmp_path / "r"))
    assert (tmp_path / "r" / "overall").exists()


def test_event_exports(spark, tmp_path):
    e = {"index": 1, "timestamp": 5, "messageIndex": 2, "senderId": "s", "text": "hello there", "reactions": {"a": 1}}
    (tmp_path / "list.json").write_text(json.dumps([e, {**e, "index": 2, "deleted": True}]))
    (tmp_path / "head.json").write_text(json.dumps({"events": [e]}))
    assert readers.read_events(spark, str(tmp_path / "list.json")).count() == 1
    assert readers.read_event_export(spark, str(tmp_path / "head.json")).first().reactions == {"a": 1}
