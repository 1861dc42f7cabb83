"""Command line: python -m quarry <command> ...

Corpora are folders of JSON lines.  --embedder and --drafter name a plugin factory as module:function;
without them deterministic stand-ins are used (hashed tokens; the first retrieved chunk quoted).  --kept names a folder that keeps
vectors, drafts and grades by model, so that nothing is asked twice between runs.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from datetime import UTC, datetime

from pyspark.sql import functions as F

from .operators import answers as answering
from .operators import chunks as chunking
from .operators import metrics, review, threads, validate
from .operators.results import vector_store
from .plans import ask as asking
from .plans.search import STRATEGIES, searcher
from .session import build_session
from .sources import readers, writers


def load(name: str | None):
    if not name:
        return None
    module, _, attr = name.partition(":")
    return getattr(importlib.import_module(module), attr)


def kept(spark, args, kind: str) -> dict:
    """Where results of the plugin ``kind`` are kept, and whose they are."""
    return {"ledger": args.kept, "model": f"{kind} {getattr(args, kind) or 'stand-in'}"}


def search_of(spark, args):
    store = vector_store(spark, args.kept, f"embedder {args.embedder or 'stand-in'}") if args.kept else None
    return searcher(args.strategy, load(args.embedder), store)


def quoting_drafter():
    """Answers with the first chunk of the prompt and cites it; refuses without one."""

    def draft(prompt: str):
        head, _, rest = prompt.partition(">\n")
        if 'id="' not in head:
            return ("refuse", "", [], 0.0)
        return ("answer", rest.partition("\n</chunk>")[0], [head.split('id="')[1].split('"')[0]], 0.5)

    return draft


def silent_grader():
    return lambda text: None


def corpus_of(spark, args):
    rows = readers.indexable(readers.read_located_jsonl(spark, args.corpus, readers.CHUNK))
    validate.require_none(validate.duplicate_places(rows), "duplicate chunk ids")
    chunks = rows.drop("file", "line")
    validate.require_none(validate.chunk_violations(chunks), "invalid chunks")
    return chunks


def show(rows) -> None:
    for r in rows:
        print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))


def now() -> str:
    return datetime.now(UTC).isoformat()


def ask(spark, args) -> int:
    chunks = corpus_of(spark, args)
    questions = spark.createDataFrame(list(enumerate(args.question)), "question_id long, question string")
    bad = validate.request_errors(questions.withColumns({"strategy": F.lit(args.strategy), "max_chunks": F.lit(args.max_chunks)}), ["stuffed", *STRATEGIES]).where("error is not null")
    validate.require_none(bad.select("question_id", "error"), "invalid requests")
    drafter = load(args.drafter) or quoting_drafter
    if args.strategy == "stuffed":
        out = asking.ask_stuffed(questions, chunks, drafter, **kept(spark, args, "drafter"))
    else:
        out = asking.ask(questions, chunks, drafter, args.strategy, args.max_chunks, search_of(spark, args), **kept(spark, args, "drafter"))
    rows = out.orderBy("question_id").collect()
    if args.json:
        show(rows)
        return 0
    given = spark.createDataFrame([(r.question_id, r.citations) for r in rows], "question_id long, citations array<string>")
    sources: dict = {r.question_id: [] for r in rows}
    for s in answering.resolve_citations(given, chunks).orderBy("question_id", "place").collect():
        sources[s.question_id].append(s)
    for r in rows:
        print(r.text)
        if sources[r.question_id]:
            print("Sources:")
        elif not r.refused:
            print("Sources: none cited")
        for n, s in enumerate(sources[r.question_id], 1):
            print(f"  [{n}] {s.title}\n      {s.url}  ({', '.join(filter(None, (s.source_type, (s.published or '')[:10])))})")
        if args.show_retrieved:
            print("Retrieved:")
            for c in r.retrieved:
                print(f"  {'*' if c in r.citations else ' '} {c}")
        print(f"[{r.strategy}, {'refused' if r.refused else f'confidence {r.confidence:.2f}'}, {r.answer_ms} ms]")
    return 0


def serve(spark, args) -> int:
    from .service import Service

    store = vector_store(spark, args.kept, f"embedder {args.embedder or 'stand-in'}") if args.kept else None
    server = Service(corpus_of(spark, args), load(args.drafter) or quoting_drafter, load(args.embedder), args.log, store).server(args.host, args.port)
    print(f"http://{args.host}:{server.server_port}", flush=True)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        pass
    server.server_close()
    return 0


def cases_of(spark, args, chunks):
    cases = readers.read_cases(spark, args.cases)
    validate.require_none(validate.duplicate_ids(cases), "duplicate case ids")
    validate.require_none(validate.unresolved_expected(cases, chunks), "unresolved expected chunks")
    return cases


def eval_retrieval(spark, args) -> int:
    chunks = corpus_of(spark, args)
    cases = cases_of(spark, args, chunks).select(F.col("id").alias("case_id"), "category", "question", F.col("expected_chunk_ids").alias("expected"))
    scored = cases.where(F.size("expected") > 0)
    ranking = search_of(spark, args)(scored.select(F.col("case_id").alias("question_id"), "question"), chunks, 10)
    report = metrics.run_retrieval_eval(scored, ranking, chunks)
    show(report["by_category"].orderBy("category").collect())
    show(report["by_source_type"].orderBy("source_type").collect())
    show(metrics.worst_cases(report["per_case"]).select("case_id", "rr", "retrieved").collect())
    if args.out:
        writers.write_report(report, args.out)
    return 0


def eval_answers(spark, args) -> int:
    chunks = corpus_of(spark, args)
    if args.poison:
        chunks = chunks.unionByName(readers.read_jsonl(spark, args.poison, readers.CHUNK))
    cases = asking.select_cases(cases_of(spark, args, chunks), args.category, args.limit)
    questions = cases.select(F.col("id").alias("question_id"), "question")
    drafter = load(args.drafter) or quoting_drafter
    if args.endpoint:
        given = asking.ask_endpoint(questions, args.endpoint, args.strategy, args.max_chunks)
    elif args.strategy == "refuse":
        given = answering.refusals(questions)
    elif args.strategy == "stuffed":
        given = asking.ask_stuffed(questions, chunks, drafter, **kept(spark, args, "drafter"))
    else:
        given = asking.ask(questions, chunks, drafter, args.strategy, args.max_chunks, search_of(spark, args), **kept(spark, args, "drafter"))
    report = asking.evaluate_answers(cases, given, chunks, load(args.grader) or silent_grader, **kept(spark, args, "grader"))
    rows = report["by_category"].orderBy("category").collect()
    show(rows)
    if "run" in report:
        show(report["run"].collect())
    if args.out:
        writers.write_report(report, args.out)
    return int(any(r.citation_failures for r in rows))


def review_candidates(spark, args) -> int:
    candidates = readers.read_jsonl(spark, args.candidates, readers.CHUNK)
    yes, no = readers.read_decisions(spark, args.approved, args.rejected)
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id string")
    if args.approve or args.reject:
        at = now()
        accepted, refused = review.decide(candidates, ids(args.approve), ids(args.reject), F.lit(at))
        writers.write_chunks(accepted, args.out, append=True)
        writers.append_rejections(refused, args.out_rejected, at)
        yes, no = yes.unionByName(ids(args.approve)), no.unionByName(ids(args.reject))
    if args.interactive:
        chosen: dict[str, list[str]] = {"a": [], "r": []}
        for r in review.pending(candidates, yes, no).select("id", "title", "text").orderBy("id").toLocalIterator():
            print(f"{r.id}: {r.title}\n{r.text}\n")
            key = ""
            while key not in ("a", "r", "s", "q"):
                key = input("[a]pprove, [r]eject, [s]kip, [q]uit: ").strip().lower()
            if key == "q":
                break
            chosen.setdefault(key, []).append(r.id)
        at = now()
        accepted, refused = review.decide(candidates, ids(chosen["a"]), ids(chosen["r"]), F.lit(at))
        if chosen["a"]:
            writers.write_chunks(accepted, args.out, append=True)
        if chosen["r"]:
            writers.append_rejections(refused, args.out_rejected, at)
        yes, no = yes.unionByName(ids(chosen["a"])), no.unionByName(ids(chosen["r"]))
    show(review.pending(candidates, yes, no).select("id", "title", "text").orderBy("id").collect())
    show(review.tally(candidates, yes, no).collect())
    return 0


def add_answer(spark, args) -> int:
    entry = spark.createDataFrame([(args.id, args.question, args.answer, args.url, args.author, now())], "id string, question string, answer string, url string, author string, added_at string")
    new = review.manual_chunks(entry)
    old = readers.read_jsonl(spark, args.existing, readers.CHUNK) if args.existing else None
    if old is not None and not args.force:
        validate.require_none(review.id_clashes(new, old).select("id"), "id exists (--force replaces it)")
    show(new.collect())
    if old is None:
        writers.write_chunks(new, args.out)
    else:
        keep = old.join(new.select("id"), "id", "left_anti").select("id", "source_type", "title", "text", "url", "content_hash", F.to_json("meta").alias("meta"))
        writers.write_chunks(keep.unionByName(new.withColumn("meta", F.to_json("meta")).select(keep.columns)), args.out)
    return 0


def ingest(spark, args) -> int:
    whole = lambda p: spark.read.text(p, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("source"))
    if args.kind == "faq":
        strings = spark.read.text(args.strings, wholetext=True).select(F.explode(F.from_json("value", "faq map<string,string>")["faq"]).alias("name", "value"))
        out = chunking.faq_chunks(readers.faq_pairs(readers.question_keys(spark.read.text(args.source, wholetext=True)), strings), args.base_url)
    elif args.kind == "blog":
        registry = spark.read.text(args.registry, wholetext=True)
        posts = readers.article_registry(registry)
        for r in readers.missing_components(registry).collect():
            print(f"{r.slug}: no import of {r.component}", file=sys.stderr)
        pages = whole(args.source).withColumn("file", F.regexp_extract("path", r"([^/]+)\.\w+$", 1)).join(posts.select("file", "slug"), "file")
        out = chunking.article_chunks(posts, chunking.article_sections(pages.select("slug", "source"), base_url=args.site), args.base_url)
        out = chunking.by_date(out, posts)
    elif args.kind == "guidelines":
        out = chunking.guideline_chunks(chunking.card_sections(whole(args.source), base_url=args.site), args.base_url)
    elif args.kind == "terms":
        out = chunking.terms_chunks(chunking.clause_sections(whole(args.source), base_url=args.site), args.base_url)
    else:
        members = threads.build_threads(readers.read_events(spark, args.source))
        picked = threads.shortlist(members)
        out = threads.render_threads(members.join(picked.select("thread"), "thread", "left_semi"))
        if args.extractor:
            kind = "is_qa boolean, question string, answer string, answer_event_index long, self_contained boolean, is_product_question boolean, confidence double, reason string"
            pairs = asking.called(out, "rendered", kind, load(args.extractor), **kept(spark, args, "extractor")).where("result is not null").select("thread", "result.*")
            out = threads.to_candidates(threads.keep_extractions(pairs), members, F.current_timestamp(), args.base_url + "/%s")
    if args.repo:
        state = readers.repository_state(args.repo)
        out = out.withColumn("provenance", F.struct(*(F.lit(v).cast("string").alias(k) for k, v in state.items())))
    n = out.count()
    if not n:
        print("nothing parsed: the source has probably changed", file=sys.stderr)
        return 1
    writers.write_chunks(out, args.out)
    text = "rendered" if "rendered" in out.columns else "text"
    show(chunking.size_stats(out.withColumn("kind", F.lit(args.kind)), "kind", text).collect())
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *options):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flags, kw in options:
            c.add_argument(*flags.split(), **kw)

    corpus = ("--corpus", {"required": True})
    strategy = ("--strategy", {"default": "bm25"})
    plugs = [("--embedder", {}), ("--drafter", {}), ("--kept", {})]
    command("ask", ask, ("question", {"nargs": "+"}), corpus, strategy, ("--max-chunks", {"type": int, "default": 5}), ("--json", {"action": "store_true"}), ("--show-retrieved", {"action": "store_true"}), *plugs)
    cases = ("--cases", {"required": True})
    command("eval-retrieval", eval_retrieval, corpus, cases, strategy, ("--out", {}), *plugs)
    command(
        "eval-answers", eval_answers, corpus, cases, strategy, ("--poison", {}), ("--limit", {"type": int}), ("--category", {"action": "append"}), ("--max-chunks", {"type": int, "default": 5}),
        ("--grader", {}), ("--endpoint", {}), ("--out", {}), *plugs,
    )
    many = {"nargs": "*", "default": []}
    command("review-candidates", review_candidates, ("--candidates", {"required": True}), ("--approved", {}), ("--rejected", {}), ("--approve", many), ("--reject", many), ("--interactive", {"action": "store_true"}), ("--out", {}), ("--out-rejected", {}))
    command("serve", serve, corpus, ("--host", {"default": "127.0.0.1"}), ("--port", {"type": int, "default": 8000}), ("--log", {}), *plugs)
    command("add-answer", add_answer, ("-q --question", {"required": True}), ("-a --answer", {"required": True}), ("-u --url", {"required": True}), ("--id", {}), ("--author", {}), ("--existing", {}), ("--out", {"required": True}), ("--force", {"action": "store_true"}))
    command(
        "ingest", ingest, ("kind", {"choices": ["faq", "blog", "guidelines", "terms", "help"]}), ("--source", {"required": True}), ("--strings", {}), ("--registry", {}), ("--base-url", {"default": ""}),
        ("--site", {"default": ""}), ("--extractor", {}), ("--kept", {}), ("--repo", {}), ("--out", {"required": True}),
    )
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    return args.run(spark or build_session(), args)
