import random
import re
from collections import Counter, defaultdict

from texts import sentences

from quarry.llm.spans import PASSAGE_WORDS, QUERY_WORDS, SENTENCES, dedup_spans, op4_sentence_spans, remove_spans, repeated_spans


def brute(rows, least=1):
    """Removed word indexes per place in rows (id, text): every non-first occurrence of a span."""
    spans = defaultdict(list)
    for r, (i, t) in enumerate(rows):
        words, starts = [], []
        for line in (t or "").lower().split("\n"):
            new = True
            for w in re.findall(r"[^\x20\x09-\x0D]+", line):
                if new or not words:
                    starts.append(len(words))
                words.append(w)
                new = w[-1] in ".!?"
        ends = [*starts[1:], len(words)]
        found = set()
        for s in range(len(starts)):
            ahead = [e for e in range(s + SENTENCES - 1, len(starts)) if ends[e] - starts[s] >= least]
            behind = [e for e in range(s - SENTENCES + 1, -1, -1) if ends[s] - starts[e] >= least]
            found |= {(s, ahead[0])} if ahead else set()
            found |= {(behind[0], s)} if behind else set()
        for s, e in found:
            spans[tuple(words[starts[s] : ends[e]])].append((i is None, i or 0, r, starts[s], ends[e]))
    gone = defaultdict(set)
    for where in spans.values():
        for _, _, r, a, b in sorted(where)[1:]:
            gone[r] |= set(range(a, b))
    return gone


def found(df):
    gone = defaultdict(set)
    for r in df.collect():
        gone[r.doc_id] |= set(range(r.start, r.start + r.n_words))
    return gone


def test_matches_brute_force(docs, corpus):
    for least in (1, 14, 24):
        expected = brute(corpus, least)
        assert found(repeated_spans(docs, min_words=least)) == expected
        assert len(expected) > 10


def test_short_runs_count(spark):
    run = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen."
    rows = [(d, f"{sentences(random.Random(d), 3)} {run} {sentences(random.Random(50 + d), 3)}") for d in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, QUERY_WORDS):
        got = found(repeated_spans(df, min_words=least))
        assert set(got) == {1, 2} and all(len(v) == 14 for v in got.values())
    short = spark.createDataFrame([(1, "A b. C."), (2, "A b. C.")], "doc_id long, text string")
    assert found(repeated_spans(short)) == {2: {0, 1, 2}}


def test_repeated_rows_null_and_equal_ids_match_brute_force(spark):
    rng = random.Random(3)
    parts = [sentences(rng, 3) for _ in range(6)]
    rows = [(rng.choice([1, 1, 2, 7, None]), " ".join(rng.sample(parts, rng.randint(0, 4))) or None) for _ in range(40)] + [(None, None), (1, "")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").coalesce(1)
    expected = brute(rows)
    for out in (remove_spans(df, repeated_spans(df)), dedup_spans(df)):
        got = {r.n: r for r in out.collect()}
        assert len(got) == len(rows)
        for n, (i, t) in enumerate(rows):
            words = (t or "").split()
            assert got[n].doc_id == i and got[n].kept_text.split() == [w for k, w in enumerate(words) if k not in expected.get(n, ())]


def test_the_first_of_equal_rows_stays(spark):
    text = sentences(random.Random(4), 6)
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert sorted(r.kept_text for r in remove_spans(df, repeated_spans(df)).collect()) == ["", text]
    other = sentences(random.Random(5), 6)
    rows = [(1, text), (1, other), (None, f"{other} {text}"), (None, "nothing else here.")]
    got = Counter(r.kept_text.strip() for r in dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([text, other, "", "nothing else here."])


def test_removal_keeps_the_rest(docs, corpus):
    expected = brute(corpus)
    texts = dict(corpus)
    for r in remove_spans(docs, repeated_spans(docs)).collect():
        words = (texts[r.doc_id] or "").encode().split()
        assert r.kept_text.encode().split() == [w for k, w in enumerate(words) if k not in expected.get(r.doc_id, ())]
        if r.doc_id not in expected:
            assert r.kept_text == (texts[r.doc_id] or "")


def test_repeats_nulls_empty_and_clashes(spark, empty_docs):
    assert repeated_spans(empty_docs).count() == 0
    text = "This is a first sentence of words that has a few more. And this is a second sentence of words that has some more, too."
    df = spark.createDataFrame([(1, text, 1), (2, text, 2), (2, text, 3), (None, text, 4), (3, None, 5)], "doc_id long, text string, start int")
    got = sorted((str(r.doc_id), r.first_doc_id) for r in repeated_spans(df).collect())
    assert {g[0] for g in got} == {"2", "None"} and {g[1] for g in got} <= {1, 2}
    kept = remove_spans(df, repeated_spans(df)).collect()
    assert sorted((str(r.doc_id), r.kept_text, r.start) for r in kept) == [("1", text, 1), ("2", "", 2), ("2", "", 3), ("3", "", 5), ("None", "", 4)]


def test_passages_are_covered_wherever_they_stand(spark):
    rng = random.Random(21)
    flat = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))  # no sentence ends
    for passage in (sentences(rng, 7), flat):
        rows = [(d, f"{sentences(rng, 5)} lead{d} in words {passage} {'tail' * (d % 2)} {sentences(rng, 5)}") for d in range(6)]
        rows += [(100 + d, f"{sentences(rng, 1)}\n{sentences(rng, 4)}") for d in range(6)]
        got = found(repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), passage_words=PASSAGE_WORDS))
        assert set(got) == {1, 2, 3, 4, 5}
        n = len(passage.split())
        assert all(len(v) >= n - 14 for v in got.values())


def test_query_covers_unaligned_and_unpunctuated_passages_whole(spark, tmp_path):
    rng = random.Random(5)
    rows, where = [], {}
    for p in range(40):
        size = 51 + p % 12
        text = sentences(rng, 30).split() if p % 2 else [f"w{rng.randrange(10**6)}" for _ in range(90)]
        at = rng.randrange(len(text) - size)
        passage = text[at : at + size]
        for copy in range(2):
            body = [f"v{rng.randrange(10**9)}" for _ in range(rng.randint(0, 80))]
            cut = rng.randint(0, len(body))
            rows.append((2 * p + copy, " ".join([*body[:cut], *passage, *body[cut:]])))
            where[2 * p + copy] = set(range(cut, cut + size))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = found(op4_sentence_spans(spark, str(tmp_path)))
    assert got == {d: w for d, w in where.items() if d % 2}


def test_windows_match_brute_force(docs, corpus):
    expected, seen = brute(corpus), set()
    assert [i for i, _ in corpus] == list(range(len(corpus)))
    for i, t in corpus:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        for a in range(len(words) - PASSAGE_WORDS + 1):
            w = tuple(words[a : a + PASSAGE_WORDS])
            if w in seen:
                expected[i] |= set(range(a, a + PASSAGE_WORDS))
            seen.add(w)
    assert found(repeated_spans(docs, passage_words=PASSAGE_WORDS)) == expected
