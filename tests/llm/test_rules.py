import random

import duckdb
import numpy as np
from texts import sentences

from quarry.llm.rules import FEATURES, LineField, fit_lines, judge, line_features, quality_rules, repeat_words, repeat_words_of_long, spliced, train_field

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    words, now = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            words += [now] if now else []
            now = ""
        else:
            now += c
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if any(c not in SPACE for c in line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return n, sum(map(len, words)), symbols, dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_measures(corpus):
    texts = [t if t is None or len(t) < 9000 else t[:9000] for _, t in corpus] + ["a b c a b c a b c", "x x x x", "a b c d a b c", "1 2 3 " * 30 + "z " * 70, "l1 w\n\nl1 w\n \n l1 w\nl1 w"]
    for t in texts:
        assert judge(t, LineField())[:6] == brute(t)


def test_repeated_windows_overlap():
    assert repeat_words([b"x"] * 4) == 4
    assert repeat_words([b"x"] * 3) == 0
    assert repeat_words([]) == 0
    rng = random.Random(1)
    for _ in range(100):
        words = [rng.choice(b"abcde").to_bytes() for _ in range(rng.randint(3, 60))]
        assert repeat_words(words) == repeat_words_of_long(words)
    words = [b"%d" % rng.randrange(300) for _ in range(60_000)]
    assert repeat_words(words) == repeat_words_of_long(words) > 0


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(4)
    for _ in range(50):
        field = LineField(rng.normal(size=(FEATURES, 2)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(rng.integers(1, 8), FEATURES))
        best = max(
            (tuple(int(b) for b in np.binary_repr(m, len(x))) for m in range(2 ** len(x))),
            key=lambda s: sum(x[i] @ field.weights[:, s[i]] for i in range(len(s))) + sum(field.transitions[a, b] for a, b in zip(s, s[1:], strict=False)),
        )
        assert tuple(field.decode(x.tolist())) == best


def test_gradient_matches_likelihood():
    """A fit on a tiny sample raises the exact log likelihood that enumeration gives."""
    rng = np.random.default_rng(6)
    seqs = [rng.normal(size=(n, FEATURES)) for n in (2, 3, 4)]
    labels = [np.array([0, 0]), np.array([1, 1, 0]), np.array([0, 1, 0, 0])]

    def likelihood(f):
        total = 0
        for x, y in zip(seqs, labels, strict=True):
            def score(s, x=x):
                return sum(x[i] @ f.weights[:, s[i]] for i in range(len(s))) + sum(f.transitions[a, b] for a, b in zip(s, s[1:], strict=False))
            everything = [score(tuple(int(b) for b in np.binary_repr(m, len(x)))) for m in range(2 ** len(x))]
            total += score(y) - np.logaddexp.reduce(everything)
        return total

    assert likelihood(LineField().fit(seqs, labels, steps=80)) > likelihood(LineField()) + 1


def make(rng, good):
    if good:
        return "\n".join(sentences(rng, 5) for _ in range(3))
    return "\n".join(" ".join(w.upper() + "!!" for w in sentences(rng, 4).split()) for _ in range(3))


def test_held_out_accuracy(spark):
    rng = random.Random(12)
    rows = [(i, make(rng, i % 3 != 0), int(i % 3 != 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    field = train_field(df.select("doc_id", "text"), df.where("doc_id < 120").select("doc_id", "quality"))
    got = {r.doc_id: r.kept for r in quality_rules(df.where("doc_id >= 120"), field).collect()}
    right = sum(got[i] == bool(q) for i, t, q in rows[120:] if len(t.split()) >= 50)
    assert right >= 0.97 * sum(len(t.split()) >= 50 for i, t, q in rows[120:])


def lines_of(rng, good, n):
    return [sentences(rng, 2) if good else " ".join(w.upper() + "!!" for w in sentences(rng, 1).split()) for _ in range(n)]


def test_pages_of_both_kinds_are_labelled_line_by_line():
    rng = random.Random(31)
    docs, bad = [], []
    for i in range(120):  # bad documents hold ordinary lines as well
        lines = lines_of(rng, i % 2, 12) if i % 2 else [*lines_of(rng, 1, rng.randint(0, 3)), *lines_of(rng, 0, 9)]
        docs.append(np.array(line_features([x.encode() for x in lines])[0]))
        bad.append(i % 2 == 0)
    field = fit_lines(docs, bad)
    assert field.transitions[0, 0] > field.transitions[0, 1] and field.transitions[1, 1] > field.transitions[1, 0]
    shares, right, total = [], 0, 0
    for _ in range(60):
        truth, lines = [], []
        for _ in range(rng.randint(2, 4)):
            good, n = rng.random() < 0.5, rng.randint(3, 8)
            truth += [int(not good)] * n
            lines += lines_of(rng, good, n)
        decoded = field.decode(line_features([x.encode() for x in lines])[0])
        right += sum(a == b for a, b in zip(decoded, truth, strict=True))
        total += len(truth)
        share = judge("\n".join(lines), field)[6]
        words = [len(x.split()) for x in lines]
        assert abs(share - sum(w for w, t in zip(words, truth, strict=True) if not t) / sum(words)) < 0.25
        if len(set(truth)) == 2:
            shares.append(share)
    assert right >= 0.97 * total and all(0 < x < 1 for x in shares) and len(shares) > 20


def test_splicing_keeps_every_line():
    rng = np.random.default_rng(3)
    docs = [rng.normal(size=(n, FEATURES)) for n in (1, 40, 200, 7)]
    states = [np.full(len(d), i % 2) for i, d in enumerate(docs)]
    pages, labels = spliced(docs, states, 5)
    key = lambda x, y: sorted(zip(x[:, 0].tolist(), y.tolist(), strict=True))
    assert key(np.concatenate(pages), np.concatenate(labels)) == key(np.concatenate(docs), np.concatenate(states))
    assert max(map(len, pages)) < 60 and any(len(set(y.tolist())) == 2 for y in labels)


def test_training_reads_whole_texts_and_does_not_hang_on_row_order(spark):
    rng = random.Random(9)
    texts = [(i, "\n".join(lines_of(rng, 1, 150) + (lines_of(rng, 0, 150) if i % 2 == 0 else []))) for i in range(16)]  # bad ones differ after 150 lines only
    texts += [(i % 4, "\n".join(lines_of(rng, 1, 5))) for i in range(8)]  # ids with several rows
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)] + [(3, 1), (None, 0)], "doc_id long, quality int")
    fields = []
    for rows, parts in ((texts, 1), (texts[::-1], 3)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        fields.append(train_field(df, labels, sample=8))
    assert np.array_equal(fields[0].weights, fields[1].weights) and np.array_equal(fields[0].transitions, fields[1].transitions)
    page = "\n".join(lines_of(rng, 1, 20) + lines_of(rng, 0, 20))
    assert 0.3 < judge(page, fields[0])[6] < 0.9


def test_empty_nulls_clashes_and_no_labels(spark, empty_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    field = train_field(empty_docs, labels)
    assert quality_rules(empty_docs, field).count() == 0
    rows = [(None, None, "x"), (1, "", None), (1, " \n ", "y"), (2, "w%d " * 3 + " ".join(f"v{i}" for i in range(60)), "z")]
    out = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, kept string"), field, keep_text=True).collect()
    assert [r.kept for r in out] == [False, False, False, True] and [r.text for r in out] == [r[1] for r in rows]
    assert len(line_features([])[0]) == 0


def test_base_measures_against_sql(sf):
    rows = duckdb.sql(
        f"""SELECT text, len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')) AS n,
                   length(regexp_replace(text, '[ \\t\\n\\v\\f\\r]', '', 'g')) AS chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS symbols
            FROM '{sf}/documents.parquet'"""
    ).fetchall()
    for text, n, chars, symbols in rows:
        assert judge(text, LineField())[:3] == (n, chars, symbols)
