import random

import numpy as np
import pytest

from quarry.llm import jaccard
from quarry.llm.components import connected_components
from quarry.llm.jaccard import jaccard_components, join_block
from quarry.llm.vectext import SEGMENT, shingle_hashes, word_hashes

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    out, now = [], ""
    for c in (text or "").translate(LOWER) + " ":
        if c in SPACE:
            out += [now] if now else []
            now = ""
        else:
            now += c
    return out


def shingles(text, k=5):
    w = words(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, num=80, den=100):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_vectorised_hashes_agree_with_words(corpus):
    texts = [t or "" for _, t in corpus]
    h, o = word_hashes([t.encode() for t in texts])
    seen = {}
    for i, t in enumerate(texts):
        w = words(t)
        assert o[i + 1] - o[i] == len(w)
        for a, b in zip(w, h[o[i] : o[i + 1]].tolist(), strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)
    s, p = shingle_hashes(h, o, 5)
    for i, t in enumerate(texts):
        assert len(np.unique(s[p[i] : p[i + 1]])) == len(shingles(t))


def test_words_across_segments():
    text = (b"alpha beta " * (SEGMENT // 11 + 50)) + b"y" * (SEGMENT + 7) + b" end"
    h, o = word_hashes([b"alpha", text, b"end"])
    assert o.tolist() == [0, 1, len(text.split()) + 1, len(text.split()) + 2]
    assert h[0] == h[1] == h[3] and h[-1] == h[-2]


def test_matches_brute_force(docs, corpus):
    expected = brute(corpus)
    assert result(jaccard_components(docs)) == expected
    assert sum(c != i for i, (_, c) in expected.items()) > 10


@pytest.mark.parametrize("num", [80, 75, 50, 90])
def test_pairs_around_the_threshold(spark, num):
    rng = random.Random(num)
    rows = []
    for i in range(0, 160, 2):
        n = rng.randint(5, 70)
        base = [f"v{rng.randrange(10**5)}" for _ in range(n)]
        other = base[: max(1, n - rng.randint(0, n // 3 + 1))]
        if rng.random() < 0.5:
            other[rng.randrange(len(other))] = "x"
        if rng.random() < 0.3:
            other += [f"t{j}" for j in range(rng.randint(0, 8))]
        rows += [(i, " ".join(base)), (i + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, num)
    assert result(jaccard_components(df, num=num)) == expected
    assert 8 <= sum(c != i for i, (_, c) in expected.items()) < 75


def test_thresholds_at_the_edge(spark):
    base = [f"w{i}" for i in range(54)]
    rows = [(i, " ".join(base[: 54 - i])) for i in range(30)]  # 50 shingles, 49, 48, ...
    assert result(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("block_tokens", [200, 4_000_000])
def test_large_group_of_near_copies_and_split_blocks(spark, block_tokens):
    rng = random.Random(11)
    base = [f"t{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard_components(df, block_tokens=block_tokens)) == brute(rows)
    assert result(jaccard_components(df, broadcast_ids=0)) == brute(rows)


def test_block_join_random_sets():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.integers(0, 60, 25)
        sets = [np.unique(np.concatenate((rng.choice(base, 20), rng.integers(0, 500, rng.integers(0, 8))))).astype(np.uint64) for _ in range(30)]
        roots = join_block(list(range(30)), sets, 80, 100)
        label = list(range(30))
        for a in range(30):
            for b in range(a + 1, 30):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                if 100 * len(x & y) >= 80 * len(x | y):
                    old, new = max(label[a], label[b]), min(label[a], label[b])
                    label = [new if v == old else v for v in label]
        assert roots == label


def test_defined_cases(spark, empty_docs):
    assert jaccard_components(empty_docs).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (8, None), (9, ""), (10, "one two"), (11, "ONE  two"), (12, None)]
    got = jaccard_components(spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n int")).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by == {None: (2, 7), 7: (2, 7), 8: (0, 8), 9: (0, 9), 10: (1, 10), 11: (1, 10), 12: (0, 12)}


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(50, 90)] + [(200, 100), (300, 200), (300, 301), (5, 5)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 50 for i in range(50, 91)} | {i: 100 for i in (100, 200, 300, 301)}


def test_need_and_sample():
    for n in range(1, 400):
        r = jaccard.need(n, 80, 100)
        assert r * 100 >= 80 * n > (r - 1) * 100
        assert 1 <= jaccard.sample_match(n, 80, 100) <= r
