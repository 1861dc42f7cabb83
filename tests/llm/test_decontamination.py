import random
from itertools import combinations

import pytest
from texts import prose

from quarry.llm.decontamination import decontaminate


def planted(spark):
    rng = random.Random(9)
    items = [(i, " ".join(prose(rng, rng.randint(14, 50)))) for i in range(20)] + [(20, None), (21, ""), (22, "too short"), (23, " ".join(prose(rng, 9)))]
    rows, truth = [], set()
    for d in range(80):
        body = prose(rng, 200)
        if d % 2 == 0:
            i = (d // 2) % 20
            w = items[i][1].split()
            if d % 4 == 0:  # one word in six replaced
                for j in range(3, len(w), 6):
                    w[j] = "replaced"
            if d % 8 == 2:
                w = [x.upper() for x in w]
            at = rng.randrange(200)
            body[at:at] = w
            truth.add((d, i))
        rows.append((d, " ".join(body)))
    rows += [(900, None), (901, ""), (902, items[23][1]), (None, items[0][1]), (903, "Too SHORT."), (904, "this is too short by far")]
    truth |= {(902, 23), (None, 0), (903, 22)}
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), truth


def test_planted_leaks_are_found_and_nothing_else(spark):
    docs, items, truth = planted(spark)
    got = decontaminate(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth
    assert all(r.matched <= r.length and r.matched <= r.item_words for r in got)


def test_a_join_of_hashes_gives_the_same(spark, corpus):
    docs, items, truth = planted(spark)
    docs = docs.unionByName(docs.where("doc_id % 8 = 0")).unionByName(spark.createDataFrame(corpus, "doc_id long, text string"))
    items = items.unionByName(spark.createDataFrame([(50, corpus[3][1][:200]), (51, corpus[3][1][:200]), (None, corpus[30][1])], "item_id long, text string"))
    one = decontaminate(docs, items)
    for bits in (1 << 16, 1 << 10):
        two = decontaminate(docs, items, broadcast_bytes=0, bitmap_bits=bits)
        assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)
    assert truth <= {(r.doc_id, r.item_id) for r in one.collect()} and one.where("item_id = 50").count() and not one.where("item_id = 51").count()


def words_of(text):
    return [w for w in (x.translate(str.maketrans("", "", ".,;:!?\"'()[]")) for x in (text or "").lower().split()) if w]


def brute(doc, item):
    """Most equal words of any stretch on any diagonal that counts as a leak."""
    d, t, best = words_of(doc), words_of(item), 0
    for g in range(-len(t) + 1, len(d)):
        equal = [d[g + k] == t[k] if 0 <= g + k < len(d) else None for k in range(len(t))]
        if len(t) <= 10:
            n = sum(e is True for e in equal)
            if n >= (-(-8 * len(t) // 10) if len(t) >= 8 else len(t)) and (len(t) >= 5 or len(d) == len(t)):
                best = max(best, n)
            continue
        sums = [0]
        for e in equal:
            sums.append(sums[-1] + (e is True) - (e is False))
        if sum(e is True for e in equal) < 10:
            continue
        scores = [(sums[b] - sums[a], a, b) for a in range(len(t)) for b in range(a + 1, len(t) + 1)]
        top = max(scores)[0]
        for score, a, b in scores:
            n = sum(e is True for e in equal[a:b])
            if score == top and n >= 10 and n >= 0.6 * (b - a):
                best = max(best, n)
    return best


def test_overlaps_match_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(prose(rng, rng.choice((3, 6, 9, 12, 20, 40))))) for i in range(30)]
    rows = []
    for d in range(150):
        i = rng.randrange(30)
        w = items[i][1].split()
        rate = rng.choice((0, 0.1, 0.2))
        w = [x if rng.random() >= rate else f"new{rng.randrange(10**6)}" for x in w]
        a = rng.choice((0, 0, rng.randrange(len(w))))
        pad = prose(rng, rng.choice((0, 25)))
        rows.append((d, " ".join([*pad, *w[a:], *pad])))
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r.matched for r in got}
    expected = {(d, i): n for d, t in rows for i, x in items if (n := brute(t, x))}
    assert set(found) <= set(expected) and all(found[k] <= expected[k] for k in found)
    exact = {k: n for k, n in expected.items() if n == len(items[k[1]][1].split())}
    assert exact.items() <= found.items() and len(exact) > 40
    assert len(found) >= 0.97 * len(expected)


def test_one_normaliser_for_both_sides(spark):
    greek = "ΟΔΟΣ λόγος Ἀθῆναις φως ΚΟΣΜΟΣ İstanbul DİYARBAKIR straße ΣΊΣΥΦΟΣ τέλος ὍΛΟΣ νόμος ẞ ΆΛΛΟΣ μέρος ΕΊΔΟΣ"
    items = [(1, greek), (2, greek.upper()), (3, greek.lower())]
    docs = spark.createDataFrame([(i, f"before it {t} after it") for i, t in items], "doc_id long, text string")
    for i in items:
        for limit in (1 << 20, 0):
            got = decontaminate(docs, spark.createDataFrame([i], "item_id long, text string"), broadcast_bytes=limit, bitmap_bits=1 << 16)
            got = {r.doc_id: (r.start, r.matched, r.item_words) for r in got.collect()}
            assert got[i[0]] == (2, 16, 16)


def test_short_items(spark):
    items = spark.createDataFrame([(1, "Paris"), (2, "four little words here"), (3, "What is the capital city"), (4, "seven words are in this item now")], "item_id long, text string")
    docs = [(1, "paris!"), (2, "they went to Paris"), (3, "Four little words, here"), (4, "so four little words here"), (5, "tell me: what is the capital city of it"), (6, "what was the capital city"), (7, "x seven words are in this item now y")]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 2), (5, 3), (7, 4)}


def test_a_passage_of_many_items_is_one_row(spark):
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = new(30)
    items = [(i, " ".join([*shared, *new(12)])) for i in range(50)]
    docs = [(1, " ".join([*new(40), *shared, *new(40)])), (2, items[33][1])]
    for limit in (1 << 20, 0):
        got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=limit, bitmap_bits=1 << 16).collect()
        assert sorted((r.doc_id, r.item_id, r.matched, r.n_items) for r in got) == [(1, 0, 30, 50), (2, 33, 42, 50)]


def test_empty_sides_and_repeats(spark, empty_docs):
    docs, items, _ = planted(spark)
    assert decontaminate(empty_docs, items).count() == 0
    assert decontaminate(docs, items.limit(0)).count() == 0
    one = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)), "x")] * 2, "doc_id long, text string, item_id string")
    same = spark.createDataFrame([(5, " ".join(f"w{i}" for i in range(10, 25)))], "item_id long, text string")
    assert [(r.doc_id, r.start, r.length, r.matched) for r in decontaminate(one, same).collect()] == [(1, 10, 15, 15)] * 2


def test_case_and_punctuation_are_ignored(spark):
    item = "Élan vital, (une) phrase; avec: des mots et ENCORE d'autres mots."
    doc = "avant élan VITAL une phrase avec des ,, mots et encore dautres mots après"
    got = decontaminate(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(2, item)], "item_id long, text string")).first()
    assert (got.start, got.length, got.matched, got.item_words) == (1, 11, 11, 11)


def test_short_items_with_replaced_words(spark):
    rng = random.Random(12)
    items, rows, truth = [], [], set()
    for n, lost in ((8, 1), (9, 1), (10, 2)):
        for which in combinations(range(n), lost):
            i = len(items)
            words = [f"i{i}w{j}" for j in range(n)]
            items.append((i, " ".join(words)))
            for j in which:
                words[j] = "replaced"
            pad = prose(rng, rng.choice((0, 30)))
            rows.append((i, " ".join([*pad, *words, *pad])))
            truth.add((i, i, n - lost))
            rows.append((1000 + i, " ".join(w for j, w in enumerate(words) if j not in (n - 1, n - 2, n - 3))))
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.matched) for r in got} == truth


@pytest.mark.parametrize("n", range(5, 17))
def test_short_items_with_changed_words(spark, n):
    """An item is found if the words that are left are as many as it needs, wherever the changed ones stand."""
    rng = random.Random(n)
    item = [f"w{n}x{i}" for i in range(n)]
    need = min(10, -(-8 * n // 10)) if n >= 8 else n
    rows, want = [], set()
    for changed in range(min(4, n)):
        places = list(combinations(range(n), changed))
        for gone in places if len(places) <= 60 else rng.sample(places, 60):
            rows.append((len(rows), " ".join(["before", "it", *(f"new{i}" if i in gone else w for i, w in enumerate(item)), "after", "it"])))
            if n - changed >= need:
                want.add(len(rows) - 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in decontaminate(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    if n <= 14:
        assert got == want
    else:  # longer ones rest on the masks: those with few changes are found
        assert got <= want and {i for i in want if sum(w.startswith("new") for w in rows[i][1].split()) <= 1} <= got


def test_items_that_share_their_windows_are_all_compared(spark):
    """An item that holds another's windows doesn't stand for it, nor a passage's first place in an item for its second."""
    new = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    eight = new("e", 8)
    other = [*new("o", 3), *eight[3:]]  # of the same shape, so that they share the hash of their last words
    run, left, right = new("r", 8), new("l", 6), new("t", 20)
    twice = [*run, *left, *run, *right]
    items = [(1, other), (2, eight), (3, [*new("a", 12), *new("s", 9)]), (4, [*new("b", 12), *new("s", 9), *new("c", 4)]), (5, twice)]
    docs = [
        (1, [eight[0], "changed", *eight[2:]]),  # item 2 with a word changed, in the part that items 1 and 2 don't share
        (2, [*new("b", 12)[9:], *new("s", 9), *new("c", 4)]),
        (3, [*run, *(w if i % 4 else "other" for i, w in enumerate(right))]),  # the second place of run in item 5
    ]
    items, docs = ([(i, " ".join(w)) for i, w in rows] for rows in (items, docs))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 0):
        got = decontaminate(*frames, broadcast_bytes=limit, bitmap_bits=1 << 16).collect()
        assert sorted((r.doc_id, r.item_id, r.matched) for r in got) == [(1, 2, 7), (2, 4, 16), (3, 5, 23)]
        assert all(r.matched == brute(docs[r.doc_id - 1][1], items[r.item_id - 1][1]) for r in got)


def test_candidates_in_parts_give_the_same(spark, monkeypatch):
    """A passage of many items, with members and candidates dealt in small parts."""
    from quarry.llm import decontamination

    rng = random.Random(3)
    shared = prose(rng, 20)
    items = [(i, " ".join([*prose(rng, 8), *shared, *shared[:9], *prose(rng, 8)])) for i in range(40)]
    docs = [(d, " ".join([*prose(rng, 5), *items[7 * d % 40][1].split()[rng.randrange(8) :]])) for d in range(12)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate(*frames).collect()))
    monkeypatch.setattr(decontamination, "PART_ITEMS", 3)
    monkeypatch.setattr(decontamination, "PART_WORDS", 200)
    assert one == sorted(map(tuple, decontaminate(*frames, broadcast_bytes=0, bitmap_bits=1 << 16).collect()))
    assert {(d, 7 * d % 40) for d in range(12)} <= {r[:2] for r in one}
