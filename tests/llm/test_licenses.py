import random
from collections import Counter

from texts import prose

from quarry.llm.licenses import NAMING, TEMPLATES, TEXTS, Template, align, blocks_of, increasing, scan, scan_licenses, words_of


def longest(pairs):
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        for j in range(i):
            if pairs[j][1] < pairs[i][1]:
                best[i] = max(best[i], best[j] + 1)
    return max(best, default=0)


def test_longest_increasing_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(0, 12)
        pairs = list(enumerate(rng.sample(range(50), n)))
        got = increasing(pairs)
        assert len(got) == longest(pairs) and all(a[1] < b[1] and a[0] < b[0] for a, b in zip(got, got[1:], strict=False))


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a = rng.choices("abcdefgh", k=rng.randint(0, 10))
        b = rng.choices("abcdefgh", k=rng.randint(0, 20))
        got, _ = align(b, a, 0, len(a), 0, len(b))
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    t = words_of(TEMPLATES["GPL-3.0"])
    got, anchors = align(t, t, 0, len(t), 0, len(t))
    assert len(got) == len(t) and anchors > 0


def test_planted_notes(spark):
    rng = random.Random(3)
    rows, truth = [], set()
    names = list(TEMPLATES)
    for d in range(120):
        body = prose(rng, rng.randint(0, 300))
        if d % 2:
            name = names[d // 2 % len(names)]
            note = TEMPLATES[name].split()
            if d % 6 == 1:
                note = [w.upper() for w in note]
            at = rng.randint(0, len(body))
            body[at:at] = note
            truth.add((d, name))
        elif d % 6 == 2:
            body += ["this", "is", "the", "license", "of", "the", "public"]  # words without a note
        rows.append((d, " ".join(body)))
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in got} == truth
    assert all(r.coverage == 1.0 for r in got)


def test_changed_word_and_two_notes(spark):
    rows = [(1, "x y Licensed under the famous Apache License, Version 2.0. z"), (2, TEMPLATES["MIT"] + " a b c d e f g h i j " + TEMPLATES["Proprietary"]), (3, "all of the rights are not reserved here or there")]
    got = {(r.doc_id, r.license) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "Apache-2.0"), (2, "MIT"), (2, "Proprietary")}


def test_defined_cases(spark, empty_docs):
    assert scan_licenses(empty_docs).count() == 0
    df = spark.createDataFrame([(None, TEMPLATES["MIT"], "a"), (1, None, "b"), (2, "", "c"), (2, TEMPLATES["MIT"], "d")], "doc_id long, text string, license string")
    assert sorted(str(r.doc_id) for r in scan_licenses(df).collect()) == ["2", "None"]
    assert scan_licenses(df, {}).count() == 0


def test_long_texts_go_in_stretches():
    import pyarrow as pa

    rng = random.Random(4)
    words = prose(rng, 5000)
    for at in (0, 97, 1500, 4990):
        words[at:at] = TEMPLATES["Apache-2.0"].split()
    text = " ".join(words)
    parts = list(blocks_of(text, 100, 40))
    assert all(words_of(text)[base : base + len(w)] == w for base, w in parts) and parts[-1][0] + len(parts[-1][1]) == len(words)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    whole, pieces = (list(scan(TEMPLATES, 0.75, 0.6, True, n)([batch]))[0].to_pylist() for n in (10**9, 100))
    assert whole == pieces and whole[0]["license"] == "Apache-2.0"


def found(spark, text):
    return {r.license for r in scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}


def test_every_note_of_several_is_found(spark):
    rng = random.Random(6)
    for other in ("LGPL-3.0", "AGPL-3.0", "GPL-2.0"):
        for gap in (0, 3, 12, 25, 60):
            text = " ".join([*prose(rng, 5), TEMPLATES[other], *prose(rng, gap), TEMPLATES["GPL-3.0"], *prose(rng, 5)])
            assert found(spark, text) == {other, "GPL-3.0"}, (other, gap)
    names = list(TEMPLATES)
    for _ in range(3):
        rng.shuffle(names)
        text = " ".join(w for n in names for w in (*prose(rng, rng.randint(1, 8)), TEMPLATES[n]))
        assert found(spark, text) == set(TEMPLATES)


def unnamed(name, text):
    """Places of the words that don't name the license: one whose version or name is gone can't be told."""
    t = Template(name, text, Counter(), NAMING[name])
    named = {i + j for places in t.phrases for i, n in places for j in range(n)}
    return [i for i in range(len(t.words)) if i not in named]


def test_edited_headers_and_permission_texts(spark):
    rng = random.Random(8)
    rows, truth = [], set()
    for name, texts in TEXTS.items():
        for text in texts:
            words = text.split()
            for edits in (0, len(words) // 20):
                edited = list(words)
                for i in rng.sample(unnamed(name, text), edits):
                    edited[i] = "edited"
                rows.append((len(rows), " ".join([*prose(rng, 60), "Copyright", "(c)", "2020", "X", *edited, *prose(rng, 60)])))
                truth.add((len(rows) - 1, name))
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in got} == truth


def test_common_forms(spark):
    for name, text in {
        "GPL-3.0": "x is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or any later version.",
        "GPL-2.0": "it is free software under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "CC-BY-4.0": "This article is licensed under a Creative Commons Attribution 4.0 International License",
        "CC-BY-SA-4.0": "Text is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
        "BSD-2-Clause": TEXTS["BSD-2-Clause"][0].removeprefix("All rights reserved. "),
    }.items():
        assert found(spark, text) == {name}, name


def brute_align(text, template):
    """Patience alignment by its definition, with the increasing subsequence found by trying all; words matched of the best choice of subsequences."""
    if not text or not template:
        return 0
    once = [(i, text.index(w)) for i, w in enumerate(template) if template.count(w) == 1 and text.count(w) == 1]
    chains: list[list] = [[]]
    for p in once:
        chains += [[*c, p] for c in chains if not c or c[-1][1] < p[1]]
    size = max(map(len, chains))
    if size:
        best = 0
        for c in chains:
            if len(c) == size:
                edges = [(-1, -1), *c, (len(template), len(text))]
                gaps = zip(edges, edges[1:], strict=False)
                best = max(best, size + sum(brute_align(text[x + 1 : y], template[i + 1 : j]) for (i, x), (j, y) in gaps))
        return best
    n = 0
    while template and text and template[0] == text[0]:
        n, template, text = n + 1, template[1:], text[1:]
    while template and text and template[-1] == text[-1]:
        n, template, text = n + 1, template[:-1], text[:-1]
    return n


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_matches_brute_force():
    rng = random.Random(14)
    same = 0
    for _ in range(300):
        template = rng.choices("abcdefghij", k=rng.randint(1, 9))
        text = [w for w in template if rng.random() < 0.8]
        for _ in range(rng.randint(0, 4)):
            text.insert(rng.randint(0, len(text)), rng.choice("abcdefghijxyz"))
        got, anchors = align(text, template, 0, len(template), 0, len(text))
        most = brute_align(text, template)
        assert len(got) <= most <= common(template, text)
        same += len(got) == most
        once = [(i, text.index(w)) for i, w in enumerate(template) if template.count(w) == 1 and text.count(w) == 1]
        assert anchors >= longest(once)
    assert same >= 290  # of equally long subsequences any may be taken
    for _ in range(50):  # words that are all different: every word that is left is matched
        template = rng.sample([f"w{i}" for i in range(400)], 60)
        text = [f"new{i}" if rng.random() < 0.3 else w for i, w in enumerate(template)]
        assert len(align(text, template, 0, 60, 0, 60)[0]) == sum(a == b for a, b in zip(text, template, strict=True))


def test_every_place_is_a_row_and_matches_brute_force(spark):
    """Edited copies of every template among prose: found where they stand, with the words left as coverage."""
    rng = random.Random(23)
    known = {name: TEXTS[name][0] for name in ("Apache-2.0", "MIT", "BSD-3-Clause", "GPL-2.0", "MPL-2.0")}
    rows, truth = [], []
    for d in range(30):
        body, at = [], 0
        for name in rng.sample(sorted(known), 3) + ["MIT", "MIT"]:
            pad = [f"x{rng.randrange(10**6)}" for _ in range(rng.randint(90, 200))]
            note = words_of(known[name])
            edits = set(rng.sample([i for i in unnamed(name, known[name]) if 3 <= i < len(note) - 3], len(note) // 12))
            note = [f"new{k}" if k in edits else w for k, w in enumerate(note)]
            body += pad + note
            truth.append((d, name, at + len(pad), len(note) - len(edits)))
            at += len(pad) + len(note)
        rows.append((d, " ".join(body)))
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()
    assert sorted((r.doc_id, r.license, r.start) for r in got) == sorted(t[:3] for t in truth)
    most = {t[:3]: t[3] for t in truth}
    assert all(0.97 * most[r.doc_id, r.license, r.start] <= r.matched <= most[r.doc_id, r.license, r.start] for r in got)


def test_another_license_is_not_taken_for_a_known_one(spark):
    """Each text's own license at most: what the engine knows is named, and what it doesn't is left."""
    gpl = TEXTS["GPL-2.0"][0]
    for text, want in {
        "Released under the ISC License.": {"ISC"},
        "Released under the Apache License.": set(),
        "Released under the BSD 2-Clause License.": {"BSD-2-Clause"},
        "Released under the BSD 4-Clause License.": set(),
        "Licensed under CC BY-NC-SA 4.0.": {"CC-BY-NC-SA-4.0"},
        "Licensed under CC BY-NC-ND 4.0.": {"CC-BY-NC-ND-4.0"},
        "Licensed under CC BY 3.0.": {"CC-BY-3.0"},
        "Licensed under CC BY 2.5.": set(),
        "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": {"CC-BY-NC-SA-4.0"},
        "licensed under a Creative Commons Attribution-ShareAlike 2.0 Generic License.": set(),
        TEXTS["LGPL-2.1"][0]: {"LGPL-2.1"},
        TEXTS["LGPL-2.1"][0].replace("version 2.1", "version 2.0"): set(),
        gpl.replace("version 2", "version 1"): set(),
        gpl.replace("GNU General", "GNU Library General"): set(),
        TEXTS["Apache-2.0"][0].replace("Version 2.0", "Version 1.1"): set(),
        "Licensed under the Apache License, Version 1.1.": set(),
        "The single was released under the Columbia license.": set(),
        "The book was released under the new license in 1998.": set(),
        "This work is subject to the terms of the Mozilla Public License, version 1.1.": set(),
        "This work is licensed under the GNU General Public License, version 3.1.": set(),
    }.items():
        assert found(spark, f"Some words before. {text} And some words after it.") == want, text
