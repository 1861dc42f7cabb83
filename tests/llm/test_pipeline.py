import importlib.util
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_decontamination import brute as brute_leak
from test_rules import lines_of
from texts import sentences
from tokenizers import Tokenizer as Slow

from quarry.llm import queries
from quarry.llm import stages
from quarry.llm.common import release, table
from quarry.llm.jaccard import jaccard_components
from quarry.llm.rules import fit_lines, judge, line_features


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = table(spark, sf, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        out[name] = docs
        if name != "packing":
            assert docs.columns == columns
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_each_stage_takes_effect(spark, sf, steps):
    start = ids(table(spark, sf, "documents"))
    kept = [ids(steps[n]) for n in ("quality_rules", "line_dedup", "jaccard_dedup", "decontamination")]
    assert start > kept[0] >= kept[1] >= kept[2] >= kept[3]
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    long = {r.doc_id for r in table(spark, sf, "documents").collect() if len((r.text or "").split()) >= 50}
    good = {i for i in long if labels.get(i) == 1}
    assert len(good & kept[0]) >= 0.95 * len(good)
    assert ids(steps["packing"]) == kept[3]


def test_no_line_twice_after_line_dedup(steps):
    owner = defaultdict(set)
    for r in steps["line_dedup"].collect():
        for line in r.text.split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").lower()
            if len(key) >= 10:
                owner[key].add(r.doc_id)
    assert max(map(len, owner.values())) == 1
    assert all(r.n_chars == len(r.text) for r in steps["line_dedup"].collect())


def test_run_is_the_stages(spark, sf, steps):
    digest = lambda df: Counter((r.doc_id, r.doc_tokens) for r in df.collect())
    one = {k[0]: k[1] for k in digest(corpus_pipeline.run(spark, sf))}
    two = {k[0]: k[1] for k in digest(steps["packing"])}
    assert one == two


def test_queries_run_over_whole_tables(spark, sf):
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 13))
    n = table(spark, sf, "documents").count()
    for k in (2, 5, 6, 7, 10):
        name = next(x for x in names if x.startswith(f"op{k}_"))
        assert names[name](spark, sf).count() == n
    assert release(spark) > 0


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert importlib.util.find_spec("corpus_pipeline") is not None


def shingles(text):
    words = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    """ids to the least id that links lead to."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return root


def built_corpus():
    """Good and bad documents, exact and near copies (in every line, so that line dedup mutilates them), shared lines, benchmark passages, short and empty ones."""
    rng = random.Random(77)
    items = [(i, sentences(rng, 4)) for i in range(6)]
    shared = [sentences(rng, 1) + f" shared line {i} of the site" for i in range(4)]
    texts, labels = [], []
    for i in range(60):
        good = i % 4 != 0
        lines = lines_of(rng, good, rng.randint(5, 9))
        lines = [x if not good else f"{x} {sentences(rng, 2)} end{i}x{k}" for k, x in enumerate(lines)]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines)), rng.choice(shared))
        if i % 10 == 7:
            lines.append(f"{sentences(rng, 2)} {items[i % 6][1]} {sentences(rng, 2)}")
        texts.append("\n".join(lines))
        labels.append((i, int(good), 0))
    for i in range(1, 40, 2):
        if i % 4 == 3:
            texts.append(texts[i])  # an exact copy
        lines = texts[i].split("\n")  # a near copy: a word in some lines
        for k in range(0, len(lines), 3):
            words = lines[k].split(" ")
            words[len(words) // 2] = f"changed{i}x{k}"
            lines[k] = " ".join(words)
        texts.append("\n".join(lines))
    texts += [None, "", " \n ", "too short to stay", shared[0], shared[0] + "\n" + shared[1] + "\n" + sentences(rng, 1)]
    return list(enumerate(texts)), labels, items


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs, labels, items = built_corpus()
    at = str(tmp_path_factory.mktemp("built"))
    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_run_matches_brute_force(spark, built):
    docs, labels, items = built_corpus()
    texts = {i: t or "" for i, t in docs}
    features = [np.array(line_features(texts[i].encode().split(b"\n"))[0], dtype="<f4").astype(float) for i, _, _ in labels]
    field = fit_lines(features, [q == 0 for _, q, _ in labels])
    kept = {i: t for i, t in texts.items() if judge(t, field)[7]}
    assert 20 < len(kept) < len(texts) - 10
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    owner = {}
    for i in sorted(kept):
        for line in kept[i].split("\n"):
            if len(key(line)) >= 10:
                owner.setdefault(key(line), i)
    cut = {}
    for i, t in kept.items():
        lines = t.split("\n")
        left = [x for x in lines if owner.get(key(x), i) == i]
        if len(left) == len(lines) or len(" ".join(left).split()) >= 50:
            cut[i] = "\n".join(left)
    assert len(cut) < len(kept) and sum(cut[i] != kept[i] for i in cut) > 10
    whole = brute_components({i: texts[i] for i in cut})
    one = {i: t for i, t in cut.items() if whole[i] == i}
    again = brute_components(one)
    one = {i: t for i, t in one.items() if again[i] == i}
    assert len(one) < len(cut)
    clean = {i: t for i, t in one.items() if not any(brute_leak(t, x) for _, x in items)}
    assert len(clean) < len(one)
    slow = Slow.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {i: len(slow.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, built).collect():
        got[r.doc_id] += r.length
        assert r.doc_tokens == expected[r.doc_id]
    assert got == expected
    copies = {i for i, r in brute_components(kept).items() if r != i}
    assert len(copies) > 15 and not copies & set(got)  # near copies leave whole


def test_no_fragments_reach_packing(spark, built):
    docs = table(spark, built, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, built).cache()
        if name == "line_dedup":
            groups = jaccard_components(table(spark, built, "documents").join(docs.select("doc_id"), "doc_id", "left_semi")).where("component_id < doc_id")
            copies = ids(groups)
    assert copies and not copies & ids(docs)
    assert all(len(r.text.split()) >= 50 for r in docs.collect())


def test_stages_on_nulls_repeats_clashes_and_empty_tables(spark, built):
    good = [r.text for r in table(spark, built, "documents").where("doc_id in (1, 2)").orderBy("doc_id").collect()]
    rows = [(None, good[0], 1, "a"), (5, good[1], 2, None), (5, good[1], 3, "c"), (6, None, 4, "d"), (7, "", 5, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int, kept_text string").withColumns({"__id": F.lit(1), "n_words": F.lit("x")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (df, df.limit(0)):
            out = stage(spark, docs, built)
            assert out.columns == df.columns and out.schema["n_words"].dataType.simpleString() == "string"
            got = {(r.doc_id, r.kept): (r.kept_text, r.n_words) for r in out.collect()}
            if docs is not df:
                assert not got
                continue
            assert {k: v for k, v in got.items()} == {(r[0], r[2]): (r[3], "x") for r in rows if (r[0], r[2]) in got}
            want = {"quality_rules": {1, 2, 3}, "line_dedup": {1, 2, 3, 4, 5}, "jaccard_dedup": {1, 2, 4, 5}, "decontamination": {1, 2, 3, 4, 5}}[name]
            assert {k[1] for k in got} == want
    assert stages.packing(spark, df.limit(0), built).count() == 0
    assert sorted({(r.doc_id or 0, r.doc_tokens) for r in stages.packing(spark, df, built).collect()})[-2:] == [(6, 1), (7, 1)]


def test_copies_and_leaks_go_by_row(spark, built):
    """Rows that share an id or have none are copies and leaks as any others."""
    docs, _, items = built_corpus()
    passage = f"{docs[1][1]} {items[0][1]}"
    plain = docs[2][1]
    rows = [(1, plain), (1, plain), (2, plain), (None, plain), (None, passage), (3, f"{docs[5][1]} and more words of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    near = stages.jaccard_dedup(spark, df, built)
    assert sorted((r.doc_id or 0, r.text) for r in near.collect()) == sorted([(1, plain), (0, passage), (3, rows[5][1])])
    assert sorted(r.doc_id for r in stages.decontamination(spark, near, built).collect()) == [1, 3]
    only = spark.createDataFrame([(None, plain), (9, plain)], "doc_id long, text string")
    assert [r.doc_id for r in stages.jaccard_dedup(spark, only, built).collect()] == [9]  # an id stays before none
