import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.sources import readers, splits

EVENT = "index bigint, text string, reactions map<string,int>, inner array<struct<a: string>>"
BITS = ["}", "{", '"', "\\", "[", "]", ",", "a", " ", "\n", "é", '\\"', "},{", '{"x": 1}', "\ufeff"]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def events(n, seed):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(BITS) for _ in range(r.randrange(12)))
    return [{"index": i, "text": text(), "reactions": {text(): i}, "inner": [{"a": text()} for _ in range(r.randrange(3))]} for i in range(n)]


def test_array_elements_equal_the_whole_file_reader(spark, tmp_path, small_splits):
    d = tmp_path / "events"
    d.mkdir()
    forms = [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}]
    for i, form in enumerate(forms):
        (d / f"{i}.json").write_text(json.dumps(events(20 + i, i), **form), encoding="utf-8")
    (d / "empty.json").write_text(" [ \n]\n")
    (d / "marked.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(events(3, 9)).encode())
    out = splits.array_elements(spark, str(d))
    got = out.select(F.element_at(F.split("file", "/"), -1).alias("f"), "n", F.from_json("json", EVENT, {"mode": "FAILFAST"}).alias("e"))
    got = {(r.f, r.n): r.e.asDict(recursive=True) for r in got.collect()}
    want = {(f"{i}.json", j): e for i in range(4) for j, e in enumerate(events(20 + i, i))}
    want |= {("marked.json", j): e for j, e in enumerate(events(3, 9))}
    assert got == want
    whole = spark.read.schema(EVENT).option("multiLine", True).json(str(d / "1.json"))
    assert sorted(r["index"] for r in whole.collect()) == list(range(21))
    assert splits.pieces(spark, str(d / "1.json"), "}").select(splits.BLOCK).distinct().count() > 3


@pytest.mark.parametrize("bad", ['[{"index": 1}', '[{"index": 1}, {"index": 2', '[{"index": 1} {"index": 2}]', '{"index": 1}', '[{"index": "a}]', '[{"index": 1}, 7]', '[{"index": 1}]]', ""])
def test_broken_arrays_are_errors(spark, tmp_path, bad):
    (tmp_path / "bad.json").write_text(bad)
    if bad:
        with pytest.raises(Exception, match="array of objects|FAILFAST|MALFORMED"):
            readers.read_events(spark, str(tmp_path / "bad.json")).collect()
    else:
        assert readers.read_events(spark, str(tmp_path / "bad.json")).count() == 0


def test_lines_keep_their_numbers_over_splits(spark, tmp_path, small_splits):
    d = tmp_path / "lines"
    d.mkdir()
    for f in ("a", "b"):
        lines = ["" if i % 7 == 3 else json.dumps({"id": f"{f}{i}", "x": "y" * (i % 50)}) for i in range(1, 90)]
        (d / f"{f}.jsonl").write_text("\n".join(lines) + ("\n" if f == "a" else ""), encoding="utf-8", newline="")
    (d / "c.jsonl").write_bytes(b'{"id": "c1"}\r\n\r\n{"id": "c3"}\r\n')
    got = readers.read_located_jsonl(spark, str(d), "id string, x string")
    want = {(f"{f}{i}", i) for f in ("a", "b") for i in range(1, 90) if i % 7 != 3} | {("c1", 1), ("c3", 3)}
    assert {(r.id, r.line) for r in got.collect()} == want
    ordered = readers.read_ordered_jsonl(spark, str(d), "id string, x string").orderBy("corpus_ord")
    assert [r.id for r in ordered.collect()] == [k for k, _ in sorted(want, key=lambda w: (w[0][0], w[1]))]
    assert splits.pieces(spark, str(d), "\n").select(splits.FILE, splits.BLOCK).distinct().count() > 10
