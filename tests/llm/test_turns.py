import hashlib
import random
import re
import zlib

import duckdb
import pytest

from quarry.llm import turns

SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(rows):
    """rows (initial, must go, truncated): (cost, audit, [(row or None, letter, role)]) by dynamic programming over (row, state)."""
    forced = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def offer(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def inserts(ways):
        for _ in range(3):
            for state, (cost, audit, steps) in list(ways.items()):
                offer(ways, forced[state], (cost + 2, audit + "I", steps + ((None, "I", forced[state]),)))

    inserts(best)
    for n, (initial, gone, cut) in enumerate(rows):
        then = {}
        for state, (cost, audit, steps) in best.items():
            offer(then, state, (cost + 3, audit + "D", steps))
            if not gone:
                offer(then, forced[state], (cost + 2 + cut, audit + "R", steps + ((n, "R", forced[state]),)))
                if initial == forced[state] or (initial == "s" and state == ""):
                    offer(then, initial, (cost + cut, audit + "K", steps + ((n, "K", initial),)))
        inserts(then)
        best = then
    return min(best[s] for s in ("", "a") if s in best)


def brute(original):
    rows, out = damage(original), {}
    for conv in {r[0] for r in original}:
        mine = [(t, r, hashlib.md5(f"{len(r)}:{r}:{x}".encode()).hexdigest(), x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2]))
        seen, faults, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, _, text in mine:
            body = text.rstrip(SPACE)
            fault = "blank" if not body.lstrip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            if fault:
                count[fault] += 1
        numbers = {r[0] for r in mine if r[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        initials = [r[1][:1] for r in mine]
        wrong = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, steps = cheapest([(i, f in ("blank", "duplicate"), int(f == "truncated")) for i, f in zip(initials, faults, strict=True)])
        lines = []
        for n, letter, state in steps:
            role = mine[n][1] if letter == "K" else {"u": "user", "a": "assistant"}[state]
            lines.append(f"{role}:{'' if n is None else mine[n][3]}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def corpus(rng, convs=60, longest=14):
    rows = []
    for conv in range(convs):
        n = rng.choice([1, 2, 3, rng.randint(1, longest)])
        for turn in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "User", ""]) if rng.random() < 0.4 else ["user", "assistant"][turn % 2]
            text = rng.choice(["Yes.", "No!", "Why?", "", " \t\n", None, "cut off", "A line.\nA second one. \n", "x\x1c", "é. "]) if rng.random() < 0.5 else f"Text {rng.randint(0, 10**9)}."
            rows.append((conv, turn + rng.choice([0, 0, 0, 2]) if turn else 0, role, text))
    rows += [(None, t, r, f"null id {t}.") for t, r in ((0, "user"), (1, "assistant"), (3, "user"))]
    rows += [(900, None, "user", "No turn?"), (900, None, "assistant", "Nor here."), (900, 5, "user", "Five.")]
    rows += [(901, None, None, None)]
    rows += [(902, 0, "user", "Same.")] * 7 + [(902, 1, "assistant", "Same.")] * 3
    return rows


def answers(spark, rows, tmp_path):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    found = turns.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("bits, fan", [(12, 64), (2, 2)])
def test_equals_brute_force(spark, monkeypatch, tmp_path, bits, fan):
    monkeypatch.setattr(turns, "BLOCK_BITS", bits)
    monkeypatch.setattr(turns, "FAN", fan)
    rng = random.Random(bits)
    rows = corpus(rng)
    rows += [(1000, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Go on.", "cut", "", f"Line {t}.", f"Line {t}!"])) for t in range(300)]
    assert answers(spark, rows, tmp_path) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert answers(spark, [], tmp_path) == {}


def test_all_rows_dropped(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert answers(spark, [(gone, 0, "user", "Hello.")], tmp_path) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_whole_tables(spark, sf):
    found = {r.conv_id: tuple(r)[1:] for r in turns.op12_conversation_repair(spark, sf).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found == brute(rows)


def test_sql_equals_brute_force(sf):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    for rows in (corpus(random.Random(12)), con.sql(f"select conv_id, turn, role, text from '{sf}/conversations.parquet'").fetchall()):
        con.execute("delete from conversations")
        con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
        assert {r[0]: r[1:] for r in con.execute(turns.SQL).fetchall()} == brute(rows)


def test_product_is_associative():
    rng = random.Random(3)
    for _ in range(200):
        kinds = bytes(rng.randrange(16) for _ in range(rng.randint(2, 12)))
        cut = rng.randint(1, len(kinds) - 1)
        left, right = turns.block_matrix(kinds[:cut]), turns.block_matrix(kinds[cut:])
        whole = turns.leaf(kinds)
        assert [x and x[:2] for x in turns.multiply(left, right)] == [x and x[:2] for x in whole] == [x and x[:2] for x in turns.block_matrix(kinds)]


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "First.", "x"), (1, 1, "user", "Second?", "y"), (1, 2, "user", "Third?", "z")]
    summary, repaired = turns.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string"))
    # An inserted user turn and one role changed (4) are cheaper than a deletion and one role changed (5).
    assert (summary.first().cost, summary.first().audit) == cheapest([("a", False, False), ("u", False, False), ("u", False, False)])[:2] == (4, "IKKR")
    got = [(r.role, r.text, r.edit) for r in repaired.orderBy("seq", "sub").collect()]
    assert got == [("user", "", "I"), ("assistant", "First.", "K"), ("user", "Second?", "K"), ("assistant", "Third?", "R")]
