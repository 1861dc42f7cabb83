"""Operator 12 - conversation structure repair by a min-plus matrix scan.

A conversation's rows are made to follow ``(s?(ua)+)?``, an optional system turn and then pairs of user and assistant.  An
automaton with four states (E nothing yet, S after the system turn, U after a user, A after an assistant) reads the roles.  Each
row becomes a 4x4 matrix over (cost, audit): from each state to each state the cheapest edits, ties by the least audit string.
Keep costs 0, Rerole 2, Delete 3, each inserted turn 2, and a truncated row that stays 1 more; blank and duplicate
rows must go.  Every matrix is closed under inserts on both sides.  The product is associative: equally dear audits of one stretch
are never prefixes of each other, so that the order of strings survives joining them.

Rows get a global order by ranges, so that a long conversation lies in many tasks.  Blocks of up to BLOCK rows are reduced by a
tree; blocks of one conversation meet FAN at a time, level by level, and the states chosen at the top go down
the same levels.  A block that knows its states then edits its own rows.  Only keys, roles, digests and flags are ordered and scanned; a text
joins the row that keeps it once, at the end.

Defined results: rows go by turn (nulls first), then by role, then by the digest of role and text; a null role or text is one space; a null id is a
conversation of its own.  A row's first fault counts: blank, duplicate of an earlier row of the conversation, truncated.  Roles other than those
that begin with s, u or a can't stay.  Repeated rows are duplicates; conversations without rows are not in the result; an empty table
gives an empty one; extra columns don't pass, whatever their names.  An audit is one string, which bounds a conversation to 2 ** 31 edits.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import small
from .common import scratch, table

STATES = "ESUA"
FORCED = (2, 2, 3, 2)  # the state that the next user or assistant turn leads to, from each state
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
LEAF, FAN = 8, 64  # rows whose product is remembered, blocks that meet in one step
BLOCK_BITS = 12  # rows of a block: 4,096 at most

SPACES = r"\x20\x09-\x0D"


def multiply(a: list, b: list, mark: bool = False) -> list:
    """Min-plus product of 4x4 matrices of (cost, audit, path) or None; ``mark`` puts the state between them into the path."""
    out = [None] * 16
    for i in range(4):
        for k in range(4):
            x = a[4 * i + k]
            if x is None:
                continue
            for j in range(4):
                y = b[4 * k + j]
                if y is None:
                    continue
                cost, best = x[0] + y[0], out[4 * i + j]
                if best is None or cost < best[0] or cost == best[0] and x[1] + y[1] < best[1]:
                    out[4 * i + j] = (cost, x[1] + y[1], f"{x[2]}{k}{y[2]}" if mark else "")
    return out


def _closure() -> list:
    out = [None] * 16
    for i in range(4):
        out[4 * i + i] = (0, "", "")
        at, letters = i, ""
        for _ in range(2):
            at, letters = FORCED[at], letters + "I"
            if out[4 * i + at] is None:
                out[4 * i + at] = (INSERT * len(letters), letters, "")
    return out


CLOSURE = _closure()


@lru_cache(maxsize=64)
def turn_matrix(kind: int) -> tuple:
    """kind: role (0 system, 1 user, 2 assistant, 3 other) + 4 if the row must go + 8 if it is truncated."""
    role, gone, rest = kind & 3, kind & 4, TRUNCATED if kind & 8 else 0
    out = [None] * 16

    def offer(i, j, cost, letter):
        if out[4 * i + j] is None or (cost, letter) < out[4 * i + j][:2]:
            out[4 * i + j] = (cost, letter, "")

    for i in range(4):
        offer(i, i, DELETE, "D")
        if not gone:
            offer(i, FORCED[i], REROLE + rest, "R")
            if role == 0 and i == 0:
                offer(0, 1, rest, "K")
            elif role in (1, 2) and FORCED[i] == role + 1:
                offer(i, role + 1, rest, "K")
    return tuple(multiply(multiply(CLOSURE, out), CLOSURE))


@lru_cache(maxsize=1 << 16)
def leaf(kinds: bytes) -> list:
    out = turn_matrix(kinds[0])
    for k in kinds[1:]:
        out = multiply(out, turn_matrix(k))
    return out


def reduced(matrices: list, mark: bool = False) -> list:
    """Product of matrices by a tree: neighbours meet until one is left."""
    while len(matrices) > 1:
        pairs = [multiply(matrices[i], matrices[i + 1], mark) for i in range(0, len(matrices) - 1, 2)]
        matrices = pairs + matrices[len(pairs) * 2 :]
    return matrices[0]


def block_matrix(kinds: bytes) -> list:
    return reduced([leaf(kinds[i : i + LEAF]) for i in range(0, len(kinds), LEAF)])


def illegal(a: int, b: int) -> bool:
    return (a & 3, b & 3) not in ((0, 1), (1, 2), (2, 1))


def apply_audit(state: int, audit: str, kinds: bytes) -> list:
    """(row or None for an inserted turn, letter, state after it) in order, from ``state``."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            state = FORCED[state]
            out.append((None, letter, state))
            continue
        if letter == "R":
            state = FORCED[state]
        elif letter == "K":
            state = (kinds[at] & 3) + 1
        out.append((at, letter, state))
        at += 1
    return out


# -- columns


def conversation_key(conv: Column) -> Column:
    return F.when(conv.isNull(), "n").otherwise(F.concat(F.lit("c"), conv.cast("string")))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACES}]")


def is_truncated(text: Column) -> Column:
    return ~is_blank(text) & ~text.rlike(rf"[.!?][{SPACES}]*+\z")


def spaced(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))


# -- passes over sorted rows


def _grouped(batches, width: int):
    """(key, rows) of runs of rows with equal first ``width`` columns."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield key, rows


MATRIX = "costs array<long>, audits array<string>, paths array<string>"
ENDS = "head int, tail int, illegal long"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batch(schema: str, rows: list) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _emitted(schema: str, rows, size: int = 1024):
    """Rows in batches of ``size`` and of a few megabytes of strings."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str)) + sum(len(x or "") for v in row if isinstance(v, list) for x in v if not isinstance(x, int))
        if len(held) >= size or weight > 1 << 22:
            yield _batch(schema, held)
            held, weight = [], 0
    if held:
        yield _batch(schema, held)


def _packed(m: list) -> tuple:
    return [x and x[0] for x in m], [x and x[1] for x in m], [x and x[2] for x in m]


def _unpacked(costs, audits, paths) -> list:
    return [None if c is None else (c, a, p) for c, a, p in zip(costs, audits, paths, strict=True)]


BLOCKS = f"conv string, block long, {MATRIX}, {ENDS}"


def _block_rows(batches):
    """conv, block, seq, kind, sorted, to a row for each block."""

    def rows():
        for (conv, block), found in _grouped(batches, 2):
            kinds = bytes(k for _, k in found)
            wrong = sum(illegal(a, b) for a, b in zip(kinds, kinds[1:], strict=False))
            yield conv, block, *_packed(block_matrix(kinds)), kinds[0], kinds[-1], wrong

    return _emitted(BLOCKS, rows())


LEVEL = f"conv string, at long, {MATRIX}, {ENDS}"


def _level_rows(batches):
    """conv, at (a step up), place, matrix, ends, sorted, to a row for each (conv, at)."""

    def rows():
        for (conv, at), found in _grouped(batches, 2):
            matrices = [_unpacked(c, a, [""] * 16) for _, c, a, *_ in found]
            wrong = sum(r[6] for r in found) + sum(illegal(a[5], b[4]) for a, b in zip(found, found[1:], strict=False))
            yield conv, at, *_packed(reduced(matrices, mark=True)), found[0][4], found[-1][5], wrong

    return _emitted(LEVEL, rows())


EDITS = "conv string, seq long, sub long, h string, edit string, state int"


def _edit_rows(batches):
    """conv, block, seq, kind, h, audit, state: a block's audit and state come first (seq -1), then its rows.

    seq becomes the block's first, sub the place of an edit in its audit.
    """

    def rows():
        for (conv, _), ((_, _, _, audit, state), *found) in _grouped(batches, 2):
            for n, (at, letter, now) in enumerate(apply_audit(state, audit, bytes(r[1] for r in found))):
                yield conv, found[0][0], n, None if at is None else found[at][2], letter, now

    return _emitted(EDITS, rows(), 8192)


def _dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


# -- the operator


def flagged_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, h, seq, block, blank, duplicate, truncated, kind) of every row, seq rising with a conversation's order."""
    who, said = spaced(role), spaced(text)
    rows = turns.select(
        conversation_key(F.col(f"`{conv}`")).alias("conv"), F.col(f"`{turn}`").alias("turn"), who.alias("role"),
        F.md5(F.concat_ws(":", F.length(who).cast("string"), who, said)).alias("h"), is_blank(said).alias("blank"), is_truncated(said).alias("cut"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("h"), F.col("tie")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    placed = scratch(placed.withColumn("seq", F.monotonically_increasing_id()).withColumn("block", F.shiftright("seq", BLOCK_BITS)), "turns-ordered")
    repeated = scratch(placed.groupBy("conv", "h").agg(F.min("seq").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "turns-repeated")
    seen = F.coalesce(F.col("seq") > F.col("first"), F.lit(False))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    marked = placed.join(small(repeated), ["conv", "h"], "left").withColumn("duplicate", ~F.col("blank") & seen)
    marked = marked.withColumn("truncated", F.col("cut") & ~F.col("duplicate")).drop("first", "cut")
    gone = F.col("blank") | F.col("duplicate")
    return marked.withColumn("kind", kind + F.when(gone, 4).otherwise(0) + F.when(F.col("truncated") & ~gone, 8).otherwise(0))


def best_end(costs: Column, audits: Column) -> Column:
    """struct(cost, audit, state): the cheapest way from E to an accepting state."""
    ways = [F.struct(F.get(costs, F.lit(j)).alias("cost"), F.get(audits, F.lit(j)).alias("audit"), F.lit(j).alias("state")) for j in (0, 3)]
    return F.array_min(F.filter(F.array(*ways), lambda w: w["cost"].isNotNull()))


def solved(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv, cost, audit, illegal; blocks: conv, block, audit, state at its start)."""
    blocks = scratch(_dealt(flagged.select("conv", "block", "seq", "kind"), ["conv", "block"], ["seq"]).mapInArrow(_block_rows, BLOCKS), "turns-blocks")
    many = small(scratch(blocks.groupBy("conv").agg(F.count("*").alias("blocks")).where("blocks > 1"), "turns-long"))
    best = best_end(F.col("costs"), F.col("audits"))
    whole = blocks.join(many, "conv", "left_anti").withColumn("best", best)
    conversations = whole.select("conv", "best.cost", "best.audit", "illegal")
    ways = whole.select("conv", "block", F.col("best.audit").alias("audit"), F.lit(0).alias("state"))
    most = many.agg(F.max("blocks")).first()[0]
    if most is None:
        return conversations, ways
    places = blocks.join(many, "conv", "left_semi").select("conv", "block").withColumn("place", F.row_number().over(Window.partitionBy("conv").orderBy("block")).cast("long") - 1)
    places = scratch(places, "turns-places")
    level = scratch(blocks.join(places, ["conv", "block"]).drop("block"), "turns-level")
    levels, width = [level], most
    while width > 1:
        up = _dealt(level.select("conv", F.floor(F.col("place") / FAN).alias("at"), "place", "costs", "audits", "paths", "head", "tail", "illegal"), ["conv", "at"], ["place"])
        level = scratch(up.mapInArrow(_level_rows, LEVEL).withColumnRenamed("at", "place"), "turns-level")
        levels.append(level)
        width = -(-width // FAN)
    top = level.withColumn("best", best)
    conversations = conversations.unionByName(top.select("conv", "best.cost", "best.audit", "illegal"))
    chosen = top.select("conv", "place", F.lit(0).alias("state"), F.col("best.state").alias("end"))
    for upper, lower in zip(levels[:0:-1], levels[-2::-1], strict=True):
        path = F.get("paths", F.col("state") * 4 + F.col("end"))
        steps = upper.join(chosen, ["conv", "place"]).select("conv", F.col("place") * FAN, F.concat(F.col("state").cast("string"), path, F.col("end").cast("string")).alias("walk"))
        steps = steps.toDF("conv", "from", "walk").select("conv", "from", "walk", F.explode(F.sequence(F.lit(1), F.length("walk") - 1)).alias("n"))
        digit = lambda n: F.col("walk").substr(n, F.lit(1)).cast("int")
        chosen = steps.select("conv", (F.col("from") + F.col("n") - 1).alias("place"), digit(F.col("n")).alias("state"), digit(F.col("n") + 1).alias("end"))
        if lower is levels[0]:
            parts = lower.join(chosen, ["conv", "place"]).join(places, ["conv", "place"])
            ways = ways.unionByName(parts.select("conv", "block", F.get("audits", F.col("state") * 4 + F.col("end")).alias("audit"), "state"))
        else:
            chosen = scratch(chosen, "turns-chosen")
    return conversations, ways


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conversations, rows) of ``turns``.

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.  rows: the repaired ones (conv_id, seq and sub
    for their order, edit K, R or I, role, text); a conversation's rows rise with (seq, sub).
    """
    flagged = scratch(flagged_turns(turns, conv, turn, role, text), "turns-flagged")
    conversations, ways = solved(flagged)
    conversations, ways = scratch(conversations, "turns-solved"), scratch(ways, "turns-ways")
    number = F.col("turn").cast("long")
    counts = flagged.groupBy("conv").agg(
        F.coalesce(F.max(number) - F.min(number) + 1 - F.count_distinct(number), F.lit(0)).alias("gaps"),
        *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    ids = turns.select(F.col(f"`{conv}`").alias("conv_id")).distinct().withColumn("conv", conversation_key(F.col("conv_id")))
    summary = ids.join(counts, "conv").join(conversations, "conv").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    none = F.lit(None).cast("string")
    heads = ways.select("conv", "block", F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("kind"), none.alias("h"), "audit", "state")
    rows = flagged.select("conv", "block", "seq", "kind", "h", none.alias("audit"), F.lit(None).cast("int").alias("state"))
    edits = _dealt(heads.unionByName(rows), ["conv", "block"], ["seq"]).mapInArrow(_edit_rows, EDITS).where("edit <> 'D'")
    who, said = spaced(role), spaced(text)
    texts = turns.select(
        F.col(f"`{conv}`").alias("conv_id"), conversation_key(F.col(f"`{conv}`")).alias("conv"), who.alias("role"), said.alias("text"),
        F.md5(F.concat_ws(":", F.length(who).cast("string"), who, said)).alias("h"),
    ).dropDuplicates(["conv", "h"])
    edits = scratch(edits, "turns-edits")
    forced = F.when(F.col("state") == 2, "user").otherwise("assistant")
    stay = edits.where("edit <> 'I'").join(texts, ["conv", "h"])
    stay = stay.select("conv", "conv_id", "seq", "sub", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(forced).alias("role"), "text")
    new = edits.where("edit = 'I'").join(ids, "conv").select("conv", "conv_id", "seq", "sub", "edit", forced.alias("role"), F.lit("").alias("text"))
    return summary, stay.unionByName(new).drop("conv")


def _digests(batches):
    def rows():
        key, h = (), None
        for b in batches:
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if conv != key:
                    if h:
                        yield key, h.hexdigest()
                    key, h = conv, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
        if h:
            yield key, h.hexdigest()

    return _emitted("conv string, repaired_sha256 string", rows())


def digests(rows: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of repair()'s rows.  A digest is sequential: a conversation's rows stream through one task, which holds one batch."""
    keyed = rows.select(conversation_key(F.col("conv_id")).alias("conv"), "seq", "sub", "role", "text")
    return _dealt(keyed, ["conv"], ["seq", "sub"]).select("conv", "role", "text").mapInArrow(_digests, "conv string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """conversations with faults by the hash of id and turn."""
    key = F.concat_ws(":", spaced("conv_id"), spaced("turn"))
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(key) % 20).alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("n")).drop("n")


def op12_conversation_repair(spark, sf_dir):
    """All conversations, damaged and repaired."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    summary, rows = repair(damaged(turns))
    sums = digests(rows)
    ids = turns.select("conv_id").distinct().withColumn("conv", conversation_key(F.col("conv_id")))
    found = summary.withColumn("conv", conversation_key(F.col("conv_id"))).drop("conv_id")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    sha = F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    return ids.join(found, "conv", "left").join(sums, "conv", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), sha)


#: The same by dynamic programming over (row, state) in recursive tables: the hash of id and turn, the cheapest audits, and the walk along them.
SQL = r"""
WITH RECURSIVE crc_steps(i, c, k) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8
), crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), hit AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda p: CAST(ascii(substr(key, p, 1)) AS BIGINT))),
                         lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), CAST(4294967295 AS BIGINT)) % 20 AS k
  FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS n
  FROM hit WHERE k <> 0
), placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || ':' || text)) AS rn FROM damaged
), judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS seen,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) || initial AS pair FROM placed
), r AS MATERIALIZED (
  SELECT conv_id, turn, role, text, initial, rn, pair, blank, seen AND NOT blank AS duplicate, blank OR seen AS gone,
         NOT blank AND NOT seen AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated FROM judged
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
), forced(state, after) AS (VALUES ('E', 'U'), ('S', 'U'), ('U', 'A'), ('A', 'U')
), inserts(state, reached, dear, letters) AS (
  SELECT state, state, 0, '' FROM forced UNION ALL SELECT state, after, 2, 'I' FROM forced
  UNION ALL SELECT a.state, b.after, 4, 'II' FROM forced a JOIN forced b ON b.state = a.after
), ways(conv_id, rn, state, best) AS (
  SELECT conv_id, CAST(0 AS BIGINT), reached, struct_pack(cost := CAST(dear AS BIGINT), audit := letters) FROM counts, inserts WHERE state = 'E'
  UNION ALL
  SELECT conv_id, rn, state, min(best) FROM (
    SELECT w.conv_id, r.rn, i.reached AS state, struct_pack(cost := w.best.cost + o.cost + i.dear, audit := w.best.audit || o.letter || i.letters) AS best
    FROM ways w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.rn = w.rn + 1 JOIN forced f ON f.state = w.state,
    LATERAL (SELECT 'D' AS letter, 3 AS cost, w.state AS state
             UNION ALL SELECT 'R', 2 + CAST(r.truncated AS INTEGER), f.after WHERE NOT r.gone
             UNION ALL SELECT 'K', CAST(r.truncated AS INTEGER), upper(r.initial)
             WHERE NOT r.gone AND ((r.initial = 's' AND w.state = 'E') OR (r.initial IN ('u', 'a') AND upper(r.initial) = f.after))) o
    JOIN inserts i ON i.state = o.state
  ) GROUP BY conv_id, rn, state
), solved AS (
  SELECT c.conv_id, min(best) AS best FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.rn WHERE state IN ('E', 'A') GROUP BY c.conv_id
), walk(conv_id, p, rn, state, audit, lines) AS (
  SELECT conv_id, 0, CAST(0 AS BIGINT), 'E', best.audit, CAST([] AS VARCHAR[]) FROM solved
  UNION ALL
  SELECT w.conv_id, w.p + 1, w.rn + CAST(letter <> 'I' AS INTEGER), CASE letter WHEN 'D' THEN w.state WHEN 'K' THEN upper(r.initial) ELSE f.after END, w.audit,
         CASE letter WHEN 'D' THEN w.lines WHEN 'K' THEN list_append(w.lines, r.role || ':' || r.text)
                     ELSE list_append(w.lines, CASE f.after WHEN 'U' THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE r.text END) END
  FROM (SELECT *, substr(audit, p + 1, 1) AS letter FROM walk WHERE p < length(audit)) w JOIN forced f ON f.state = w.state
  LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.rn = w.rn + 1
), told AS (
  SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM walk WHERE p = length(audit)
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(s.best.cost, 0) AS cost, coalesce(s.best.audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM i.conv_id
"""
