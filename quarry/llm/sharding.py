"""Operator 6 - sharding by a hypergeometric communication matrix (native).

Rows fall into blocks by a hash of their columns and their number, so that neither equal keys nor equal rows stand together.  For B blocks and S shards the driver draws
the B x S matrix of exact block-to-shard counts: row sums are the block sizes, column sums
the shard sizes (at most one apart), and each cell is a draw without replacement from what
is left.  Each block is permuted locally by a seeded hash, its first rows go to shard 0,
the next to shard 1 and so on; after the exchange every shard is permuted again.  The result
is a uniform shuffle with exact shard sizes, and all of it runs as DataFrame expressions:
only the B block counts reach the driver, and B grows with the rows by ``rows_per_block``.

Rows are numbered and written once in the shared folder, so that every job, and a task that runs again, sees the same numbers.

Defined results: null keys and null texts are rows like any other; equal rows differ in
their shard and slot as any two rows do; an empty table gives an empty result; input columns named like an
output column are replaced.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, table


def _stirling_error(n: int) -> float:
    """log(n!) less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    m = float(n) * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / m) / m) / m) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    s, e, j = (x - mean) * v, 2 * x * v, 1
    while True:
        e *= v * v
        s, before = s + e / (2 * j + 1), s
        if s == before:
            return s
        j += 1


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """log of the binomial probability by its saddle point: exact to rounding however large n is."""
    if x == 0:
        return n * math.log1p(-p) if n else 0.0
    if x == n:
        return n * math.log(p)
    c = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return c + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def log_hypergeometric(x: int, good: int, bad: int, draws: int) -> float:
    """log of the probability of x good ones in ``draws`` without replacement."""
    total = good + bad
    p, q = draws / total, (total - draws) / total
    return _log_binomial(x, good, p, q) + _log_binomial(draws - x, bad, p, q) - _log_binomial(draws, total, p, q)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """One exact draw by inversion, walking outward from the mode (about one deviation of steps)."""
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(log_hypergeometric(mode, good, bad, draws))
    u = rng.random() - p
    if u <= 0:
        return mode
    lo, hi, p_lo, p_hi = mode, mode, p, p
    while lo > low or hi < high:
        if hi < high:
            p_hi *= (good - hi) * (draws - hi) / ((hi + 1) * (bad - draws + hi + 1))
            hi += 1
            u -= p_hi
            if u <= 0:
                return hi
        if lo > low:
            p_lo *= lo * (bad - draws + lo) / ((good - lo + 1) * (draws - lo + 1))
            lo -= 1
            u -= p_lo
            if u <= 0:
                return lo
    return mode  # rounding left a sliver of probability


def communication_matrix(block_sizes: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Exact counts: rows sum to the block sizes, columns to shard sizes at most one apart."""
    rng = random.Random(seed)
    total = sum(block_sizes)
    left = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = []
    for size in block_sizes:
        row, rest, draws = [], sum(left), size
        for s in range(n_shards):
            rest -= left[s]
            x = hypergeometric(rng, left[s], rest, draws)
            row.append(x)
            draws -= x
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


#: Up to so many blocks (8 bytes for each block and shard) are broadcast; more are joined by a shuffle.
BROADCAST_BLOCKS = 20_000


def hypergeometric_shards(
    df: DataFrame,
    keys: list[str],
    ties: list[str] | None = None,
    n_shards: int = 40,
    seed: int = 20,
    rows_per_block: int = 500_000,
    min_blocks: int = 64,
) -> DataFrame:
    """``df`` plus ``shard`` (int, 0 to n_shards-1) and ``slot`` (long, gapless from 0 in a shard).

    keys: columns whose hash, with the row's number, places a row.
    ties: further columns that count with the keys.
    rows_per_block: rows a local permutation may hold; more rows give more blocks.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot", "__row", "__block", "__local", "__spread", "__edges", "__part", "__base")
    df = scratch(df.withColumn("__row", F.monotonically_increasing_id()), "shards-rows")
    total = df.count()
    n_blocks = max(min_blocks, -(-total // rows_per_block))
    ties = [*keys, *(ties or []), "__row"]
    df = df.withColumns(
        {
            "__local": F.xxhash64(F.lit(seed), *ties),
            "__spread": F.xxhash64(F.lit(seed + 1), *ties),
            "__block": F.pmod(F.xxhash64(F.lit(seed + 2), *ties), F.lit(n_blocks)).cast("int"),
        }
    )
    sizes = dict(df.groupBy("__block").count().collect())  # n_blocks rows at most
    blocks = sorted(sizes)
    matrix = communication_matrix([sizes[b] for b in blocks], n_shards, seed)
    rows = []
    for b, counts in zip(blocks, matrix, strict=True):
        edges, at = [], 0
        for c in counts[:-1]:
            at += c
            edges.append(at)
        rows.append((b, edges))
    edges = spark.createDataFrame(
        rows, T.StructType([T.StructField("__block", T.IntegerType()), T.StructField("__edges", T.ArrayType(T.LongType()))])
    )
    local = Window.partitionBy("__block").orderBy("__local", *ties)
    placed = (
        df.withColumn("__local", F.row_number().over(local))
        .join(F.broadcast(edges) if n_blocks <= BROADCAST_BLOCKS else edges, "__block")
        .withColumn("shard", F.size(F.filter("__edges", lambda e: e < F.col("__local"))))
        .drop("__edges", "__block", "__local")
    )
    n_parts = -(-total // (n_shards * rows_per_block)) or 1
    placed = placed.withColumn("__part", F.pmod(F.shiftright("__spread", 20), F.lit(n_parts)).cast("int"))
    within = Window.partitionBy("shard", "__part").orderBy("__spread", *ties)
    placed = placed.withColumn("slot", F.row_number().over(within).cast("long") - 1)
    if n_parts > 1:  # large shards are permuted in parts; a part starts where the ones before it end
        before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        bases = (
            placed.groupBy("shard", "__part")
            .agg(F.count("*").alias("n"))
            .select("shard", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
        )
        placed = placed.join(bases, ["shard", "__part"]).withColumn("slot", F.col("slot") + F.col("__base")).drop("__base")
    return placed.drop("__part", "__spread", "__row")


def op6_hypergeometric_shards(spark, sf_dir):
    """All documents in 40 shards of equal counts (law ``rows``)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = hypergeometric_shards(docs, ["doc_id"], ["text_crc32", "size"], 40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
