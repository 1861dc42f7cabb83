"""Operator 8 - URL filters by a Bloom filter cascade (native).

A rule is (action, host, path).  It fits a URL whose host is the rule's or a subdomain of it
and whose path starts with the rule's; the longest rule wins (ties: the longer host).  A URL
thus has one candidate key for each of its host suffixes and each path length that any rule
has.  Level 1 of the cascade is a Bloom filter of the listed keys; over the corpus's complete
key universe its false positives are known, and level 2 encodes those; level 3 encodes the
listed keys that level 2 takes in by mistake, and so on until no mistake is left.  Membership
over that universe is then exact and probing needs no join: the bitmaps are literals in the
expression.  Level 1's rate falls with |listed| / |universe|, so every level's size follows
the list and not the corpus.  A list whose first level would take more than ``max_bytes`` is too large for literals: its
pages' keys are joined with it instead.

Defined results: null URLs and URLs without ``://`` have empty host and path and meet no rule;
an empty rule list allows everything; repeated rows are judged alike; extra columns pass through, and columns of the input
named like an output column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, scratch, table

#: action, host, path
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

BITS = 7  # of each byte of a bitmap, so that one byte is one ASCII character


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of all rules that could fit, longest first (ties: longer host first)."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: F.length(host) > 0),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length(path))
    pairs = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(
                fitting,
                lambda n: F.struct(
                    (-(F.length(s) + n)).alias("a"), (-F.length(s)).alias("b"), F.concat(s, F.substring(path, F.lit(1), n)).alias("key")
                ),
            ),
        )
    )
    return F.transform(F.array_distinct(F.array_sort(pairs)), lambda p: p["key"])


MAX_BYTES = 4 << 20  # of a level's bitmap in a plan


class BloomLevel:
    """One bitmap; bit i of seed s for a key is a seeded 64-bit hash modulo the size."""

    def __init__(self, n: int, rate: float, seed: int):
        self.k = max(1, round(-math.log2(rate)))
        self.m = max(64, math.ceil(n * self.k / math.log(2)))
        self.seed = seed
        self.bitmap = b""

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.seed * 64 + i), key), F.lit(self.m)) for i in range(self.k)]

    def build(self, keys: DataFrame) -> BloomLevel:
        """keys: one column ``key``.  Bits are or-ed per byte before they reach the driver."""
        bit = F.explode(F.array(*self.positions(F.col("key")))).alias("bit")
        words = (
            keys.select(bit)
            .groupBy((F.col("bit") / BITS).cast("long").alias("at"))
            .agg(F.bit_or(F.expr(f"shiftleft(1, cast(bit % {BITS} as int))")).alias("v"))
        )
        out = bytearray(self.m // BITS + 1)
        for at, v in words.toLocalIterator():  # at most m / 7 rows: bounded by the list
            out[at] = v
        self.bitmap = bytes(out)
        return self

    def test(self, key: Column) -> Column:
        found = F.lit(True)
        for p in self.positions(key):
            byte = F.ascii(F.substring(F.lit(self.bitmap), (F.floor(p / BITS) + 1).cast("int"), F.lit(1)).cast("string"))
            found = found & (F.getbit(byte, (p % BITS).cast("int")) == 1)
        return found


class BloomCascade:
    """Exact membership of listed keys over a complete universe of keys."""

    def __init__(self, levels: list[BloomLevel]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, max_levels: int = 64) -> BloomCascade:
        """Both have one column ``key``.  universe may hold listed keys and repeats."""
        listed = scratch(listed.select("key").where("key is not null").distinct(), "cascade-listed")
        n = listed.count()
        if not n:
            return cls([])
        total = max(n, universe.select(F.approx_count_distinct("key")).first()[0])
        rate = min(0.5, max(1e-12, n / (2 * total)))
        levels = [BloomLevel(n, rate, 1).build(listed)]
        wrong = universe.select("key").where(levels[0].test(F.col("key"))).distinct().join(listed, "key", "left_anti")
        inside, outside = listed, scratch(wrong, "cascade-wrong")
        while len(levels) < max_levels:
            n = outside.count()
            if not n:
                return cls(levels)
            level = BloomLevel(n, 0.1, len(levels) + 1).build(outside)
            levels.append(level)
            inside, outside = outside, scratch(inside.where(level.test(F.col("key"))), "cascade-wrong")
        raise RuntimeError("the cascade did not end")  # needs equal hashes of different keys under every seed

    def contains(self, key: Column) -> Column:
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.test(key) & ~out
        return out


def first_rule(base: DataFrame, keys: Column, listed: DataFrame) -> DataFrame:
    """base with rule, the first of its keys that is listed, by a join: for lists that no literal can hold."""
    rows = scratch(base.withColumn("__row", F.monotonically_increasing_id()), "urls-rows")
    pairs = rows.select("__row", F.posexplode(keys).alias("pos", "key")).join(listed.select("key").distinct(), "key")
    best = pairs.groupBy("__row").agg(F.min_by("key", "pos").alias("rule"))
    return rows.join(best, "__row", "left").drop("__row")


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, url_col: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``pages`` without its URL, with host, path, rule and verdict; ``allow`` where the cascade knows no key of the URL.

    rules: (action, host, path), as a list or a table.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in (url_col, "host", "path", "rule", "verdict", "__row")]
    base = pages.select(*rest, host.alias("host"), path.alias("path"))
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "action string, host string, path string")
    listed = scratch(rules.select(F.concat("host", "path").alias("key"), "action", F.length("path").alias("n")), "urls-listed")
    lengths = sorted(r.n for r in listed.select("n").distinct().collect())  # path lengths: a few
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    blocks = listed.where("action = 'block'").select("key")
    if listed.count() * 5 > max_bytes * BITS:  # even one key in 2 ** 5 false ones takes more
        found = first_rule(base, keys, listed)
        blocked = blocks.distinct().withColumnRenamed("key", "rule").withColumn("__blocked", F.lit(True))
        return found.join(blocked, "rule", "left").select(
            *(F.col(c) for c in found.columns), F.when(F.col("__blocked"), "block").otherwise("allow").alias("verdict")
        )
    member = BloomCascade.build(listed.select("key"), base.select(F.explode(keys).alias("key")))
    blocked = BloomCascade.build(blocks, listed.select("key"))
    rule = F.get(F.filter(keys, member.contains), F.lit(0)).alias("rule")
    return base.withColumn("rule", rule).withColumn(
        "verdict", F.when(F.col("rule").isNotNull() & blocked.contains(F.col("rule")), "block").otherwise("allow")
    )


def op8_url_filters(spark, sf_dir):
    """Every page's URL under RULES."""
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))


SQL = """
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS pos FROM pages
), r AS (
  SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u
), h AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM r
), rules(action, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT page_id, host, path,
         max_by(rhost || rpath, length(rhost || rpath)) AS rule,
         max_by(action, length(rhost || rpath)) AS action
  FROM h LEFT JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM best
"""
