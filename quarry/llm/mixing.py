"""Operator 11 - mixing sources to target weights.

Words are summed for each source.  Every source gets a share of ``share`` times all words by its weight, but no more than ``cap``
times its own words; what is above is shared among the others by weight until none is above.  A source's rate is its
target over its words, and a row is taken floor(rate) times and once more with the fraction as probability: a
Bernoulli draw from a hash of the row, so that reruns agree whatever the partitions are.

The texts are read once: words are counted and the row's digest is taken in the scan, and only ``carry`` columns
go on.  The levels of sources come from running sums over their order (size by weight), which no single task or driver
holds; rates are broadcast up to a number of sources that is checked, and joined beyond it.

Defined results: null and empty texts have no words, are taken by the rate and count nothing; the null source is one, after all others; a source
without words has target 0 and rate 0, and its rows are not taken; sources without a weight have target 0.  Rows that are equal in id,
source and text are numbered, so that each has a draw of its own and a group of copies meets its rate; the numbers are given out within
input partitions and linked by counts, so that a group of any size is spread.  Columns of the input named like an output column are replaced; others
pass if they are carried.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import small
from ..operators.ordered import numbered, running_sums
from .common import scratch, table

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
OUTPUT = ("size", "source_size", "target", "copies", "taken")
DRAW_BITS = 52

SPACES = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of words; the text is rewritten with one letter for each, so nothing but its own size is held."""
    text = F.coalesce(text, F.lit(""))
    marks = F.regexp_replace(text, f"[{SPACES}]*+[^{SPACES}]++[{SPACES}]*+", "w")
    return F.when(text.rlike(f"[^{SPACES}]"), F.length(marks)).otherwise(0).cast("long")


def row_key(id_: Column, source: Column, text: Column) -> Column:
    parts = [F.coalesce(id_.cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")), F.md5(F.coalesce(text, F.lit("")))]
    return F.md5(F.concat_ws(":", *parts))


def draw(key: Column, number: Column) -> Column:
    """A number from 0 to under 1 for the number-th of the equal rows with this key."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), number.cast("string"))), 1, DRAW_BITS // 4)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << DRAW_BITS))


def source_targets(sizes: DataFrame, weights: tuple | DataFrame = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size), one row for each source.

    weights: a cycle over the sources by code point (null last), or a table (source, weight).
    A level is a word count for each unit of weight.  With the sources in order of size by weight, those before the first that can
    take the level that they leave are full.
    """
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("__name"), F.col("weight").cast("double").alias("weight"))
        named = sizes.join(given, sizes["source"].eqNullSafe(F.col("__name")), "left").drop("__name")
        named = named.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    else:
        ordered = numbered(sizes, [F.asc_nulls_last("source")], "__n", "mixing-sources")
        cycle = F.array(*[F.lit(float(w)) for w in weights])
        named = ordered.withColumn("weight", F.get(cycle, ((F.col("__n") - 1) % len(weights)).cast("int"))).drop("__n")
    full = F.lit(cap) * F.col("source_size")
    named = scratch(named.withColumn("__full", full), "mixing-weights")
    words, weight = named.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    weighted = named.where("weight > 0")
    order = [F.col("__full") / F.col("weight"), F.asc_nulls_last("source")]
    sums = running_sums(weighted, order, {"__filled": F.col("__full"), "__used": F.col("weight")}, "mixing-levels")
    left = F.lit(share) * F.lit(float(words)) - (F.col("__filled") - F.col("__full"))
    level = left / (F.lit(float(weight)) - (F.col("__used") - F.col("weight")))
    fits = level * F.col("weight") <= F.col("__full")
    found = sums.where(fits).agg(F.min_by(level, F.struct(F.col("__full") / F.col("weight"), level))).first()[0]
    target = F.when(F.col("weight") > 0, F.col("__full") if found is None else F.least(F.col("__full"), F.lit(found) * F.col("weight"))).otherwise(0.0)
    return named.select("source", "source_size", target.alias("target"))


def numbered_copies(rows: DataFrame) -> DataFrame:
    """rows (__key, __part, ...) with __n, from 0 within each key: only rows whose key others share are moved."""
    shared = scratch(rows.groupBy("__key").agg(F.count("*").alias("__c")).where("__c > 1").select("__key", F.lit(True).alias("__shared")), "mixing-copies")
    if shared.isEmpty():
        return rows.withColumn("__n", F.lit(0).cast("long"))
    marked = rows.join(small(shared), "__key", "left")
    alone = marked.where("__shared is null").withColumn("__n", F.lit(0).cast("long"))
    many = marked.where("__shared")
    inside = Window.partitionBy("__key", "__part").orderBy(F.lit(0))
    parts = many.groupBy("__key", "__part").agg(F.count("*").alias("__c"))  # a row for each input partition at most
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("__from", F.coalesce(F.sum("__c").over(earlier), F.lit(0))).drop("__c")
    spread = many.withColumn("__n", F.row_number().over(inside) - 1).join(starts, ["__key", "__part"]).withColumn("__n", F.col("__n") + F.col("__from")).drop("__from")
    return alone.unionByName(spread.select(*alone.columns)).drop("__shared")


def mix(
    docs: DataFrame, weights: tuple | DataFrame = WEIGHTS, share: float = SHARE, cap: float = CAP, carry: list[str] | None = None,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (size times copies).

    carry: columns that the result keeps, by default all; without the text nothing of it is written or moved.
    """
    carried = [c for c in (docs.columns if carry is None else carry) if c not in OUTPUT and not c.startswith("__")]
    id_, source, text = (F.col(f"`{c}`") for c in (id_col, source_col, text_col))
    source = source.cast("string")
    rows = docs.select(*[F.col(f"`{c}`") for c in carried], source.alias("__source"), word_count(text).alias("size"), row_key(id_, source, text).alias("__key"))
    rows = scratch(rows.withColumn("__part", F.spark_partition_id()), "mixing-rows")
    sizes = scratch(rows.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size")), "mixing-sizes")
    targets = source_targets(sizes, weights, share, cap).withColumnRenamed("source", "__name")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    targets = small(scratch(targets.withColumn("__rate", rate), "mixing-targets"))
    found = numbered_copies(rows).join(targets, F.col("__source").eqNullSafe(F.col("__name")))
    whole = F.floor("__rate")
    copies = (whole + (draw(F.col("__key"), F.col("__n")) < F.col("__rate") - whole).cast("long")).cast("int")
    return found.withColumn("copies", copies).select(*carried, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emitted(mixed: DataFrame) -> DataFrame:
    """Each row of mix() as often as it is taken, with ``copy`` from 1; the rate's cap bounds a row's copies."""
    kept = mixed.where("copies > 0")
    return kept.select(*[c for c in mixed.columns if c != "copy"], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def op11_source_mixing(spark, sf_dir):
    """All documents, sources weighing 5, 2, 1 in turn, one and a half times their words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, carry=["doc_id", "source"]).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce('s' || source, 'n'), ':', md5(coalesce(text, '')))) AS key
  FROM documents
), n AS (
  SELECT *, row_number() OVER (PARTITION BY key) - 1 AS n FROM d
), s AS (
  SELECT source, sum(size) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, CAST(source_size AS DOUBLE) AS source_size, 2.0 * CAST(source_size AS DOUBLE) AS full_size,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
         sum(CAST(source_size AS DOUBLE)) OVER () AS words
  FROM s
), l AS (
  SELECT *, full_size / weight AS ratio,
         (CAST(1.5 AS DOUBLE) * words - coalesce(sum(full_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w
  WINDOW before AS (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT arg_min(level, (ratio, level)) AS level FROM l WHERE level * weight <= full_size
), t AS (
  SELECT source, source_size, least(full_size, f.level * weight) AS target, coalesce(least(full_size, f.level * weight) / nullif(source_size, 0), 0) AS rate FROM w, f
), c AS (
  SELECT doc_id, n.source, size, CAST(source_size AS BIGINT) AS source_size, target,
         CAST(floor(rate) AS INTEGER) + CAST(CAST(('0x' || substr(md5(key || ':' || CAST(n AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 < rate - floor(rate) AS INTEGER) AS copies
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM c
"""
