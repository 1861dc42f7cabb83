"""Files read in splits: line numbers, and the elements of JSON arrays.

Spark's text reader cuts a file into splits at a separator.  Each split is scanned by itself, and what a place
needs to know of the file before it comes from one summary row for each earlier split, so a file of any size is
read by as many tasks as it has splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import scratch

FILE, BLOCK, AT = "__file", "__block", "__at"
_BEFORE = (Window.unboundedPreceding, -1)


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(value, __file, __block, __at): what stands between separators; __at rises by one within a split (__block)."""
    at = F.monotonically_increasing_id().alias(AT)
    rows = spark.read.text(path, lineSep=separator)
    return rows.select("value", F.input_file_name().alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), at)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line) of text files; lines count from 1, blank ones too."""
    rows = pieces(spark, path, "\n")
    splits = rows.groupBy(FILE, BLOCK).agg(F.count("*").alias("__n"), F.min(AT).alias("__first"))
    earlier = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(*_BEFORE)  # one row for each split
    splits = splits.select(FILE, BLOCK, (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    return rows.join(splits, [FILE, BLOCK]).select("value", F.col(FILE).alias("file"), (F.col(AT) + F.col("__shift")).alias("line"))


def sums_before(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with a column for each of ``sums``: its sum over the pieces of the file before this one."""
    local = Window.partitionBy(FILE, BLOCK).orderBy(AT).rowsBetween(*_BEFORE)
    earlier = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(*_BEFORE)
    totals = rows.groupBy(FILE, BLOCK).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    bases = totals.select(FILE, BLOCK, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__base_{n}") for n in sums])
    out = rows.withColumns({n: F.coalesce(F.sum(c).over(local), F.lit(0)) for n, c in sums.items()}).join(bases, [FILE, BLOCK])
    return out.select(*rows.columns, *[(F.col(n) + F.col(f"__base_{n}")).alias(n) for n in sums])


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, json): the objects of files that hold one JSON array of objects each; n counts from 0.

    Files are cut at ``}``.  Whether a piece starts inside a string follows from the quotes before it, where an object
    ends from the braces outside strings.  An empty array has no elements.  What is no such array is an error where it can be told by its
    frame (no end, something between the objects); the objects themselves are checked by whoever parses them.
    """
    # Between quotes lie, in turn, what is outside strings and what is inside.  For both cases, start outside (0) and inside (1) a string: the
    # change of depth, the } at the end included.
    bare = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    opens = lambda side: F.length(F.regexp_replace(F.array_join(F.filter("__parts", lambda _, i: i % 2 == side), ""), r"[^{]+", ""))
    cut = pieces(spark, path, "}").withColumn("__parts", F.split(bare, '"'))
    odd = (F.size("__parts") - 1) % 2
    rows = cut.select(
        "value", FILE, BLOCK, AT, odd.alias("__odd"),
        (opens(0) - F.when(odd == 0, 1).otherwise(0)).alias("__d0"),
        (opens(1) - F.when(odd == 1, 1).otherwise(0)).alias("__d1"),
    )
    rows = scratch(rows, "array-pieces")
    last = rows.groupBy(FILE).agg(F.max(F.struct(BLOCK, AT)).alias("__last"))
    state = sums_before(rows, {"__quotes": F.col("__odd")})
    inside = F.col("__quotes") % 2
    state = state.withColumns({"__change": F.when(inside == 0, F.col("__d0")).otherwise(F.col("__d1")), "__closed": (inside + F.col("__odd")) % 2 == 0})
    state = sums_before(state.drop("__odd", "__d0", "__d1", "__quotes"), {"__depth": F.col("__change")})
    done = F.col("__closed") & (F.col("__depth") + F.col("__change") == 0)
    state = sums_before(state.withColumn("__done", done.cast("long")), {"n": F.col("__done")}).join(last, FILE)
    end = (F.col(BLOCK) == F.col("__last")[BLOCK]) & (F.col(AT) == F.col("__last")[AT])
    # The piece behind the last } closes the array; it stands alone under its number if nothing is left open.
    part = F.struct(BLOCK, AT, F.when(end, F.col("value")).otherwise(F.concat("value", F.lit("}"))).alias("t"), end.alias("end"))
    grouped = state.groupBy(FILE, "n").agg(F.array_sort(F.collect_list(part)).alias("p"))  # pieces of one object
    text = F.array_join(F.transform("p", lambda p: p["t"]), "")
    ends = grouped.select(FILE, "n", text.alias("t"), F.exists("p", lambda p: p["end"]).alias("end"), (F.size("p") == 1).alias("alone"))
    first = F.col("n") == 0
    tail = F.col("alone") & F.when(first, F.col("t").rlike(r"^\uFEFF?\s*\[\s*\]\s*$")).otherwise(F.col("t").rlike(r"^\s*\]\s*$"))
    frame = F.when(first, F.regexp_extract("t", r"^(\uFEFF?\s*\[\s*)\{", 1)).otherwise(F.regexp_extract("t", r"^(\s*,\s*)\{", 1))
    wrong = F.raise_error(F.concat(F.lit("not an array of objects: "), FILE, F.lit(", element "), F.col("n").cast("string")))
    json = F.when(F.col("end"), F.when(tail, F.lit(None)).otherwise(wrong)).when(frame == "", wrong).otherwise(F.substr("t", F.length(frame) + 1))
    return ends.select(F.col(FILE).alias("file"), "n", json.alias("json")).where("json is not null")
