"""Numbers and running sums over a global order, without a task that sees all rows.

Rows are dealt out by ranges of the order and written sorted; each range is then scanned by itself, and
ranges are linked by one summary row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scratch

PART, AT = "__part", "__at"


def ranged(df: DataFrame, order: list, label: str = "ranged") -> DataFrame:
    """``df`` with __at, a long that rises with ``order`` (with gaps), and __part, the range a row stands in.

    Ties must be broken by ``order`` itself, or equal rows all stand in one range.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch(placed.withColumn(AT, F.monotonically_increasing_id()).withColumn(PART, F.shiftright(AT, 33)), label)


def before_parts(totals: DataFrame, names: list[str]) -> DataFrame:
    """(__part, names): sums over the ranges before each range.  totals: one row for each range."""
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select(PART, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in names]))


def running_sums(df: DataFrame, order: list, sums: dict[str, Column], label: str = "ranged") -> DataFrame:
    """``df`` with a column for each of ``sums``: its sum over the rows up to and with this one, in ``order``."""
    rows = ranged(df, order, label)
    local = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    totals = before_parts(rows.groupBy(PART).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), list(sums))
    totals = totals.select(PART, *[F.col(n).alias(f"__before_{n}") for n in sums])
    out = rows.withColumns({n: F.sum(c).over(local) for n, c in sums.items()}).join(totals, PART)
    return out.select(*df.columns, *[(F.col(n) + F.col(f"__before_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, order: list, name: str = "n", label: str = "ranged") -> DataFrame:
    """``df`` with its place in ``order``, from 1."""
    return running_sums(df, order, {name: F.lit(1).cast("long")}, label)


def gap_runs(df: DataFrame, ts: str, order: list[str], by: list[str], micros: int, mark: str, label: str = "gap-runs") -> DataFrame:
    """``df`` with __run and __first: runs end where ``by`` changes or more than ``micros`` lie between a row's ``ts`` and the one before.

    __run rises from 1 along (by, order); __first is ``mark`` of the run's first row.  Each range passes on its last row, its number of runs and the mark of its
    open run, so a stream or a run of any length is spread over the ranges that it fills.
    """
    rows = ranged(df, [*by, *order], label)
    local, here = Window.partitionBy(PART).orderBy(AT), F.struct(F.unix_micros(ts).alias("ts"), *by)
    ends = rows.groupBy(PART).agg(F.max_by(here, AT).alias("__last"))
    ends = ends.select(PART, F.lag("__last").over(Window.orderBy(PART)).alias("__link"))  # one row for each range
    before = F.coalesce(F.lag(here).over(local), F.col("__link"))
    seen = rows.join(F.broadcast(ends), PART).withColumn("__before", before).drop("__link")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col("__before")[c])
    new = F.col("__before").isNull() | ~same | (F.unix_micros(ts) - F.col("__before.ts") > micros)
    seen = seen.withColumn("__new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("__mark", F.when(F.col("__new") == 1, F.col(mark))).drop("__before")
    seen = scratch(seen, label)
    totals = seen.groupBy(PART).agg(F.sum("__new").alias("__runs"), F.max_by("__mark", F.when(F.col("__new") == 1, F.col(AT))).alias("__open"))
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(PART, F.coalesce(F.sum("__runs").over(earlier), F.lit(0)).alias("__base"), F.last("__open", True).over(earlier).alias("__held"))
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    out = seen.withColumns({"__n": F.sum("__new").over(upto), "__m": F.last("__mark", True).over(upto)}).join(F.broadcast(carried), PART)
    return out.select(*df.columns, (F.col("__n") + F.col("__base")).alias("__run"), F.coalesce("__m", "__held").alias("__first"))
