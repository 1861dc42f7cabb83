"""Size-checked broadcasts and helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scratch

#: Rows up to which a side is broadcast.  Beyond it Spark shuffles both sides.
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; counting stops there."""
    return df.limit(limit + 1).count() <= limit


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small."""
    return F.broadcast(df) if is_small(df, limit) else df


ROWS_AT_ONCE = 512  # of an Arrow batch, for what Python makes of each


def parts_of(batches):
    """Arrow batches in parts of ROWS_AT_ONCE rows: what Python makes of a part doesn't grow with the batches that a task is given."""
    for b in batches:
        for first in range(0, len(b), ROWS_AT_ONCE):
            yield b.slice(first, ROWS_AT_ONCE)


def held(df: DataFrame, label: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, computed once: a local table with a broadcast hint if it is small, else written."""
    rows = df.limit(limit + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= limit else scratch(df, label)


def top_k(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits groups before and after the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    first = df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
    return first.withColumn(rank, F.col(rank).cast("bigint"))


def by_and_total(df: DataFrame, by: str, measures: list) -> DataFrame:
    """Measures of each value of ``by`` and of all rows (``by`` is null), in one aggregation; all of no rows are zeros."""
    sets = df.groupingSets([[by], []], by).agg(*measures)
    total = df.sparkSession.range(1).select(F.lit(None).cast(df.schema[by].dataType).alias("__total"))
    both = sets.join(total, sets[by].eqNullSafe(total["__total"]), "full_outer")
    return both.select(by, *[F.coalesce(c, F.lit(0).cast(sets.schema[c].dataType)).alias(c) for c in sets.columns if c != by])
