"""Shared helpers: table access, and intermediate tables from the engine's storage."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import (  # noqa: F401
    broadcast,
    buckets_for,
    drop_path,
    input_bytes,
    mark,
    new_scratch_path,
    new_table,
    release,
    scratch,
    scratch_at,
    shared_dir,
)

#: The six ASCII white-space characters that separate words and are stripped from line keys.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory, by a path only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; for short strings such as host names."""
    return F.translate(c, UPPER, LOWER)


def executor_env() -> None:
    """Keep native libraries in Python workers to one thread each: tasks are the parallelism."""
    for k in ("OMP_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(k, "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
