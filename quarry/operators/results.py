"""Results of model calls, kept by key: what has been asked once is read and not asked again.

A store is a folder per model.  Every write is a folder of its own below ``writes``, so that writers at the same time lose nothing of each other; tasks hand
their file over as they end, so that a run which dies has what its finished tasks asked.  ``compact`` merges the writes into one table bucketed by
key and records which writes it holds; ``vacuum`` removes what is merged.  A result never changes, so a key that two writers asked at once may be taken from either.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_key
from ..storage import buckets_for, drop_path, scratch
from .common import small
from .plugins import call

#: Calls that one task makes and then hands over, or more where that would be over CORE_TASKS tasks a core: each has its cost, and a file.
TASK_CALLS = 64
CORE_TASKS = 32


def read_or_empty(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """The files below ``path``; none where it isn't there yet."""
    try:
        return spark.read.schema(schema).format(form).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class ResultStore:
    """Results of type (or columns) ``kind`` that ``model`` gave, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, model: str, kind: str):
        name = re.sub("[^A-Za-z0-9]+", "-", model)[:40] + "-" + hashlib.sha256(model.encode()).hexdigest()[:8]
        self.spark, self.root = spark, f"{path.rstrip('/')}/{name}"
        self.kind = T._parse_datatype_string(kind).simpleString()
        self.row = f"key string, result {self.kind}, took_ms bigint"
        self.tables: dict[str, str] = {}

    # -- what is there

    def snapshot(self) -> tuple[str | None, list[str]]:
        """(the merged table's folder, the writes that it holds) of the latest compaction."""
        found = read_or_empty(self.spark, f"{self.root}/snapshots", "n bigint, base string, buckets int, merged array<string>", "json")
        row = found.orderBy(F.desc("n"), F.desc("base")).limit(1).collect()
        if not row:
            return None, []
        self.buckets = row[0].buckets
        return row[0].base, row[0].merged

    def writes(self) -> DataFrame:
        """(key, result, took_ms, write) of every write that isn't removed."""
        return read_or_empty(self.spark, f"{self.root}/writes", f"{self.row}, write string")

    def merged(self, base: str | None) -> DataFrame:
        """The merged table; its rows are bucketed by key, so that joins on the key don't move them."""
        if base is None:
            return self.spark.createDataFrame([], self.row)
        if base not in self.tables:
            name = f"results_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({self.row}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{base}'")
            self.tables[base] = name
        return self.spark.table(self.tables[base])

    def rows(self) -> DataFrame:
        """(key, result, took_ms), one row for each key that has a result."""
        base, merged = self.snapshot()
        later = self.writes().where("result is not null")
        later = later.where(~F.col("write").isin(merged)) if merged else later
        later = later.drop("write").dropDuplicates(["key"])
        if base is None:
            return later
        old = self.merged(base)
        return old.unionByName(later.join(old.select("key"), "key", "left_anti"))

    # -- asking

    def missing(self, keys: DataFrame) -> DataFrame:
        """Distinct keys (key) without a result."""
        return keys.select("key").where("key is not null").distinct().join(self.rows().select("key"), "key", "left_anti")

    def fill(self, items: DataFrame, make: Callable, attempts: int = 2, strict: bool = False) -> int:
        """Ask for those of items (key, text) that have no result; the number of distinct ones asked.  Calls that fail are kept as such, and asked again next time."""
        lacking = scratch(self.missing(items), "results-missing")
        n = lacking.count()
        if n:
            tasks = min(-(-n // TASK_CALLS), CORE_TASKS * self.spark.sparkContext.defaultParallelism)
            texts = items.join(small(lacking), "key", "left_semi").dropDuplicates(["key"]).repartition(tasks, "key")
            asked = call(texts.select("key", "text"), "text", self.kind, make, attempts, timed="took_ms", strict=strict)
            out = asked.select("key", "result", "took_ms").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
            out.parquet(f"{self.root}/writes/write={uuid.uuid4().hex}")
        return n

    def ask(self, df: DataFrame, column: str, make: Callable, key: Column | None = None, timed: str | None = None, attempts: int = 2, strict: bool = False) -> DataFrame:
        """``df`` with ``result``, null where the call failed; only what has no result is asked, once for each key.

        key: by default the hash of the text.  ``df`` is read twice: write it first if it is dear to make.
        """
        keyed = df.withColumn("__key", content_key(F.col(column)) if key is None else key)
        self.fill(keyed.select(F.col("__key").alias("key"), F.col(column).alias("text")), make, attempts, strict)
        rows = self.rows().select(F.col("key").alias("__key"), "result", *([F.col("took_ms").alias(timed)] if timed else []))
        return keyed.join(rows, "__key", "left").drop("__key")

    # -- upkeep

    def compact(self) -> None:
        """Merge all writes so far into a new table; writes that end meanwhile stay as they are, and readers of the old table too."""
        base, _ = self.snapshot()
        held = [r.write for r in self.writes().select("write").distinct().collect()]  # a name for each write
        rows = self.rows()
        n, name = 1 + int(base.split("-")[1] if base else 0), uuid.uuid4().hex
        new, table = f"base-{n}-{name}", f"results_{name}"
        buckets = buckets_for(rows)
        sorted_rows = rows.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key")
        sorted_rows.option("path", f"{self.root}/{new}").saveAsTable(table)
        self.tables[new], self.buckets = table, buckets
        record = self.spark.createDataFrame([(n, new, buckets, held)], "n bigint, base string, buckets int, merged array<string>")
        record.coalesce(1).write.json(f"{self.root}/snapshots/compaction={name}")

    def vacuum(self) -> None:
        """Remove the writes that the latest table holds; call it when no reader has an older one."""
        for write in self.snapshot()[1]:
            drop_path(self.spark, f"{self.root}/writes/write={write}")

    def close(self) -> None:
        """Forget the session's names of the tables; files stay."""
        while self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.popitem()[1]}")


def vector_store(spark: SparkSession, path: str, model: str) -> ResultStore:
    return ResultStore(spark, path, model, "array<float>")
