"""Intermediate tables in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a single machine (tests) a temporary folder stands in where the session has none; a
    cluster without that setting is an error, as executors would not see the driver's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quarry-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_serial = itertools.count()
_live: dict[str, int] = {}  # paths that this driver wrote, with their order
_broadcasts: list = []
_tables: dict[str, str] = {}  # catalogue tables over such paths


def new_scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/quarry/{label}-{uuid.uuid4().hex}"
    _live[path] = next(_serial)
    return path


def new_table(path: str) -> str:
    """A name for a catalogue table whose files stand at a scratch path."""
    name = "quarry_run_" + path.rsplit("-", 1)[1]
    _tables[path] = name
    return name


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage with files every executor can reread, so a lost executor costs a
    reread and not a recomputation.
    """
    return scratch_at(df, new_scratch_path(df.sparkSession, label))


def scratch_at(df: DataFrame, path: str) -> DataFrame:
    """As scratch, at a path that the caller may drop."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of stored input that one bucket of an array exchange may stand for; its task holds a small multiple in memory.
BUCKET_BYTES = 128 << 20


UNKNOWN_BYTES = 1 << 60  # Spark's stand-in for leaves without statistics is above it


def input_bytes(df: DataFrame) -> int:
    """Bytes that the plan's leaves hold, from the files' sizes alone: nothing is read.  Leaves of unknown size don't count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < UNKNOWN_BYTES)


def buckets_for(df: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """spark.sql.shuffle.partitions, or more where these would be too few for the input's size."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // bucket_bytes))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one scratch path, and the table over it, through Hadoop's file system layer."""
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")  # an external table: its files stay
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _live.pop(path, None)


def broadcast(spark: SparkSession, value):
    """A broadcast variable whose copies on executors go with release."""
    out = spark.sparkContext.broadcast(value)
    _broadcasts.append(out)
    return out


def mark() -> int:
    """A point in time for release: what is written from now on."""
    return next(_serial)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> int:
    """Delete what this driver wrote since a mark, but for ``keep``; call once results are written."""
    paths = [p for p, n in _live.items() if n >= since and p not in keep]
    for path in paths:
        drop_path(spark, path)
    while _broadcasts:
        _broadcasts.pop().unpersist()  # a plan that still needs one fetches it again
    return len(paths)
