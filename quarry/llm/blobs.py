"""Shuffles of numpy arrays: rows of (bucket, one binary per array) instead of a row per value.

A mapper deals its values out to buckets and sends each bucket's slices as binaries; after
``exchange`` the receiver joins the slices of its partition again.  Every value
costs its own bytes and no row overhead.  Partitions, and with them a task's memory, shrink
with the number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def schema_of(arrays: int) -> str:
    return ", ".join(["bucket int", *(f"a{i} binary" for i in range(arrays))])


def deal(bucket: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket that has values."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edge, length = runs(bucket)
    stop = edge + length
    columns = [pa.array(bucket[edge].astype(np.int32))]
    for a in arrays:
        a = np.ascontiguousarray(a[order])
        columns.append(pa.array([a[i:j].tobytes() for i, j in zip(edge, stop, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["bucket", *(f"a{i}" for i in range(len(arrays)))])


def deal_owned(bucket: np.ndarray, owner: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """deal() with the owners as runs: values of one owner must be adjacent.

    The first two arrays of the rows are owner ids and run lengths, so an owner's id is sent once for
    each bucket and not with every value.
    """
    order = np.argsort(bucket, kind="stable")
    bucket, owner = bucket[order], owner[order]
    new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1]))) if len(bucket) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    length = np.diff(at, append=len(bucket)).astype("<u4")
    heads = deal(bucket[at], [owner[at].astype("<i8"), length])
    values = deal(bucket, [a[order] for a in arrays])
    columns = [*heads.columns, *values.columns[1:]]
    return pa.RecordBatch.from_arrays(columns, ["bucket", *(f"a{i}" for i in range(len(columns) - 1))])


def gather(batches: Iterator[pa.RecordBatch], dtypes: list[str]) -> list[np.ndarray]:
    parts: list[list[bytes]] = [[] for _ in dtypes]
    for b in batches:
        for i in range(len(dtypes)):
            parts[i] += b.column(i + 1).to_pylist()
    return [np.frombuffer(b"".join(p), dtype=t) for p, t in zip(parts, dtypes, strict=True)]


def exchange(df: DataFrame, partitions: int) -> DataFrame:
    """Rows to the partition their bucket names, so that buckets fill partitions evenly."""
    return df.repartitionById(partitions, "bucket")


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values of a sorted array."""
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return start, np.diff(start, append=len(keys)) if len(keys) else start
