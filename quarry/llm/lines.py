"""Operator 2 - line dedup with levelled sorted runs of line hashes.

Line keys are hashed to 128 bits.  ``LineStore`` keeps, in the shared folder, sorted runs
(key hash -> owner) in levels, like a log-structured merge tree.  A new batch's keys are exchanged
and sorted once, by their own aggregation, and merge with every run in place.  That one merge gives both
results: keys that a run holds, or that several documents of the batch have, are the verdict (``add`` returns the
documents that lose their lines of such a key), and keys that no run holds, the merge-anti-join, become a run of level 0.
When a level has ``fanout`` runs they are compacted into one run of the next level, bucket by bucket and without an
exchange, so a key is rewritten once per level and a batch reads O(log batches) runs.  Runs are
tables bucketed by the hash and sorted in each bucket.

``dedup_lines`` runs a whole table through a store in batches of ascending id, which makes
the owner of a key the smallest id that holds it: other documents lose all their lines of
that key, the owner keeps all of its own.  A store whose batches come in another order leaves a key to the batch that
brought it first, and in it to the smallest id.

Defined results: a null or empty text is one empty line; lines whose key has under
``min_chars`` code points always stay; of rows with one id the lines count as one document's;
a null id sorts before all others; an empty table gives an empty table; extra columns pass
through, and only the names in ``OUTPUT`` are replaced.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, new_scratch_path, new_table, scratch, scratch_at, table
from .vectext import text_bytes

MIN_CHARS = 10
SPACE = b" \t\n\x0b\x0c\r"
OUTPUT = ("n_lines", "n_dropped", "words_left", "words_lost", "kept_text")
NULL_ID = -(1 << 63)


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes.lower() changes A-Z only


def long_enough(key: bytes, min_chars: int) -> bool:
    n = len(key)
    return n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def key_halves(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def line_hashes(min_chars: int):
    """Arrow map: (id, text) to one row per distinct key of a document."""

    def run(batches):
        for b in batches:
            ids, digests = [], []
            for i, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                keys = {k for k in map(line_key, text.split(b"\n")) if long_enough(k, min_chars)}
                ids += [NULL_ID if i is None else i] * len(keys)
                digests += map(key_halves, keys)
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["id", "h1", "h2"])

    return run


#: Up to so many keys of a verdict (24 bytes each) are broadcast to a batch's lines; more are joined by a shuffle.
BROADCAST_KEYS = 200_000


class LineStore:
    """Levelled sorted runs of (h1, h2, owner)."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int = 16):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[tuple[str, str]]] = []  # (table, path) of each run

    def runs(self) -> list[DataFrame]:
        """(h1, h2, owner) of every run, the largest first; a key is in one of them only."""
        return [self._run(name) for level in reversed(self.levels) for name, _ in level]

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).where("fresh").select("h1", "h2", "owner")

    def _write(self, df: DataFrame, label: str) -> tuple[str, str]:
        """One file a bucket, by its place in the order of the key; df's own exchange makes a partition of each bucket."""
        path = new_scratch_path(self.spark, f"lines-{label}")
        name = new_table(path)
        with sorted_runs(self.spark, self.buckets):
            if int(self.spark.conf.get(PARTITIONS)) != self.buckets:
                df = df.repartition(self.buckets, "h1", "h2")
            df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name, path

    def _put(self, level: int, run: tuple[str, str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def add(self, batch: DataFrame) -> DataFrame:
        """batch: (id, h1, h2), a row for each key of a document.  Gives (id, h1, h2, owner) of the keys that documents lose."""
        self.compact()
        merged = batch.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        owners = []
        for i, run in enumerate(self.runs()):
            merged = merged.join(run.withColumnRenamed("owner", f"owner{i}").hint("merge"), ["h1", "h2"], "left")
            owners.append(F.col(f"owner{i}"))
        held = F.coalesce(*owners) if owners else F.lit(None).cast("long")
        owner = F.coalesce(held, "first")
        lost = (F.col("first") != owner) | (F.col("last") != owner)
        merged = merged.select("h1", "h2", owner.alias("owner"), held.isNull().alias("fresh"), lost.alias("lost"))
        self._put(0, self._write(merged, "run"))
        verdict = self.spark.table(self.levels[0][-1][0]).where("lost").select("h1", "h2", "owner")
        small = verdict.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        # A hot key's lines stay where they are, or meet it in a merge join that adaptive execution can split.
        out = batch.join(F.broadcast(verdict) if small else verdict.hint("merge"), ["h1", "h2"]).where("id <> owner")
        return scratch(out.select("id", "h1", "h2", "owner"), "lines-lost")

    def compact(self) -> None:
        """Levels of ``fanout`` runs become one run of the next level, merged two at a time, bucket by bucket."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                (one, *others), self.levels[level] = self.levels[level], []
                for other in others:
                    both = self._run(one[0]).withColumnRenamed("owner", "owner1").join(
                        self._run(other[0]).withColumnRenamed("owner", "owner2").hint("merge"), ["h1", "h2"], "full_outer"
                    )
                    merged = self._write(both.select("h1", "h2", F.coalesce("owner1", "owner2").alias("owner"), F.lit(True).alias("fresh")), f"run{level + 1}")
                    drop_path(self.spark, one[1])
                    drop_path(self.spark, other[1])
                    one = merged
                self._put(level + 1, one)
            level += 1

    def close(self) -> None:
        """Drop all runs."""
        for level in self.levels:
            for _, path in level:
                drop_path(self.spark, path)
        self.levels = []


#: Inside a merge, plans read runs bucket by bucket and trust the order of their files (one a bucket).
IN_PLACE = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def sorted_runs(spark: SparkSession, partitions: int | None = None):
    """Plans that are made inside neither exchange the runs nor sort them again; exchanges have as many partitions as runs have buckets."""
    wanted = IN_PLACE | ({PARTITIONS: str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def gone_sets(column) -> list[set | None]:
    """Per row the digests of a list<struct<h1, h2>> column."""
    values = column.flatten()
    flat = np.stack([values.field(0).to_numpy(zero_copy_only=False), values.field(1).to_numpy(zero_copy_only=False)], axis=1)
    raw, at, out = flat.astype("<i8").tobytes(), 0, []
    for n in pc.fill_null(pc.list_value_length(column), 0).to_pylist():
        out.append({raw[i : i + 16] for i in range(16 * at, 16 * (at + n), 16)} if n else None)
        at += n
    return out


def drop_lines(min_chars: int):
    """Arrow map: (..., __text, __gone) to the text without the lines whose digest is in __gone."""

    def run(batches):
        for b in batches:
            at, gone_at = b.schema.get_field_index("__text"), b.schema.get_field_index("__gone")
            rows = []
            for text, drop in zip(text_bytes(b.column(at)), gone_sets(b.column(gone_at)), strict=True):
                lines = text.split(b"\n")
                left, gone = lines, 0
                if drop:
                    left = [x for x in lines if not (long_enough(k := line_key(x), min_chars) and key_halves(k) in drop)]
                    gone = len(text.split())
                out = b"\n".join(left) if drop else text
                words = len(out.split()) if drop else None
                rows.append((len(lines), len(lines) - len(left), words, gone - (words or 0), out, hashlib.sha256(out).hexdigest()))
            n_lines, n_dropped, words, lost, kept, shas = zip(*rows, strict=True) if rows else [()] * 6
            keep = [i for i in range(b.num_columns) if i not in (at, gone_at)]
            new = [pa.array(x, pa.int64()) for x in (n_lines, n_dropped, words, lost)] + [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + new, [b.schema.field(i).name for i in keep] + [*OUTPUT, "kept_sha256"])

    return run


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """``docs`` with n_lines, n_dropped, words_left, words_lost, kept_text and kept_sha256 instead of its text.

    words_left is null where no line was dropped.  batches: how many ascending id ranges go through the store one after another.
    """
    spark = docs.sparkSession
    docs = docs.drop(*OUTPUT, "kept_sha256", "__text", "__gone", "__id")
    hashed = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(line_hashes(min_chars), "id long, h1 long, h2 long")
    path = new_scratch_path(spark, "lines-hashes")
    hashed = scratch_at(hashed, path)  # 24 bytes a line; texts are read once more, at the end
    cuts = hashed.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    with sorted_runs(spark, max(4, int(spark.conf.get(PARTITIONS)) // 4)):  # keys are a fraction of the texts
        buckets = int(spark.conf.get(PARTITIONS))  # a session may hold on to its number
    store = LineStore(spark, fanout, buckets)
    lost = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = hashed
        if low is not None:
            part = part.where(F.col("id") > low)
        if high is not None:
            part = part.where(F.col("id") <= high)
        out = store.add(part)
        lost = out if lost is None else lost.unionByName(out)
    store.close()
    drop_path(spark, path)
    lost = lost.groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct("h1", "h2")).alias("__gone"))  # at most a document's own lines
    rest = [c for c in docs.columns if c != text_col]
    joined = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).alias("__text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__id"))
    joined = joined.join(lost, "__id", "left").drop("__id")
    long = [T.StructField(n, T.LongType()) for n in OUTPUT[:4]]
    schema = T.StructType([*(docs.schema[c] for c in rest), *long, T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    return joined.mapInArrow(drop_lines(min_chars), schema)


def op2_line_dedup(spark, sf_dir):
    """Digest of the line dedup of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1
), j AS (
  SELECT k.doc_id, pos, line, (owner IS NOT NULL AND owner <> k.doc_id) AS dropped
  FROM k LEFT JOIN o USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
