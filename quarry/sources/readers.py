"""Readers.  Paths may be anything Spark's readers take; nothing is opened on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import rolled_date
from ..functions.rank import normalise_expected
from ..functions.text import is_noise, strip
from . import splits
from .schemas import CASE, CHUNK, EMBEDDING, EVENT, LOG  # noqa: F401


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped.  Not strict: bad lines stay, in ``_corrupt``."""
    reader = spark.read.schema(schema if strict else schema + ", _corrupt string")
    return reader.option("mode", "FAILFAST").json(path) if strict else reader.option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_located_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their file and line (from 1); blank lines are skipped.  Files are read in splits."""
    lines = splits.numbered_lines(spark, path).where(F.col("value").rlike(r"\S"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("c"), "file", "line").select("c.*", "file", "line")


def read_ordered_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with corpus_ord: (file name, line) in order, as one sortable number per row."""
    lines = read_located_jsonl(spark, path, schema)
    rank = lines.select("file").distinct().select("file", F.row_number().over(_by("file")).alias("n"))  # a row for each file
    return lines.join(rank, "file").withColumn("corpus_ord", F.col("n") * 2**32 + F.col("line") - 1).drop("file", "line")


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


def indexable(chunks: DataFrame) -> DataFrame:
    """Help-channel chunks only when approved; every other source always."""
    return chunks.where((F.col("source_type") != "help_channel") | (F.coalesce("status", F.lit("")) == "approved"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Indexable chunks of a folder of JSON lines; see operators.validate for the checks."""
    return indexable(read_jsonl(spark, path, CHUNK))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases with expected_chunk_ids as array<array<string>>."""
    return read_jsonl(spark, path, CASE).withColumn("expected_chunk_ids", normalise_expected(F.col("expected_chunk_ids")))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Chat events from files of one JSON array each, cleaned; a large file is read by many tasks."""
    events = splits.array_elements(spark, path).select(F.from_json("json", EVENT, {"mode": "FAILFAST"}).alias("e"))
    return clean_events(events.select("e.*"))


def read_event_export(spark: SparkSession, path: str) -> DataFrame:
    """As read_events, for exports with a header object around the array; a file is one task."""
    fields = ", ".join(f"{f.split(' ', 1)[0]}: {f.split(' ', 1)[1]}" for f in EVENT.split(", "))
    whole = spark.read.schema(f"events array<struct<{fields}>>").option("multiLine", True).json(path)
    return clean_events(whole.select(F.inline("events")))


def clean_events(events: DataFrame) -> DataFrame:
    """Without deleted, bot, blank, noise and command messages."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    body = strip(F.col("text"))
    return events.where(~flag("deleted") & ~flag("isBot") & (F.coalesce(body, F.lit("")) != "") & ~is_noise(F.col("text")) & ~body.startswith("/"))


def read_decisions(spark: SparkSession, approved: str | None, rejected: str | None) -> tuple[DataFrame, DataFrame]:
    """(approved ids, rejected ids); None is an empty store.  A rejection line starts with its id."""
    empty = spark.createDataFrame([], "id string")
    yes = read_jsonl(spark, approved, CHUNK).select("id").distinct() if approved else empty
    no = spark.read.text(rejected).select(F.split(F.trim("value"), r"\s+")[0].alias("id")).where("id <> ''").distinct() if rejected else empty
    return yes, no


def read_embeddings(spark: SparkSession, path: str, model: str) -> DataFrame:
    return spark.read.schema(EMBEDDING).parquet(path).where(F.col("model") == model)


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, LOG, strict=False)


def question_keys(source: DataFrame) -> DataFrame:
    """(position, key) of the quoted entries of an ``allQuestions = [...]`` block; source has one text ``value``."""
    block = F.regexp_extract("value", r"(?s)allQuestions\s*=\s*\[(.*?)\]", 1)
    return source.select(F.posexplode(F.regexp_extract_all(block, F.lit('"([^"]+)"'), F.lit(1))).alias("position", "key"))


def faq_pairs(keys: DataFrame, strings: DataFrame) -> DataFrame:
    """Keys with the strings <key>_q and <key>_a (columns name, value); either missing or empty skips the key."""
    side = lambda s: strings.select(F.col("name").alias(f"n{s}"), F.col("value").alias(s))
    out = keys.join(side("q"), F.concat("key", F.lit("_q")) == F.col("nq")).join(side("a"), F.concat("key", F.lit("_a")) == F.col("na"))
    return out.where("q <> '' and a <> ''").select("position", "key", F.col("q").alias("question"), F.col("a").alias("answer"))


#: Fixed patterns of an article registry: its imports and its entries.
IMPORT = r'import\s+(\w+)\s+from\s+"\./(\w+)\.svelte"'
ENTRY = (
    r'(?s)slug:\s*"([^"]+)",\s*title:\s*"((?:[^"\\]|\\.)*)",\s*author:\s*"([^"]*)",\s*'
    r"date:\s*new Date\((\d+),\s*(\d+),\s*(\d+)\),\s*component:\s*(\w+),"
)


def article_registry(source: DataFrame) -> DataFrame:
    """slug, title, author, date, file of the entries of an article registry whose component is imported.

    source has one text ``value``.  Months are zero-based and dates roll over.
    """
    all_of = lambda p, i: F.regexp_extract_all("value", F.lit(p), F.lit(i))
    known = source.select(F.explode(F.arrays_zip(all_of(IMPORT, 1).alias("component"), all_of(IMPORT, 2).alias("file"))).alias("i")).select("i.*")
    names = ("slug", "title", "author", "y", "m", "d", "component")
    zipped = F.arrays_zip(*[all_of(ENTRY, i).alias(n) for i, n in enumerate(names, 1)])
    entries = source.select(F.posexplode(zipped).alias("position", "e")).select("position", "e.*")
    date = rolled_date(F.col("y").cast("int"), F.col("m").cast("int"), F.col("d").cast("int"))
    return entries.join(known, "component").select("position", "slug", F.replace("title", F.lit('\\"'), F.lit('"')).alias("title"), "author", date.alias("date"), "file")


def missing_components(source: DataFrame) -> DataFrame:
    """(slug, component) of registry entries whose component no import names: they are left out of article_registry."""
    all_of = lambda p, i: F.regexp_extract_all("value", F.lit(p), F.lit(i))
    known = source.select(F.explode(all_of(IMPORT, 1)).alias("component"))
    return source.select(F.inline(F.arrays_zip(all_of(ENTRY, 1).alias("slug"), all_of(ENTRY, 7).alias("component")))).join(known, "component", "left_anti").select("slug", "component")


def repository_state(path: str) -> dict[str, str | None]:
    """Commit and its time of a checkout, for provenance; nothing where there is none."""
    import subprocess

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, check=True, timeout=30).stdout.strip() or None
        except (OSError, subprocess.SubprocessError):
            return None

    return {"commit": git("rev-parse", "HEAD"), "committed_at": git("log", "-1", "--format=%cI")}
