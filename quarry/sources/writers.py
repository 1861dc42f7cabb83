"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_chunks(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines without null fields, as the readers take them."""
    write_jsonl(df, path, append)


def append_rejections(ids: DataFrame, path: str, at: str) -> None:
    """One text line per id: the id and the time of the decision."""
    from pyspark.sql import functions as F

    ids.select(F.concat_ws(" ", "id", F.lit(at)).alias("value")).write.mode("append").text(path)


def append_embeddings(df: DataFrame, path: str) -> None:
    """Only new vectors are written, so concurrent writers don't lose each other's."""
    df.select("model", "key", "embedding").write.mode("append").parquet(path)


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """Every section of a report as a folder of JSON lines under ``path``."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def append_log(records: DataFrame, path: str) -> None:
    """Request-log records as JSON lines, as read_request_log and read_log_stream take them."""
    from .schemas import LOG

    names = [f.split()[0] for f in LOG.split(", ")]
    records.select(*names).write.mode("append").json(path)
