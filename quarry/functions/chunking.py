"""Greedy packing folds that split long texts and merge short sections.

Every fold is one ``aggregate`` over the pieces of a row, so it runs where the row is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_STATE = "struct<done:array<string>,cur:string>"


def pack(pieces: Column, joiner: str, limit: int) -> Column:
    """Join consecutive pieces while they fit ``limit`` characters; results are stripped, empty ones dropped."""
    gap = len(joiner)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(s: Column, p: Column) -> Column:
        full = (s["cur"] != "") & (F.length(s["cur"]) + F.length(p) + gap > limit)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(strip(s["cur"])))).otherwise(s["done"]).alias("done"),
            F.when(full | (s["cur"] == ""), p).otherwise(F.concat(s["cur"], F.lit(joiner), p)).alias("cur"),
        )

    packed = F.aggregate(pieces, start, step, lambda s: F.concat(s["done"], F.array(strip(s["cur"]))))
    return F.filter(packed, lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])(?U)\s+")


def split_prose(text: Column, limit: int = 1500) -> Column:
    """Paragraph packing; a part that is still too long is packed by sentences."""
    parts = pack(F.split(text, "\n\n"), "\n\n", limit)
    fine = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(pack(sentences(p), " ", limit))))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(fine)


def split_paragraphs(text: Column, limit: int = 1500) -> Column:
    """Paragraph packing only."""
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(pack(F.split(text, "\n\n"), "\n\n", limit))


def split_clauses(text: Column, limit: int = 2000) -> Column:
    """Line packing."""
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(pack(F.split(text, "\n"), "\n", limit))


_SECTION = "struct<heading:string,subheading:string,text:string>"


def merge_short(sections: Column, least: int = 250) -> Column:
    """array<struct<heading,subheading,text>>: a section joins the one before while that is under ``least``.

    Sections without text go; headings that the earlier one lacks are taken over.
    """
    full = F.filter(sections, lambda s: F.coalesce(s["text"], F.lit("")) != "")
    start = F.array().cast(f"array<{_SECTION}>")

    def some(a: Column, b: Column) -> Column:
        return F.coalesce(F.nullif(a, F.lit("")), b)

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(
            some(last["heading"], s["heading"]).alias("heading"),
            some(last["subheading"], s["subheading"]).alias("subheading"),
            strip(F.concat(last["text"], F.lit("\n\n"), s["text"])).alias("text"),
        )
        own = F.struct(s["heading"].alias("heading"), s["subheading"].alias("subheading"), s["text"].alias("text"))
        short = F.length(last["text"]) < least
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(F.size(done) == 0, F.array(own)).when(short, F.concat(head, F.array(joined))).otherwise(F.concat(done, F.array(own)))

    return F.aggregate(full, start, step)
