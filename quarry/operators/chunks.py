"""Chunks out of parsed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.chunking import merge_short, split_clauses, split_paragraphs, split_prose
from ..functions.text import breadcrumb, content_key, inline_links, inline_markdown, slug
from ..storage import broadcast
from .common import parts_of
from .ordered import numbered


def _map_rows(df: DataFrame, key: str, source: str, schema: str, rows) -> DataFrame:
    """One call of rows(html) per row; (key, position, *columns of schema)."""
    names = ["position", *(f.split()[0] for f in schema.split(", "))]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [(k, i, *r) for k, s in zip(pdf[key], pdf[source], strict=True) for i, r in enumerate(rows(s or ""))]
            yield pd.DataFrame(out, columns=[key, *names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, source).mapInPandas(run, f"{key} {kind}, position int, {schema}")


def article_sections(df: DataFrame, key: str = "slug", source: str = "source", base_url: str = "") -> DataFrame:
    return _map_rows(df, key, source, "heading string, subheading string, text string", lambda s: markup.article_sections(markup.plain_components(s, base_url), base_url))


def rendered(df: DataFrame, key: str, source: str = "html", base_url: str = "") -> DataFrame:
    """(key, position 0, text): whole documents as markdown-like text."""
    return _map_rows(df, key, source, "text string", lambda s: [(markup.to_markdown(markup.plain_components(s, base_url), base_url),)])


def card_sections(df: DataFrame, key: str = "path", source: str = "source", base_url: str = "") -> DataFrame:
    return _map_rows(df, key, source, "number string, title string, text string", lambda s: markup.card_sections(markup.plain_components(s, base_url), base_url))


def clause_sections(df: DataFrame, key: str = "path", source: str = "source", base_url: str = "", least: int = 40) -> DataFrame:
    kind = "section_id string, section_title string, clause_group string, text string"
    return _map_rows(df, key, source, kind, lambda s: markup.clause_sections(markup.plain_components(s, base_url), base_url=base_url, least=least))


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("content_hash", content_key(F.col("text")))


def faq_chunks(pairs: DataFrame, base_url: str) -> DataFrame:
    """pairs: position, key, question, answer (with inline HTML)."""
    q, a = inline_markdown(F.col("question")), inline_markdown(F.col("answer"))
    links = F.concat(inline_links(F.col("question")), inline_links(F.col("answer")))
    return _finish(
        pairs.select(
            F.concat(F.lit("faq:"), "key").alias("id"),
            F.lit("faq").alias("source_type"),
            q.alias("title"),
            F.concat(q, F.lit("\n\n"), a).alias("text"),
            F.concat(F.lit(base_url + "?q="), "key").alias("url"),
            F.struct(F.col("key").alias("faq_key"), "position", q.alias("question"), a.alias("answer"), links.alias("links"), F.length(a).alias("char_count")).alias("meta"),
        )
    )


def article_chunks(posts: DataFrame, sections: DataFrame, base_url: str, limit: int = 1500, least: int = 250) -> DataFrame:
    """posts: slug, title, author, date; sections: slug, position, heading, subheading, text."""
    rows = F.array_sort(F.collect_list(F.struct("position", "heading", "subheading", "text")))
    merged = sections.groupBy("slug").agg(merge_short(rows, least).alias("s")).select("slug", F.posexplode("s").alias("section_no", "s"))
    parts = merged.select("slug", "section_no", "s.heading", "s.subheading", F.posexplode(split_prose(F.col("s.text"), limit)).alias("part", "body"))
    crumb = breadcrumb(F.col("title"), F.col("heading"), F.col("subheading"))
    suffix = F.when(F.col("part") > 0, F.concat(F.lit("."), "part")).otherwise("")
    out = parts.join(posts, "slug").select(
        F.concat(F.lit("blog:"), "slug", F.lit(":"), "section_no", suffix).alias("id"),
        F.lit("blog").alias("source_type"),
        crumb.alias("title"),
        F.concat(crumb, F.lit("\n\n"), "body").alias("text"),
        F.concat(F.lit(base_url + "/"), "slug").alias("url"),
        F.struct(
            "slug", F.col("title").alias("post_title"), F.col("heading").alias("section_heading"), F.col("subheading").alias("section_subheading"),
            F.col("section_no").alias("section_index"), "part", "author", F.col("date").cast("string").alias("published"), F.length("body").alias("char_count"),
        ).alias("meta"),
    )
    return _finish(out)


def by_date(chunks: DataFrame, posts: DataFrame, place: str | None = None) -> DataFrame:
    """Article chunks in the order of their posts: the latest first, posts of one day as the registry has them.

    place: a column for the number in that order, from 1; the rows then come in any order.
    """
    by = posts.select(F.col("slug").alias("__slug"), F.col("date").alias("__date"), F.col("position").alias("__position"))
    joined = chunks.join(by, F.col("meta.slug") == F.col("__slug"))
    order = [F.desc("__date"), F.col("__position"), F.col("meta.section_index"), F.col("meta.part")]
    if place:
        return numbered(joined, order, place, "by-date").select(*chunks.columns, place)
    return joined.orderBy(*order).select(*chunks.columns)


def guideline_chunks(cards: DataFrame, base_url: str, root: str = "Guidelines", limit: int = 1500) -> DataFrame:
    """cards: number, title, text.  Ids have a part suffix, from 0, where a card has several parts."""
    parts = cards.withColumn("parts", split_paragraphs(F.col("text"), limit))
    rows = parts.select("number", "title", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "body"))
    crumb = F.concat(F.lit(root + " > "), "number", F.lit(". "), "title")
    text = F.concat(crumb, F.lit("\n\n"), "body")
    suffix = F.when(F.col("n") > 1, F.concat(F.lit("."), "part")).otherwise("")
    return _finish(
        rows.select(
            F.concat(F.lit("guidelines:"), "number", suffix).alias("id"),
            F.lit("guidelines").alias("source_type"),
            crumb.alias("title"),
            text.alias("text"),
            F.concat(F.lit(base_url + "?section="), "number").alias("url"),
            F.struct(F.col("number").cast("int").alias("section_number"), F.col("title").alias("section_title"), "part", F.length(text).alias("char_count")).alias("meta"),
        )
    )


def terms_chunks(clauses: DataFrame, base_url: str, root: str = "Terms of use", limit: int = 2000) -> DataFrame:
    """clauses: section_id, section_title, clause_group, text."""
    rows = clauses.select("section_id", "section_title", "clause_group", F.posexplode(split_clauses(F.col("text"), limit)).alias("part", "body"))
    crumb = breadcrumb(F.lit(root), F.col("section_title"), F.col("clause_group"))
    text = F.concat(crumb, F.lit("\n\n"), "body")
    suffix = F.when(F.col("part") > 0, F.concat(F.lit("."), "part")).otherwise("")
    name = slug(F.coalesce(F.nullif("clause_group", F.lit("")), F.lit("intro")), 40, None)
    return _finish(
        rows.select(
            F.concat(F.lit("terms:"), "section_id", F.lit(":"), name, suffix).alias("id"),
            F.lit("terms").alias("source_type"),
            crumb.alias("title"),
            text.alias("text"),
            F.concat(F.lit(base_url + "?section="), "section_id").alias("url"),
            F.struct(F.col("section_id").cast("int").alias("section_id"), "section_title", "clause_group", "part", F.length(text).alias("char_count")).alias("meta"),
        )
    )


#: Items that are looked for in every chunk at once.
HELD_ITEMS, HELD_WORDS = 200_000, 4


def holders(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """(id, item_id) of chunks (id, text) whose text holds an item's (item_id, item) as it stands.

    The second to fifth word of an item are looked up among the chunk's words, and what is met is compared in full.
    Shorter items are compared with every chunk.  Items are broadcast; more than HELD_ITEMS are an error.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = items.where("item is not null").limit(HELD_ITEMS + 1).collect()
    if len(rows) > HELD_ITEMS:
        raise ValueError(f"over {HELD_ITEMS} items: look for them in parts")
    known: dict[tuple, list] = {}
    short = []
    for r in rows:
        words = r["item"].split()
        place = known.setdefault(tuple(words[1 : 1 + HELD_WORDS]), []) if len(words) > HELD_WORDS + 1 else short
        place.append((r["item_id"], r["item"]))
    shared = broadcast(chunks.sparkSession, (known, short))
    kinds = chunks.schema["id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()

    kind = to_arrow_type(items.schema["item_id"].dataType)

    def run(batches):
        import pyarrow as pa

        known, short = shared.value
        for b in parts_of(batches):
            places, found = [], []
            for place, text in enumerate(b.column(1)):
                text = text.as_py() or ""
                words = text.split()
                met = {key for key in zip(*(words[j:] for j in range(HELD_WORDS)), strict=False) if key in known}
                mine = [item_id for key in met for item_id, item in known[key] if item in text]
                mine += [item_id for item_id, item in short if item in text]
                places += [place] * len(mine)
                found += mine
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places, pa.int64())), pa.array(found, kind)], ["id", "item_id"])

    return chunks.select("id", "text").mapInArrow(run, f"id {kinds[0]}, item_id {kinds[1]}")


def size_stats(chunks: DataFrame, by: str, text: str = "text") -> DataFrame:
    n = F.length(text)
    return chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.min(n).cast("bigint").alias("min_chars"), F.max(n).cast("bigint").alias("max_chars"), F.floor(F.avg(n)).cast("bigint").alias("mean_chars"))
