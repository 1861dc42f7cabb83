"""The queries of the engine's own operators over the driver's tables, each with its SQL.

documents are chunks (doc_id, source, text, no title), benchmark items are questions, labels stand
for approvals and grades, conversations and events for chats, embeddings for vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking, dates, text
from ..operators import answers, chunks, metrics, retrieve, review, threads, validate
from ..operators.common import top_k
from ..operators.postings import PostingIndex
from ..operators.vectors import VectorIndex
from ..storage import new_scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that is read in fewer tasks than there are cores over all cores: tokenising costs more than moving so little text.

    Larger tables are read in more tasks and stay where they are.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def as_chunks(spark, sf) -> DataFrame:
    return spread(t(spark, sf, "documents")).select(F.col("doc_id").alias("id"), F.col("source").alias("source_type"), F.lit("").alias("title"), "text")


def as_questions(spark, sf) -> DataFrame:
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


# --- chunks ---------------------------------------------------------------------------------


@query("chunk_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.content_key(F.col("text")).alias("content_hash"))


@query(
    "hash_dedupe",
    """SELECT substr(sha256(text), 1, 16) AS content_hash, count(*) AS copies, min(doc_id) AS first_id
       FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def _(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", text.content_key(F.col("text")).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query(
    "indexable_docs",
    """SELECT d.doc_id, (CASE WHEN source IN ('src0', 'src1') THEN coalesce(quality, 0) = 1 ELSE true END) AS indexable
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def _(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    gated = F.col("source").isin("src0", "src1")
    return d.select("doc_id", F.when(gated, F.coalesce("quality", F.lit(0)) == 1).otherwise(True).alias("indexable"))


@query("unlabelled_docs", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels"), "doc_id", "left_anti")


@query("labelled_docs", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels"), "doc_id", "left_semi")


@query("corpus_by_source", "SELECT source, count(*) AS chunks FROM documents GROUP BY source")
def _(spark, sf):
    return t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("chunks"))


@query(
    "size_stats",
    """SELECT lang, count(*) AS chunks, min(length(text)) AS min_chars, max(length(text)) AS max_chars,
              CAST(floor(avg(length(text))) AS BIGINT) AS mean_chars FROM documents GROUP BY lang""",
)
def _(spark, sf):
    return chunks.size_stats(t(spark, sf, "documents"), "lang")


@query(
    "chunk_violations",
    """SELECT doc_id AS id, 'text' AS problem FROM documents WHERE coalesce(text, '') = ''
       UNION ALL SELECT doc_id, 'source_type' FROM documents WHERE source <> 'src0'""",
)
def _(spark, sf):
    d = t(spark, sf, "documents")
    rows = d.select(
        F.col("doc_id").alias("id"), F.when(F.col("source") == "src0", "faq").otherwise(F.col("source")).alias("source_type"), "text",
        F.lit("u").alias("url"), text.content_key(F.col("text")).alias("content_hash"),
    ).withColumn("id", F.col("id").cast("string"))
    return validate.chunk_violations(rows).withColumn("id", F.col("id").cast("bigint"))


@query("duplicate_ids", "SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return validate.duplicate_ids(t(spark, sf, "orders"), "o_custkey")


# --- text -----------------------------------------------------------------------------------


@query(
    "tokens_count",
    """SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens,
              len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_terms FROM documents""",
)
def _(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", F.size(text.tokens(F.col("text"))).cast("bigint").alias("n_tokens"), F.size(text.token_set(F.col("text"))).cast("bigint").alias("n_terms"))


_POSTINGS = """WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
  post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
  dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents),
  cs AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
  ts AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  idf AS (SELECT term, df, greatest(0, ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM ts, cs)"""


@query("term_df_idf", _POSTINGS + " SELECT term, df, round(idf, 6) AS idf FROM idf")
def _(spark, sf):
    c = as_chunks(spark, sf)
    return retrieve.term_stats(retrieve.build_postings(c), t(spark, sf, "documents").count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "slug_ids",
    r"""WITH s AS (SELECT doc_id, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) AS s FROM documents)
        SELECT doc_id, concat(CASE WHEN s = '' THEN 'entry' ELSE s END, ':', doc_id) AS id FROM s""",
)
def _(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", F.concat(text.slug(F.col("text")), F.lit(":"), "doc_id").alias("id"))


@query(
    "breadcrumb",
    "SELECT doc_id, sha256(concat_ws(' > ', lang, nullif(source, 'src0'), nullif(text, ''))) AS sha FROM documents",
)
def _(spark, sf):
    d = t(spark, sf, "documents")
    source = F.when(F.col("source") == "src0", "").otherwise(F.col("source"))
    return d.select("doc_id", F.sha2(text.breadcrumb(F.col("lang"), source, F.col("text")), 256).alias("sha"))


def tidy_sql(text: str) -> str:
    """SQL of text.tidy."""
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(
    "tidy_text",
    f"SELECT doc_id, sha256({tidy_sql('text')}) AS sha FROM documents",
)
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.sha2(text.tidy(F.col("text")), 256).alias("sha"))


@query(
    "sentence_split",
    r"""SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentences FROM documents""",
)
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.size(chunking.sentences(F.col("text"))).cast("bigint").alias("sentences"))


def packed_sql(pieces: str, joiner: str, gap: int, limit: int) -> str:
    """SQL of greedy packing: one string folds the pieces, chr(1) between its parts."""
    last = "string_split(a, chr(1))[-1]"
    fold = f"""list_reduce({pieces}, lambda a, p: CASE WHEN {last} = '' THEN a || p WHEN length({last}) + length(p) + {gap} > {limit} THEN a || chr(1) || p ELSE a || {joiner} || p END, '')"""
    return f"list_filter(list_transform(string_split({fold}, chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


def sentences_sql(text: str) -> str:
    """SQL of chunking.sentences."""
    return rf"string_split(regexp_replace({text}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


_SENTENCES = sentences_sql("p")


@query(
    "para_pack",
    f"""WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
       c AS (SELECT doc_id, CASE WHEN length(text) <= 1500 THEN [text] ELSE {packed_sql("string_split(text, chr(10) || chr(10))", "chr(10) || chr(10)", 2, 1500)} END AS parts, length(text) <= 1500 AS whole FROM d),
       u AS (SELECT doc_id, whole, unnest(parts) AS p, generate_subscripts(parts, 1) AS n FROM c),
       s AS (SELECT doc_id, n, CASE WHEN whole OR length(p) <= 1500 THEN [p] ELSE {packed_sql(_SENTENCES, "' '", 1, 1500)} END AS fine FROM u),
       f AS (SELECT doc_id, n, unnest(fine) AS body, generate_subscripts(fine, 1) AS m FROM s)
       SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, m) - 1 AS part, length(body) AS chars, sha256(body) AS sha FROM f""",
)
def _(spark, sf):
    parts = F.posexplode(chunking.split_prose(F.regexp_replace("text", "\n", "\n\n")))
    return t(spark, sf, "documents").select("doc_id", parts.alias("part", "body")).select("doc_id", "part", F.length("body").alias("chars"), F.sha2("body", 256).alias("sha"))


@query(
    "clause_pack",
    f"""WITH c AS (SELECT doc_id, CASE WHEN length(text) <= 2000 THEN [text] ELSE {packed_sql("string_split(text, chr(10))", "chr(10)", 1, 2000)} END AS parts FROM documents),
       u AS (SELECT doc_id, unnest(parts) AS body, generate_subscripts(parts, 1) AS n FROM c)
       SELECT doc_id, n - 1 AS part, length(body) AS chars, sha256(body) AS sha FROM u""",
)
def _(spark, sf):
    parts = F.posexplode(chunking.split_clauses(F.col("text")))
    return t(spark, sf, "documents").select("doc_id", parts.alias("part", "body")).select("doc_id", "part", F.length("body").alias("chars"), F.sha2("body", 256).alias("sha"))


_LAST = "string_split(a, chr(1))[-1]"


@query(
    "short_merge",
    f"""WITH c AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM documents),
       m AS (SELECT doc_id, string_split(list_reduce(lines, lambda a, p: CASE WHEN length({_LAST}) < 250
              THEN left(a, length(a) - length({_LAST})) || regexp_replace({_LAST} || chr(10) || chr(10) || p, '^\\s+|\\s+$', '', 'g') ELSE a || chr(1) || p END), chr(1)) AS parts FROM c WHERE len(lines) > 0),
       u AS (SELECT doc_id, unnest(parts) AS body, generate_subscripts(parts, 1) AS n FROM m)
       SELECT doc_id, n - 1 AS section_no, length(body) AS chars, sha256(body) AS sha FROM u""",
)
def _(spark, sf):
    d = t(spark, sf, "documents")
    none = F.lit(None).cast("string")
    sections = F.transform(F.split("text", "\n"), lambda x: F.struct(none.alias("heading"), none.alias("subheading"), x.alias("text")))
    merged = d.select("doc_id", F.posexplode(chunking.merge_short(sections)).alias("section_no", "s"))
    return merged.select("doc_id", "section_no", F.length("s.text").alias("chars"), F.sha2("s.text", 256).alias("sha"))


# --- retrieval ------------------------------------------------------------------------------

_LEX = """WITH q AS (SELECT item_id AS question_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark),
  d AS (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents),
  s AS (SELECT b.item_id AS question_id, x.doc_id AS id, coalesce(m.score, 0) AS score
        FROM benchmark b CROSS JOIN documents x LEFT JOIN (SELECT question_id, id, CAST(count(*) AS DOUBLE) AS score FROM q JOIN d USING (term) GROUP BY ALL) m
        ON m.question_id = b.item_id AND m.id = x.doc_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM s)"""


@query("lexical_topk", _LEX + " SELECT question_id, id, score, rank FROM r WHERE rank <= 10")
def _(spark, sf):
    return retrieve.lexical(as_questions(spark, sf), as_chunks(spark, sf), 10)


_BM = (
    _POSTINGS
    + """, qt AS (SELECT item_id AS question_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
  q AS (SELECT question_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
  bs AS (SELECT question_id, doc_id AS id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
        FROM q JOIN post USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), cs GROUP BY ALL),
  br AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM bs)"""
)


def bm25_sql() -> str:
    """SQL of the postings (post), the BM25 scores (bs) and the ranks (br) of the benchmark in the documents."""
    return _BM


@query("bm25_topk", _BM + " SELECT question_id, id, score, rank FROM br WHERE rank <= 10")
def _(spark, sf):
    return retrieve.bm25(as_questions(spark, sf), as_chunks(spark, sf), 10, zero_fill=False)


@query("bm25_index_topk", _BM + " SELECT question_id, id, score, rank FROM br WHERE rank <= 10")
def _(spark, sf):
    """bm25_topk from an index that was written in two deliveries, the English documents first."""
    index = PostingIndex(spark, new_scratch_path(spark, "postings"))
    english = spread(t(spark, sf, "documents")).withColumn("english", F.coalesce(F.col("lang") == "en", F.lit(False)))
    for part in ("english", "not english"):
        index.add(english.where(part).select(F.col("doc_id").alias("id"), "text"))
    return index.search(as_questions(spark, sf), 10)


@query(
    "bm25_zero_fill",
    _BM
    + """, qq AS (SELECT item_id AS question_id FROM benchmark UNION ALL SELECT -1),
  f AS (SELECT question_id, doc_id AS id, coalesce(score, 0) AS score FROM qq CROSS JOIN documents LEFT JOIN bs ON bs.question_id = qq.question_id AND bs.id = doc_id),
  fr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM f)
  SELECT question_id, id, score, rank FROM fr WHERE rank <= 30""".replace("SELECT question_id, doc_id AS id, coalesce", "SELECT qq.question_id, doc_id AS id, coalesce"),
)
def _(spark, sf):
    none = spark.createDataFrame([(-1, "zzzzqqqq xxxxyyyy")], "question_id long, question string")
    return retrieve.bm25(as_questions(spark, sf).unionByName(none), as_chunks(spark, sf), 30)


_DENSE = """WITH q AS (SELECT vec_id AS question_id, embedding AS a FROM embeddings WHERE vec_id % 50 = 0),
  s AS (SELECT question_id, vec_id AS id, round(list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings WHERE vec_id <> question_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM s)"""
_DENSE_ALL = _DENSE.replace(" WHERE vec_id % 50 = 0", "")


def _neighbours(spark, sf, k=10):
    return retrieve.neighbours(t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), k)


@query("dense_topk", _DENSE_ALL + " SELECT question_id, id, score, rank FROM r WHERE rank <= 10")
def _(spark, sf):
    return _neighbours(spark, sf)


@query("dense_index_topk", _DENSE + " SELECT question_id, id, score, rank FROM r WHERE rank <= 10")
def _(spark, sf):
    """dense_topk of every 50th id, from vectors kept around centres."""
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex(spark, new_scratch_path(spark, "centres"))
    index.build(e)
    return index.search(e.where("id % 50 = 0").withColumnRenamed("id", "question_id"), 10, exclude_self=True)


@query(
    "dense_by_label",
    _DENSE_ALL
    + """, top AS (SELECT r.*, a.label = b.label AS hit FROM r JOIN embeddings a ON a.vec_id = question_id JOIN embeddings b ON b.vec_id = id WHERE rank <= 10)
  SELECT question_id, count(*) FILTER (WHERE hit) AS hits, coalesce(1.0 / min(rank) FILTER (WHERE hit), 0.0) AS rr FROM top GROUP BY question_id""",
)
def _(spark, sf):
    label = t(spark, sf, "embeddings").select("vec_id", "label")
    r = _neighbours(spark, sf).join(label.toDF("question_id", "asked"), "question_id").join(label.toDF("id", "found"), "id")
    hit = F.col("asked") == F.col("found")
    return r.groupBy("question_id").agg(F.count_if(hit).alias("hits"), F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"))


_NONE = """, qq AS (SELECT item_id AS question_id, text FROM benchmark UNION ALL SELECT -1, 'zzzzqqqq xxxxyyyy')"""
_FILLED = """, f AS (SELECT qq.question_id, doc_id AS id, coalesce(score, 0) AS score FROM qq CROSS JOIN documents LEFT JOIN bs ON bs.question_id = qq.question_id AND bs.id = doc_id),
  fr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM f)"""


def _with_none(spark, sf) -> DataFrame:
    """The questions and one that no document has a word of: its ranks are fillers alone."""
    return as_questions(spark, sf).unionByName(spark.createDataFrame([(-1, "zzzzqqqq xxxxyyyy")], "question_id long, question string"))


@query(
    "rrf_topk",
    _BM
    + _NONE
    + _FILLED
    + """, lq AS (SELECT question_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM qq),
  ld AS (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents),
  lm AS (SELECT question_id, id, count(*) AS score FROM lq JOIN ld USING (term) GROUP BY ALL),
  ls AS (SELECT qq.question_id, doc_id AS id, coalesce(score, 0) AS score FROM qq CROSS JOIN documents LEFT JOIN lm ON lm.question_id = qq.question_id AND lm.id = doc_id),
  lr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM ls),
  v AS (SELECT question_id, id, rank FROM lr WHERE rank <= 30 UNION ALL SELECT question_id, id, rank FROM fr WHERE rank <= 30),
  fs AS (SELECT question_id, id, round(sum(1.0 / (60 + rank)), 8) AS score FROM v GROUP BY ALL),
  xr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM fs)
  SELECT question_id, id, score, rank FROM xr WHERE rank <= 10""",
)
def _(spark, sf):
    q, c = _with_none(spark, sf), as_chunks(spark, sf)
    both = retrieve.match(q, c)
    return retrieve.hybrid(q, c, lambda depth: retrieve.lexical(q, c, depth, matches=both), 10, 30, matches=both)


# --- metrics --------------------------------------------------------------------------------

_CASES = (
    _BM
    + """, rl AS (SELECT question_id, list(id ORDER BY rank) AS retrieved FROM br WHERE rank <= 10 GROUP BY question_id),
  cases AS (SELECT b.item_id AS case_id, CASE WHEN b.item_id % 3 = 0 THEN 'a' ELSE 'b' END AS category,
                   [[min(d.doc_id), max(d.doc_id)], [b.item_id]] AS expected
            FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id),
  pc AS (SELECT case_id, category, expected, coalesce(retrieved, []) AS retrieved FROM cases LEFT JOIN rl ON question_id = case_id),
  sc AS (SELECT case_id, category,
     (CASE WHEN list_has_any(expected[1], retrieved[1:1]) THEN 1.0 ELSE 0 END + CASE WHEN list_has_any(expected[2], retrieved[1:1]) THEN 1.0 ELSE 0 END) / 2 AS recall_1,
     (CASE WHEN list_has_any(expected[1], retrieved[1:3]) THEN 1.0 ELSE 0 END + CASE WHEN list_has_any(expected[2], retrieved[1:3]) THEN 1.0 ELSE 0 END) / 2 AS recall_3,
     (CASE WHEN list_has_any(expected[1], retrieved[1:5]) THEN 1.0 ELSE 0 END + CASE WHEN list_has_any(expected[2], retrieved[1:5]) THEN 1.0 ELSE 0 END) / 2 AS recall_5,
     (CASE WHEN list_has_any(expected[1], retrieved[1:10]) THEN 1.0 ELSE 0 END + CASE WHEN list_has_any(expected[2], retrieved[1:10]) THEN 1.0 ELSE 0 END) / 2 AS recall_10,
     coalesce(1.0 / list_min(list_filter(range(1, len(retrieved) + 1), lambda i: list_contains(flatten(expected), retrieved[i]))), 0.0) AS rr FROM pc)"""
)


def _cases(spark, sf) -> DataFrame:
    """Benchmark items with the first and last document that holds their text, and their ranked documents."""
    b, d = t(spark, sf, "benchmark"), spread(t(spark, sf, "documents"))
    held = chunks.holders(d.select(F.col("doc_id").alias("id"), "text"), b.select("item_id", F.col("text").alias("item")))
    groups = held.groupBy(F.col("item_id").alias("case_id")).agg(F.array(F.array(F.min("id"), F.max("id")), F.array(F.first("item_id"))).alias("expected"))
    lists = metrics.ranked_ids(retrieve.bm25(as_questions(spark, sf), as_chunks(spark, sf), 10, zero_fill=False)).withColumnRenamed("question_id", "case_id")
    return groups.withColumn("category", F.when(F.col("case_id") % 3 == 0, "a").otherwise("b")).join(lists, "case_id", "left")


@query("nested_expected", _CASES + " SELECT case_id, round(recall_5, 6) AS recall_5, round(rr, 6) AS rr FROM sc")
def _(spark, sf):
    return metrics.score_cases(_cases(spark, sf)).select("case_id", F.round("recall_5", 6).alias("recall_5"), F.round("rr", 6).alias("rr"))


@query(
    "recall_report",
    _CASES
    + """ SELECT category, count(*) AS cases, round(avg(recall_1), 4) AS recall_1, round(avg(recall_3), 4) AS recall_3, round(avg(recall_5), 4) AS recall_5,
           round(avg(recall_10), 4) AS recall_10, round(avg(rr), 4) AS mrr FROM sc GROUP BY GROUPING SETS ((), (category))""",
)
def _(spark, sf):
    return metrics.summarise(metrics.score_cases(_cases(spark, sf)), "category")


@query(
    "micro_by_source",
    _CASES
    + """, g AS (SELECT retrieved, unnest(expected) AS grp FROM pc)
  SELECT source AS source_type, count(*) AS entries,
    round(avg(CASE WHEN list_has_any(retrieved[1:1], grp) THEN 1 ELSE 0 END), 4) AS recall_1, round(avg(CASE WHEN list_has_any(retrieved[1:3], grp) THEN 1 ELSE 0 END), 4) AS recall_3,
    round(avg(CASE WHEN list_has_any(retrieved[1:5], grp) THEN 1 ELSE 0 END), 4) AS recall_5, round(avg(CASE WHEN list_has_any(retrieved[1:10], grp) THEN 1 ELSE 0 END), 4) AS recall_10
  FROM g JOIN documents ON doc_id = grp[1] GROUP BY source""",
)
def _(spark, sf):
    return metrics.micro_by_source(metrics.score_cases(_cases(spark, sf)), as_chunks(spark, sf))


@query("worst_cases", _CASES + " SELECT case_id, round(rr, 6) AS rr FROM sc ORDER BY sc.rr, case_id LIMIT 5")
def _(spark, sf):
    return metrics.worst_cases(metrics.score_cases(_cases(spark, sf))).select("case_id", F.round("rr", 6).alias("rr"))


# --- answers --------------------------------------------------------------------------------

_CITE = """WITH a AS (SELECT item_id AS case_id, unnest([item_id * 7, item_id * 13 + 5, item_id * 1000003]) AS chunk_id, unnest([0, 1, 2]) AS place FROM benchmark)"""


def _cited(spark, sf) -> DataFrame:
    i = F.col("item_id")
    return t(spark, sf, "benchmark").select(i.alias("case_id"), F.array(i * 7, i * 13 + 5, i * 1000003).alias("citations"))


@query("citation_resolve", _CITE + " SELECT case_id, place, chunk_id, source FROM a JOIN documents ON doc_id = chunk_id")
def _(spark, sf):
    c = _cited(spark, sf).select("case_id", F.posexplode("citations").alias("place", "chunk_id"))
    return c.join(t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id").select("case_id", "place", "chunk_id", "source")


@query("citation_unresolved", _CITE + " SELECT case_id, chunk_id FROM a WHERE chunk_id NOT IN (SELECT doc_id FROM documents)")
def _(spark, sf):
    return validate.unresolved_citations(_cited(spark, sf), t(spark, sf, "documents").select(F.col("doc_id").alias("id")))


@query(
    "draft_normalise",
    """WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'answer' WHEN 1 THEN 'refuse' WHEN 2 THEN 'clarify' END AS kind, (doc_id % 7) / 4.0 - 0.25 AS conf,
              [CAST(doc_id % 3 AS VARCHAR), CAST(doc_id % 5 AS VARCHAR), CAST(doc_id % 3 AS VARCHAR)] AS cites, CASE WHEN doc_id % 8 = 0 THEN [] ELSE ['0', '1'] END AS ret FROM documents),
       c AS (SELECT *, CASE WHEN kind = 'answer' THEN cites ELSE [] END AS used FROM d),
       k AS (SELECT *, CASE WHEN len(ret) > 0 THEN list_filter(used, lambda x: list_contains(ret, x)) ELSE used END AS kept FROM c)
       SELECT doc_id, array_to_string(kept, ',') AS citations, len(used) - len(kept) AS dropped, (kind IS NULL OR kind = 'refuse') AS refused,
              CASE WHEN kind IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, conf)) END::DOUBLE AS confidence FROM k""",
)
def _(spark, sf):
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "answer").when(i % 4 == 1, "refuse").when(i % 4 == 2, "clarify")
    s = lambda n: (i % n).cast("string")
    drafts = t(spark, sf, "documents").select(
        "doc_id", kind.alias("response_type"), F.lit("x").alias("answer"), F.array(s(3), s(5), s(3)).alias("citations"), ((i % 7) / 4.0 - 0.25).alias("confidence"),
        F.when(i % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("0"), F.lit("1"))).alias("retrieved"),
    )
    return answers.normalise_drafts(drafts).select(
        "doc_id", F.array_join("kept_citations", ",").alias("citations"), F.col("dropped_citations").cast("bigint").alias("dropped"), "refused", F.col("clamped_confidence").alias("confidence")
    )


@query(
    "mention_checks",
    r"""SELECT doc_id, (contains(lower(text), 'the-and') OR contains(regexp_replace(lower(text), '[\s\-]+', '', 'g'), 'theand')) AS has_the_and,
               (contains(lower(text), 'rights reserved') OR contains(regexp_replace(lower(text), '[\s\-]+', '', 'g'), 'rightsreserved')) AS has_rights FROM documents""",
)
def _(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", text.mentions(F.col("text"), F.lit("The-And")).alias("has_the_and"), text.mentions(F.col("text"), F.lit("rights reserved")).alias("has_rights"))


@query(
    "graded_axes",
    """SELECT lang, count(*) AS cases, round(coalesce(avg(quality), 0), 4)::DOUBLE AS correct, count(quality) AS correct_graded,
              round(coalesce(avg(toxic), 0), 4)::DOUBLE AS cited, count(toxic) AS cited_graded
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang))""",
)
def _(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    return answers.summarise_grades(d.select("lang", F.col("quality").alias("correct"), F.col("toxic").alias("cited")), "lang")


@query("latency_summary", "SELECT CAST(floor(avg(value)) AS BIGINT) AS mean_ms, CAST(max(value) AS BIGINT) AS max_ms FROM (SELECT floor(value) AS value FROM events)")
def _(spark, sf):
    return answers.latency(t(spark, sf, "events").select(F.floor("value").alias("answer_ms")))


@query(
    "prompt_render",
    _BM
    + """ SELECT br.question_id, sha256(string_agg('<chunk id="' || d.doc_id || '" source="' || d.source || '" title="">' || chr(10) || d.text || chr(10) || '</chunk>', chr(10) || chr(10) ORDER BY rank)) AS sha
  FROM br JOIN documents d ON d.doc_id = br.id WHERE rank <= 5 GROUP BY br.question_id""",
)
def _(spark, sf):
    c = as_chunks(spark, sf)
    return answers.render_prompts(retrieve.bm25(as_questions(spark, sf), c, 5, zero_fill=False), c).select("question_id", F.sha2("context", 256).alias("sha"))


@query(
    "request_validation",
    """SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 1 OR length(text) > 2000 THEN 'question' WHEN NOT (doc_id % 25 BETWEEN 1 AND 20) THEN 'max_chunks'
              WHEN lang NOT IN ('en', 'fr') THEN 'strategy' END AS error FROM documents""",
)
def _(spark, sf):
    r = t(spark, sf, "documents").select("doc_id", F.col("text").alias("question"), (F.col("doc_id") % 25).alias("max_chunks"), F.col("lang").alias("strategy"))
    return validate.request_errors(r, ["en", "fr"]).select("doc_id", "error")


# --- review ---------------------------------------------------------------------------------


def _decisions(spark, sf):
    lab = t(spark, sf, "labels")
    return lab.where("quality = 1").select(F.col("doc_id").alias("id")), lab.where("toxic = 1").select(F.col("doc_id").alias("id"))


@query("review_pending", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1)")
def _(spark, sf):
    return review.pending(t(spark, sf, "documents").select(F.col("doc_id").alias("id")), *_decisions(spark, sf))


@query("decided_sets", "SELECT doc_id AS id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def _(spark, sf):
    return review.decided_ids(*_decisions(spark, sf))


@query("review_overlap", "SELECT doc_id AS id, 'both' AS problem FROM labels WHERE quality = 1 AND toxic = 1")
def _(spark, sf):
    return validate.review_argument_errors(*_decisions(spark, sf), t(spark, sf, "documents").select(F.col("doc_id").alias("id")))


@query(
    "review_tally",
    """SELECT count(*) FILTER (WHERE quality = 1) AS approved, count(*) FILTER (WHERE toxic = 1) AS rejected,
              count(*) FILTER (WHERE coalesce(quality, 0) <> 1 AND coalesce(toxic, 0) <> 1) AS undecided FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(spark, sf):
    return review.tally(t(spark, sf, "documents").select(F.col("doc_id").alias("id")), *_decisions(spark, sf))


@query("poison_union", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id - 1000000, text FROM benchmark")
def _(spark, sf):
    extra = t(spark, sf, "benchmark").select((F.col("item_id") - 1000000).alias("id"), "text")
    return t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(extra)


@query(
    "cache_misses",
    "SELECT DISTINCT substr(sha256(text), 1, 16) AS key FROM documents WHERE substr(sha256(text), 1, 16) NOT IN (SELECT substr(sha256(text), 1, 16) FROM documents JOIN labels USING (doc_id))",
)
def _(spark, sf):
    from ..operators.plugins import cache_misses

    d = t(spark, sf, "documents").withColumn("key", text.content_key(F.col("text")))
    cache = d.join(t(spark, sf, "labels"), "doc_id", "left_semi").select(F.lit("m").alias("model"), "key")
    return cache_misses(d.select("key", "text"), cache, "m").select("key")


def _counting_embedder():
    return lambda text: [float(len(text) % 97), float(text.count("e"))]


@query(
    "embedding_store",
    """SELECT doc_id, substr(sha256(text), 1, 16) AS key, CAST(length(text) % 97 AS DOUBLE) AS e0, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS e1,
              text NOT IN (SELECT text FROM documents WHERE lang = 'en') AS later FROM documents""",
)
def _(spark, sf):
    """Vectors of all documents: the English ones are delivered and merged first, then all, of which only new texts are embedded."""
    from ..operators.results import vector_store

    d = t(spark, sf, "documents")
    store = vector_store(spark, new_scratch_path(spark, "vectors"), "counts")
    key = text.content_key(F.col("text"))
    store.fill(d.where("lang = 'en'").select(key.alias("key"), "text"), _counting_embedder)
    store.compact()
    found = store.ask(d.select("doc_id", "text", key.alias("key")), "text", _counting_embedder, key=F.col("key"))
    first = store.merged(store.snapshot()[0]).select("key", F.lit(False).alias("later"))
    e = F.col("result").cast("array<double>")
    return found.join(first, "key", "left").select("doc_id", "key", F.get(e, F.lit(0)).alias("e0"), F.get(e, F.lit(1)).alias("e1"), F.coalesce("later", F.lit(True)).alias("later"))


def _counting_drafter():
    return lambda prompt: ("answer", str(len(prompt)), [prompt[-20:]], 0.5)


_AROUND = "\n\nReference chunks:\n\n\n\n<question>\n\n</question>"  # of a prompt without chunks


@query(
    "call_ledger",
    f"""SELECT item_id, 'answer' AS response_type, CAST(length(text) + {len(answers.RULES + _AROUND)} AS VARCHAR) AS answer, count(*) OVER (PARTITION BY text) AS sharing FROM benchmark""",
)
def _(spark, sf):
    """Drafts for every item from one ledger, which two runs fill: the second asks nothing."""
    from .ask import DRAFT, called

    asked = as_questions(spark, sf).withColumn("prompt", answers.answer_prompt(F.lit(""), F.col("question")))
    folder = new_scratch_path(spark, "ledger")
    for _ in range(2):
        found = called(asked, "prompt", DRAFT, _counting_drafter, folder, "m")
    sharing = F.count("*").over(Window.partitionBy("prompt"))
    return found.select(F.col("question_id").alias("item_id"), "result.response_type", "result.answer", sharing.alias("sharing"))


@query("replace_latest", "SELECT doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 'old' ELSE 'new' END AS version FROM documents d LEFT JOIN labels l USING (doc_id)".replace("l.doc_id IS NULL", "l.quality IS NULL"))
def _(spark, sf):
    old = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("old").alias("version"))
    return review.replace_latest(old, t(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("new").alias("version")))


# --- dates and threads ----------------------------------------------------------------------


@query(
    "js_date",
    """SELECT o_orderkey, CAST(make_date(CAST(year(o_orderdate) + floor(m / 12) AS BIGINT), m % 12 + 1, 1) + CAST(d - 1 AS INTEGER) AS DATE) AS rolled
       FROM (SELECT o_orderkey, o_orderdate, CAST(month(o_orderdate) + 5 AS BIGINT) AS m, day(o_orderdate) + 10 AS d FROM orders)""",
)
def _(spark, sf):
    o = t(spark, sf, "orders")
    return o.select("o_orderkey", dates.rolled_date(F.year("o_orderdate"), F.month("o_orderdate") + 5, F.day("o_orderdate") + 10).alias("rolled"))


@query("stale_flag", "SELECT o_orderkey, (TIMESTAMP '1998-08-02 00:00:00' - o_orderdate) > INTERVAL 270 DAY AS stale FROM orders")
def _(spark, sf):
    at = F.lit("1998-08-02 00:00:00").cast("timestamp")
    return t(spark, sf, "orders").select("o_orderkey", dates.is_stale(F.col("o_orderdate").cast("timestamp"), at).alias("stale"))


@query(
    "gap_threads",
    """WITH g AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 2700000000 THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT event_id, user_id, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g""",
)
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return threads.gap_sessions(e, "ts", ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", "session")


@query(
    "reply_forest",
    """WITH RECURSIVE m AS (SELECT conv_id * 1000 + turn AS idx, CASE WHEN role = 'assistant' THEN conv_id * 1000 + lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) END AS parent FROM conversations),
       w(idx, up, d) AS (SELECT idx, parent, 1 FROM m WHERE parent IS NOT NULL UNION ALL SELECT w.idx, m.parent, d + 1 FROM w JOIN m ON m.idx = w.up WHERE m.parent IS NOT NULL AND d < 11)
       SELECT m.idx AS index, (SELECT arg_max(up, d) FROM w WHERE w.idx = m.idx) AS root FROM m""",
)
def _(spark, sf):
    c = t(spark, sf, "conversations")
    base = F.col("conv_id") * 1000
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    nothing = F.lit(None).cast("bigint")
    e = c.select((base + F.col("turn")).alias("index"), nothing.alias("messageIndex"), nothing.alias("threadRootMessageIndex"), F.when(F.col("role") == "assistant", base + before).alias("repliesToEventIndex"))
    return threads.thread_roots(e)


_ASKED = "CASE WHEN role = 'user' AND conv_id % 2 = 0 THEN text || '?' ELSE text END"


def _asked(spark, sf) -> DataFrame:
    """Conversations in which the users of every other one ask."""
    c = t(spark, sf, "conversations")
    return c.withColumn("text", F.when((F.col("role") == "user") & (F.col("conv_id") % 2 == 0), F.concat("text", F.lit("?"))).otherwise(F.col("text")))


@query(
    "shortlist",
    rf"""WITH c AS (SELECT conv_id, turn, role, {_ASKED} AS text FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM c)
        SELECT conv_id, count(*) AS messages FROM r GROUP BY conv_id
        HAVING count(*) >= 2 AND bool_or(n = 1 AND regexp_matches(text, '(?i)(\?|^how\b|^why\b|^what\b|^where\b|^when\b|^can i\b|^is it\b|^does\b|^anyone know\b)'))
           AND max(CASE WHEN n > 1 THEN length(text) END) >= 60 AND count(DISTINCT role) >= 2""",
)
def _(spark, sf):
    return threads.shortlist(_asked(spark, sf), "conv_id", "turn", "role")


@query("question_hints", rf"SELECT conv_id, turn, regexp_matches({_ASKED}, '(?i)(\?|^how\b|^why\b|^what\b|^where\b|^when\b|^can i\b|^is it\b|^does\b|^anyone know\b)') AS asks FROM conversations")
def _(spark, sf):
    return _asked(spark, sf).select("conv_id", "turn", text.is_question(F.col("text")).alias("asks"))


@query(
    "sender_alias",
    """WITH f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, role) AS first FROM conversations)
       SELECT conv_id, turn, 'user' || dense_rank() OVER (PARTITION BY conv_id ORDER BY first) AS alias FROM f""",
)
def _(spark, sf):
    return threads.sender_alias(t(spark, sf, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "alias")


@query("thread_cap", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3")
def _(spark, sf):
    return threads.cap_threads(t(spark, sf, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn")


@query(
    "render_thread",
    """WITH f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, role) AS first FROM conversations),
       a AS (SELECT *, 'user' || dense_rank() OVER (PARTITION BY conv_id ORDER BY first) AS alias FROM f)
       SELECT conv_id, sha256(string_agg('[event ' || turn || '] ' || alias || ': ' || text, chr(10) ORDER BY turn)) AS sha FROM a GROUP BY conv_id""",
)
def _(spark, sf):
    r = threads.render_threads(t(spark, sf, "conversations"), "conv_id", "turn", "role", reactions=None)
    return r.select("conv_id", F.sha2("rendered", 256).alias("sha"))


# --- markup ---------------------------------------------------------------------------------


@query(
    "html_strip",
    r"""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\b[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g')) AS sha FROM pages""",
)
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.sha2(F.regexp_replace(text.strip_scripts(F.col("html")), "<[^>]+>", " "), 256).alias("sha"))


@query("html_links", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages""")
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))


@query("render_markdown")
def _(spark, sf):
    r = chunks.rendered(t(spark, sf, "pages").select("page_id", "html"), "page_id")
    return r.select("page_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha"))


@query("html_sections")
def _(spark, sf):
    r = chunks.article_sections(t(spark, sf, "pages").select("page_id", F.col("html").alias("source")), "page_id")
    return r.select("page_id", "position", "heading", "subheading", F.length("text").alias("chars"))


@query(
    "session_stream",
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 2700000000 THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
       a AS (SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 2700000000 AS finish_us, count(*) AS messages FROM s GROUP BY user_id, n)
       SELECT * FROM a WHERE finish_us <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events)""",
)
def _(spark, sf):
    """Gap sessions of the events of users as a stream that has read all there is."""
    import uuid

    from ..storage import shared_dir
    from ..streaming.streams import gap_session_stream, run_to_files

    base = f"{shared_dir(spark)}/quarry-stream/{uuid.uuid4().hex}"
    kind = t(spark, sf, "events").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_to_files(gap_session_stream(stream, "ts", "user_id"), f"{base}/out", f"{base}/state")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("finish").alias("finish_us"), "messages")


# --- general relational shapes ----------------------------------------------------------------


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, count(*) AS lines, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def _(spark, sf):
    li = t(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


@query(
    "top_orders_by_customer",
    """SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""",
)
def _(spark, sf):
    return top_k(t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


# --- further operators ------------------------------------------------------------------------


_CHATTER = ["gm", " +1 ", "/cmd now", "Thanks", "!!!", "é", "an answer", "  ", "ty all", "/x"]


@query(
    "event_cleaning",
    rf"""WITH e AS (SELECT conv_id, turn, role, text AS body FROM conversations UNION ALL SELECT conv_id, -1, 'user', {_CHATTER!r}[conv_id % 10 + 1] FROM conversations WHERE turn = 0)
        SELECT conv_id, turn FROM e
        WHERE role <> 'system' AND trim(body, chr(32) || chr(9) || chr(10) || chr(13)) <> '' AND NOT starts_with(ltrim(body, chr(32) || chr(9) || chr(10) || chr(13)), '/')
          AND NOT regexp_full_match(body, '(?is)\s*(/\w+|[^\pL\pN]{{1,4}}|gm|ty|thanks|thx|lol|\+1)\s*')""",
)
def _(spark, sf):
    """Whole messages, and one of _CHATTER before each conversation."""
    from ..sources.readers import clean_events

    c = t(spark, sf, "conversations")
    words = F.array(*[F.lit(w) for w in _CHATTER])
    short = c.where("turn = 0").select("conv_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.get(words, (F.col("conv_id") % 10).cast("int")).alias("text"))
    e = c.select("conv_id", "turn", "role", "text").unionByName(short)
    e = e.select("conv_id", "turn", "text", F.lit(None).cast("boolean").alias("deleted"), (F.col("role") == "system").alias("isBot"))
    return clean_events(e).select("conv_id", "turn")


@query(
    "first_last_message",
    """SELECT conv_id, count(*) AS messages, sha256(arg_min(text, turn)) AS first, sha256(arg_max(text, turn)) AS last FROM conversations GROUP BY conv_id""",
)
def _(spark, sf):
    g = t(spark, sf, "conversations").groupBy("conv_id")
    return g.agg(F.count("*").alias("messages"), F.sha2(F.min_by("text", "turn"), 256).alias("first"), F.sha2(F.max_by("text", "turn"), 256).alias("last"))


@query(
    "latest_event",
    """SELECT user_id, arg_max(event_id, struct_pack(ts := ts, id := event_id)) AS event_id FROM events GROUP BY user_id""",
)
def _(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(
    "variant_access",
    """SELECT doc_id, coalesce(nullif(json_extract_string(j, '$.published'), ''), json_extract_string(j, '$.answered_at')) AS published
       FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"published": "2024-01-0' || (doc_id % 9) || '"}' WHEN 1 THEN '{"published": "", "answered_at": "2023-05-05"}' ELSE '{}' END AS j FROM documents)""",
)
def _(spark, sf):
    i = F.col("doc_id")
    j = F.when(i % 3 == 0, F.concat(F.lit('{"published": "2024-01-0'), i % 9, F.lit('"}'))).when(i % 3 == 1, '{"published": "", "answered_at": "2023-05-05"}').otherwise("{}")
    d = t(spark, sf, "documents").select("doc_id", F.parse_json(j).alias("meta"))
    get = lambda p: F.nullif(F.try_variant_get("meta", p, "string"), F.lit(""))
    return d.select("doc_id", F.coalesce(get("$.published"), get("$.answered_at")).alias("published"))


@query(
    "usage_totals",
    """SELECT CAST(sum(length(text)) AS BIGINT) AS tokens_in, CAST(sum(n_chars % 7) AS BIGINT) AS tokens_out, count(*) FILTER (WHERE doc_id % 11 = 0) AS parse_failures, CAST(sum(doc_id % 2) AS BIGINT) AS dropped_citations FROM documents""",
)
def _(spark, sf):
    d = t(spark, sf, "documents")
    kind = F.when(F.col("doc_id") % 11 == 0, None).otherwise("answer")
    rows = d.select(F.length("text").alias("tokens_in"), (F.col("n_chars") % 7).alias("tokens_out"), kind.alias("response_type"), (F.col("doc_id") % 2).alias("dropped_citations"))
    return answers.usage(rows)


@query("expected_unresolved", "SELECT DISTINCT item_id AS case_id, x AS chunk_id FROM (SELECT item_id, unnest([item_id, item_id * 997, -item_id - 1]) AS x FROM benchmark) WHERE x NOT IN (SELECT doc_id FROM documents)")
def _(spark, sf):
    i = F.col("item_id")
    cases = t(spark, sf, "benchmark").select(i.alias("id"), F.array(F.array(i), F.array(i * 997, -i - 1)).alias("expected_chunk_ids"))
    return validate.unresolved_expected(cases, as_chunks(spark, sf))


@query(
    "category_shortfalls",
    """WITH l(category, least) AS (VALUES ('answerable', 25), ('refusal', 8), ('ambiguous', 4), ('injection', 3), ('all', 40)),
       c AS (SELECT CASE WHEN item_id % 10 < 5 THEN 'answerable' WHEN item_id % 10 < 7 THEN 'refusal' ELSE 'ambiguous' END AS category FROM benchmark),
       n AS (SELECT category, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM c)
       SELECT l.category, coalesce(n, 0) AS cases, CAST(least AS BIGINT) AS least FROM l LEFT JOIN n USING (category) WHERE coalesce(n, 0) < least""",
)
def _(spark, sf):
    k = F.col("item_id") % 10
    c = t(spark, sf, "benchmark").select(F.when(k < 5, "answerable").when(k < 7, "refusal").otherwise("ambiguous").alias("category"))
    return validate.category_shortfalls(c)


@query(
    "inline_markdown",
    r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(html, '</a>', chr(10) || ' </a>'), '(?is)<a\b[^>]*?href=["'']\s*([^"'']+?)\s*["''][^>]*>\s*(.*?)\s*</a>', '[\2](\1)', 'g'), '<[^>]+>', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(10) || chr(9) || chr(13))) AS sha FROM pages""",
)
def _(spark, sf):
    """Pages whose links have padded labels."""
    padded = F.regexp_replace("html", "</a>", "\n </a>")
    return t(spark, sf, "pages").select("page_id", F.sha2(text.inline_markdown(padded), 256).alias("sha"))


@query("corpus_health", "SELECT count(*) AS corpus_size, 5 AS index_build_ms, 'bm25,dense' AS strategies FROM documents")
def _(spark, sf):
    from .ask import health

    return health(as_chunks(spark, sf), ["dense", "bm25"], 5).withColumn("strategies", F.array_join("strategies", ","))


@query(
    "help_candidates",
    """WITH p AS (SELECT conv_id, arg_min(text, turn) AS question, arg_max(text, turn) AS answer, min(conv_id * 1000 + turn) AS root, max(conv_id * 1000 + turn) AS last, count(*) AS n FROM conversations GROUP BY conv_id)
       SELECT 'help:' || root AS id, 'chat/' || last AS url, left(sha256(question || chr(10) || chr(10) || answer), 16) AS content_hash, 'pending' AS status, n AS thread_size FROM p""",
)
def _(spark, sf):
    """Pending chunks of conversations whose first turn stands for a question and whose last for its answer."""
    c = t(spark, sf, "conversations")
    index = F.col("conv_id") * 1000 + F.col("turn")
    members = c.select(F.col("conv_id").alias("thread"), index.alias("index"), index.alias("messageIndex"), (index * 60000).alias("timestamp"))
    pairs = c.groupBy(F.col("conv_id").alias("thread")).agg(
        F.min_by("text", "turn").alias("question"), F.max_by("text", "turn").alias("answer"), F.lit(None).cast("bigint").alias("answer_event_index"),
        F.lit(0.9).alias("confidence"), F.lit(True).alias("self_contained"), F.lit("").alias("reason"),
    )
    out = threads.to_candidates(pairs, members, F.timestamp_millis(F.lit(0)), "chat/%s")
    return out.select("id", "url", "content_hash", "status", F.col("meta.thread_size").alias("thread_size"))


@query(
    "kept_extractions",
    "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND doc_id % 3 <> 0 AND source <> 'src1' AND (doc_id % 10) / 10.0 >= 0.7",
)
def _(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    i = F.col("doc_id")
    pairs = d.select("doc_id", (F.col("quality") == 1).alias("is_qa"), (i % 3 != 0).alias("self_contained"), (F.col("source") != "src1").alias("is_product_question"), (i % 10 / 10.0).alias("confidence"))
    return threads.keep_extractions(pairs).select("doc_id")


@query("question_keys", "SELECT item_id, 'q:' || left(sha256(text), 16) AS key FROM benchmark")
def _(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", text.question_key(F.col("text")).alias("key"))


_SQUASH = r"regexp_replace(lower({}), '[\s\-]+', '', 'g')"
_MENTIONS = "(contains(lower(text), lower(x)) OR contains(" + _SQUASH.format("text") + ", " + _SQUASH.format("x") + "))"


@query(
    "answer_checks",
    f"""WITH c AS (SELECT doc_id, text, [doc_id, doc_id * 7, -doc_id - 1] AS citations, doc_id % 4 = 0 AS refused, ['the-and', 'rights reserved', 'th e'] AS must, ['LICENSE', 'not there at all'] AS never FROM documents),
       k AS (SELECT doc_id, list(x) AS known FROM (SELECT doc_id, unnest(citations) AS x FROM c) WHERE x IN (SELECT doc_id FROM documents) GROUP BY doc_id)
       SELECT doc_id, array_to_string(list_filter(citations, lambda x: NOT list_contains(known, x)), ',') AS unresolved, len(list_filter(citations, lambda x: NOT list_contains(known, x))) = 0 AS resolved,
         CASE WHEN refused THEN '' ELSE array_to_string(list_filter(must, lambda x: NOT {_MENTIONS}), ',') END AS missing, array_to_string(list_filter(never, lambda x: {_MENTIONS}), ',') AS hit
       FROM c JOIN k USING (doc_id)""",
)
def _(spark, sf):
    i = F.col("doc_id")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    d = t(spark, sf, "documents")
    cases = d.select(
        "doc_id", "text", F.array(i, i * 7, -i - 1).alias("citations"), (i % 4 == 0).alias("refused"),
        words("the-and", "rights reserved", "th e").alias("must_mention"), words("LICENSE", "not there at all").alias("must_not_mention"),
    )
    cited = cases.select("doc_id", F.explode("citations").alias("c")).join(d.select(F.col("doc_id").alias("c")), "c", "left_semi")
    cases = cases.join(cited.groupBy("doc_id").agg(F.collect_list("c").alias("known")), "doc_id")
    out = answers.deterministic_checks(cases, F.col("known"))
    joined = lambda c: F.array_join(c, ",")
    return out.select(
        "doc_id", joined(F.col("unresolved_citations").cast("array<string>")).alias("unresolved"), F.col("citations_resolve").alias("resolved"),
        joined("must_mention_missing").alias("missing"), joined("must_not_mention_hit").alias("hit"),
    )


@query(
    "char_counts",
    f"""WITH c AS (SELECT doc_id, source, CASE WHEN length(text) <= 1500 THEN [text] ELSE {packed_sql("string_split(text, chr(10) || chr(10))", "chr(10) || chr(10)", 2, 1500)} END AS parts FROM documents),
       u AS (SELECT doc_id, source, unnest(parts) AS body, generate_subscripts(parts, 1) - 1 AS part FROM c)
       SELECT doc_id, part, length('Guidelines > ' || doc_id || '. ' || source || chr(10) || chr(10) || body) AS chars FROM u""",
)
def _(spark, sf):
    """Guideline chunks count their breadcrumb as well."""
    d = t(spark, sf, "documents")
    out = chunks.guideline_chunks(d.select(F.col("doc_id").cast("string").alias("number"), F.col("source").alias("title"), "text"), "https://g")
    return out.select(F.col("meta.section_number").cast("bigint").alias("doc_id"), F.col("meta.part").cast("bigint").alias("part"), F.col("meta.char_count").cast("bigint").alias("chars"))


@query("iso_times", "SELECT event_id, strftime(make_timestamp(event_id * 86399000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at FROM events")
def _(spark, sf):
    return t(spark, sf, "events").select("event_id", dates.iso_utc(dates.from_millis(F.col("event_id") * 86399000)).alias("at"))


@query(
    "answer_links",
    """WITH m AS (SELECT conv_id, turn, conv_id * 1000 + turn AS i, CASE WHEN turn % 2 = 0 THEN turn * 10 END AS message FROM conversations),
       p AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN conv_id * 1000 + 1 WHEN conv_id % 3 = 1 THEN -5 END AS named, max(i) AS last FROM m GROUP BY conv_id),
       a AS (SELECT p.conv_id, coalesce((SELECT i FROM m WHERE m.conv_id = p.conv_id AND m.i = p.named), p.last) AS i FROM p)
       SELECT a.conv_id, a.i AS answer_index, 'https://chat/' || coalesce(m.message, m.i) AS url FROM a JOIN m ON m.conv_id = a.conv_id AND m.i = a.i""",
)
def _(spark, sf):
    """Permalinks of named answers; an answer that is not in its thread falls back to the last message."""
    c = t(spark, sf, "conversations")
    i = F.col("conv_id") * 1000
    index = i + F.col("turn")
    members = c.select(F.col("conv_id").alias("thread"), index.alias("index"), F.when(F.col("turn") % 2 == 0, F.col("turn") * 10).alias("messageIndex"), index.alias("timestamp"))
    named = F.when(F.col("conv_id") % 3 == 0, i + 1).when(F.col("conv_id") % 3 == 1, F.lit(-5).cast("bigint"))
    pairs = c.select("conv_id").distinct().select(
        F.col("conv_id").alias("thread"), F.lit("q").alias("question"), F.lit("a").alias("answer"), named.alias("answer_event_index"), F.lit(0.9).alias("confidence"), F.lit(True).alias("self_contained"), F.lit("").alias("reason"),
    )
    out = threads.to_candidates(pairs, members, F.timestamp_millis(F.lit(0)), "https://chat/%s")
    at = F.col("provenance.answer_event_index")
    return out.select(F.floor(F.col("provenance.root_event_index") / 1000).alias("conv_id"), at.alias("answer_index"), "url")


@query(
    "inline_links",
    r"""SELECT page_id, CAST(unnest(range(len(a.hrefs))) AS BIGINT) AS place, unnest(a.hrefs) AS url, unnest(list_transform(a.labels, lambda x: regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g'))) AS label
       FROM (SELECT page_id, struct_pack(hrefs := regexp_extract_all(html, '(?is)<a\b[^>]*?href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1), labels := regexp_extract_all(html, '(?is)<a\b[^>]*?href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2)) AS a FROM pages)""",
)
def _(spark, sf):
    """Anchors in order, with repeats; the pages have no other markdown links than those their anchors become."""
    p = t(spark, sf, "pages").select("page_id", F.posexplode(text.inline_links(F.col("html"))).alias("place", "l"))
    return p.select("page_id", F.col("place").cast("bigint").alias("place"), "l.url", "l.label")


@query(
    "mining_counts",
    """SELECT count(*) FILTER (WHERE quality = 1) AS kept, count(*) FILTER (WHERE quality <> 1) AS rejected,
              count(*) FILTER (WHERE quality = 1 AND o_orderdate < TIMESTAMP '1998-08-02 00:00:00' - INTERVAL 270 DAY) AS stale FROM labels JOIN orders ON o_orderkey = doc_id""",
)
def _(spark, sf):
    rows = t(spark, sf, "labels").join(t(spark, sf, "orders"), F.col("doc_id") == F.col("o_orderkey"))
    at = F.lit("1998-08-02 00:00:00").cast("timestamp")
    return threads.mining_counts(rows.select((F.col("quality") == 1).alias("kept"), dates.is_stale(F.col("o_orderdate").cast("timestamp"), at).alias("stale")))


@query(
    "cache_hits",
    """SELECT row_number() OVER (ORDER BY i.item_id) - 1 AS pos, left(sha256(i.text), 16) AS key, v.vec_id FROM benchmark i JOIN embeddings v ON v.vec_id = i.item_id WHERE i.item_id % 2 = 0""",
)
def _(spark, sf):
    """Cached vectors of requests, in the order of the requests; every other request is cached."""
    from ..operators.plugins import cache_hits

    asked = t(spark, sf, "benchmark").select(F.col("item_id").alias("pos"), text.content_key(F.col("text")).alias("key"))
    cache = asked.where("pos % 2 = 0").join(t(spark, sf, "embeddings"), F.col("pos") == F.col("vec_id")).select(F.lit("m").alias("model"), "key", "embedding", "vec_id")
    return cache_hits(asked, cache, "m").select(F.floor(F.col("pos") / 2).alias("pos"), "key", "vec_id")


@query("id_clashes", "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT item_id * 3 FROM benchmark)")
def _(spark, sf):
    new = t(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return review.id_clashes(new, t(spark, sf, "benchmark").select((F.col("item_id") * 3).alias("id")))


@query(
    "posts_by_date",
    """SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS place FROM orders""",
)
def _(spark, sf):
    """Chunks of posts, the latest post first: the order of the written file, as a number."""
    o = t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("slug"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("position"))
    made = o.select("slug", F.struct("slug", F.lit(0).alias("section_index"), F.lit(0).alias("part")).alias("meta"))
    return chunks.by_date(made, o, "place").select(F.col("slug").cast("bigint").alias("o_orderkey"), "place")


def _sql(literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'"


@query(
    "grader_prompt",
    f"""WITH c AS (SELECT item_id, text, [item_id, item_id * 13 + 5, item_id * 1000003] AS ids FROM benchmark),
       u AS (SELECT item_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS place FROM c),
       b AS (SELECT item_id, string_agg('<chunk id="' || id || '">' || chr(10) || d.text || chr(10) || '</chunk>', chr(10) || chr(10) ORDER BY place) AS blocks FROM u JOIN documents d ON d.doc_id = id GROUP BY item_id)
       SELECT item_id, sha256({_sql(answers.GRADING)} || chr(10) || chr(10) || 'Category: ' || CASE WHEN item_id % 2 = 0 THEN 'answerable' ELSE 'refusal' END || chr(10) || 'Notes: '
         || CASE WHEN item_id % 5 = 0 THEN 'a note' ELSE '(none)' END || chr(10) || chr(10) || '<question>' || chr(10) || text || chr(10) || '</question>' || chr(10) || chr(10) || 'Refused: '
         || CASE WHEN item_id % 3 = 0 THEN 'true' ELSE 'false' END || chr(10) || '<answer>' || chr(10) || 'answer ' || item_id || chr(10) || '</answer>' || chr(10) || chr(10) || 'Cited chunks:' || chr(10)
         || coalesce(blocks, '(no chunks cited)')) AS sha FROM c LEFT JOIN b USING (item_id)""",
)
def _(spark, sf):
    i = F.col("item_id")
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    c = t(spark, sf, "benchmark").withColumn("citations", F.array(i, i * 13 + 5, i * 1000003))
    c = c.join(answers.cited_chunks(c.select("item_id", "citations"), d, "item_id"), "item_id", "left")
    cited = F.coalesce("cited", F.array().cast(c.schema["cited"].dataType))
    prompt = answers.grader_prompt(
        F.when(i % 2 == 0, "answerable").otherwise("refusal"), F.when(i % 5 == 0, "a note"), F.col("text"), i % 3 == 0, F.concat(F.lit("answer "), i), cited
    )
    return c.select("item_id", F.sha2(prompt, 256).alias("sha"))


@query(
    "answer_prompt",
    f"""SELECT item_id, sha256({_sql(answers.RULES)} || chr(10) || chr(10) || 'Reference chunks:' || chr(10) || chr(10) || '<chunk id="' || doc_id || '" source="' || source || '" title="">' || chr(10) || d.text
         || chr(10) || '</chunk>' || chr(10) || chr(10) || '<question>' || chr(10) || b.text || chr(10) || '</question>') AS sha FROM benchmark b JOIN documents d ON doc_id = item_id""",
)
def _(spark, sf):
    b = t(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    ranking = b.select("question_id", F.col("question_id").alias("id"), F.lit(1).alias("rank"))
    p = answers.render_prompts(ranking, as_chunks(spark, sf)).join(b, "question_id")
    return p.select(F.col("question_id").alias("item_id"), F.sha2(answers.answer_prompt(F.col("context"), F.col("question")), 256).alias("sha"))


@query(
    "answer_report",
    """SELECT count(*) AS cases, CAST(floor(avg(n_chars % 977)) AS BIGINT) AS mean_ms, CAST(max(n_chars % 977) AS BIGINT) AS max_ms, count(*) FILTER (WHERE doc_id % 11 = 0) AS parse_failures,
              CAST(sum(n_chars) AS BIGINT) AS tokens_in, CAST(sum(n_chars % 7) AS BIGINT) AS tokens_out, CAST(sum(doc_id % 3) AS BIGINT) AS dropped_citations FROM documents""",
)
def _(spark, sf):
    d, i = t(spark, sf, "documents"), F.col("doc_id")
    rows = d.select((F.col("n_chars") % 977).alias("answer_ms"), (i % 11 == 0).alias("parse_failed"), F.col("n_chars").alias("tokens_in"), (F.col("n_chars") % 7).alias("tokens_out"), (i % 3).alias("dropped_citations"))
    return answers.run_report(rows)


def _length_model():
    return lambda questions, texts: [-float(abs(len(q) - len(t))) for q, t in zip(questions, texts, strict=True)]


@query(
    "rerank_topk",
    _BM
    + """, s AS (SELECT br.question_id, br.id, -abs(length(b.text) - length(d.text))::DOUBLE AS score FROM br JOIN benchmark b ON b.item_id = br.question_id JOIN documents d ON d.doc_id = br.id WHERE br.rank <= 30),
  r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM s) SELECT question_id, id, score, rank FROM r WHERE rank <= 5""",
)
def _(spark, sf):
    """The first 30 by BM25 again by how close a text's length is to the question's."""
    q, c = as_questions(spark, sf), as_chunks(spark, sf)
    ranked = retrieve.bm25(q, c, 30, zero_fill=False).join(q, "question_id").join(c.select("id", "text"), "id")
    return retrieve.rerank_by_model(ranked, _length_model, 30, 5).select("question_id", "id", "score", "rank")


@query(
    "faq_pairs",
    """SELECT i.item_id AS position, 'k' || i.item_id AS key, sha256(q.text || chr(10) || a.text) AS sha FROM benchmark i
       JOIN documents q ON q.doc_id = i.item_id AND q.doc_id % 4 <> 1 JOIN documents a ON a.doc_id = i.item_id * 3 AND a.doc_id % 5 <> 0 WHERE q.text <> '' AND a.text <> ''""",
)
def _(spark, sf):
    """Keys whose question and answer string both exist."""
    from ..sources.readers import faq_pairs

    d, i = t(spark, sf, "documents"), F.col("doc_id")
    keys = t(spark, sf, "benchmark").select(F.col("item_id").alias("position"), F.concat(F.lit("k"), "item_id").alias("key"))
    name = lambda n, side: F.concat(F.lit("k"), n.cast("string"), F.lit(side)).alias("name")
    strings = d.where(i % 4 != 1).select(name(i, "_q"), F.col("text").alias("value")).unionByName(
        d.where((i % 3 == 0) & (i % 5 != 0)).select(name(F.floor(i / 3), "_a"), F.col("text").alias("value"))
    )
    return faq_pairs(keys, strings).select("position", "key", F.sha2(F.concat("question", F.lit("\n"), "answer"), 256).alias("sha"))


@query(
    "paragraph_pack",
    f"""WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
       c AS (SELECT doc_id, CASE WHEN length(text) <= 1500 THEN [text] ELSE {packed_sql("string_split(text, chr(10) || chr(10))", "chr(10) || chr(10)", 2, 1500)} END AS parts FROM d),
       u AS (SELECT doc_id, unnest(parts) AS body, generate_subscripts(parts, 1) AS n FROM c)
       SELECT doc_id, n - 1 AS part, length(body) AS chars, sha256(body) AS sha FROM u""",
)
def _(spark, sf):
    parts = F.posexplode(chunking.split_paragraphs(F.regexp_replace("text", "\n", "\n\n")))
    return t(spark, sf, "documents").select("doc_id", parts.alias("part", "body")).select("doc_id", "part", F.length("body").alias("chars"), F.sha2("body", 256).alias("sha"))


@query(
    "thread_members",
    """WITH RECURSIVE m AS (SELECT conv_id * 1000 + turn AS idx, CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN conv_id * 1000 + lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) END AS parent FROM conversations),
       w(idx, up, d) AS (SELECT idx, parent, 1 FROM m WHERE parent IS NOT NULL UNION ALL SELECT w.idx, m.parent, d + 1 FROM w JOIN m ON m.idx = w.up WHERE m.parent IS NOT NULL AND d < 11),
       r AS (SELECT idx, arg_max(up, d) AS root FROM w GROUP BY idx),
       l AS (SELECT idx FROM m WHERE idx NOT IN (SELECT idx FROM r) AND idx NOT IN (SELECT root FROM r)),
       g AS (SELECT idx, CASE WHEN idx - lag(idx) OVER (ORDER BY idx) > 45 THEN 1 ELSE 0 END AS brk FROM l),
       s AS (SELECT idx, sum(brk) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS n FROM g),
       a AS (SELECT root AS thread, idx FROM r UNION SELECT root, root FROM r UNION SELECT min(idx) OVER (PARTITION BY n), idx FROM s)
       SELECT thread, idx AS index FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY idx) AS k FROM a) WHERE k <= 40""",
)
def _(spark, sf):
    """Threads of conversations whose answers are replies in every other one; the rest goes by gaps, a minute an index."""
    c = t(spark, sf, "conversations")
    base = F.col("conv_id") * 1000
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    nothing = F.lit(None).cast("bigint")
    reply = F.when((F.col("role") == "assistant") & (F.col("conv_id") % 2 == 0), base + before)
    index = base + F.col("turn")
    e = c.select(index.alias("index"), nothing.alias("messageIndex"), nothing.alias("threadRootMessageIndex"), reply.alias("repliesToEventIndex"), (index * 60_000).alias("timestamp"))
    return threads.build_threads(e).select("thread", "index")


@query(
    "case_selection",
    """SELECT item_id, category FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'answerable' WHEN 1 THEN 'refusal' WHEN 2 THEN 'ambiguous' ELSE 'injection' END AS category FROM benchmark)
       WHERE category IN ('refusal', 'injection') ORDER BY item_id LIMIT 10""",
)
def _(spark, sf):
    """The first cases of some categories; the limit is the option's."""
    from .ask import select_cases

    k = F.col("item_id") % 4
    c = t(spark, sf, "benchmark").select("item_id", F.when(k == 0, "answerable").when(k == 1, "refusal").when(k == 2, "ambiguous").otherwise("injection").alias("category"))
    return select_cases(c, ["refusal", "injection"], 10, "item_id")


@query("event_arrays", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def _(spark, sf):
    """Turns written as files of one JSON array each (200 conversations and turns at most of each), and read in splits."""
    from ..sources.splits import array_elements

    c = t(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    bucket = [F.floor(F.col(k) / 200).alias(f"{k}_bucket") for k in ("conv_id", "turn")]
    arrays = c.groupBy(*bucket).agg(F.array_join(F.collect_list(F.to_json(F.struct(*c.columns))), ",\n").alias("rows"))
    path = new_scratch_path(spark, "event-arrays")
    arrays.select(F.concat(F.lit("["), "rows", F.lit("]"))).write.option("maxRecordsPerFile", 1).text(path)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema)
    rows = array_elements(spark, path).select(F.from_json("json", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query(
    "thread_stream",
    """WITH RECURSIVE m AS (SELECT conv_id // 50 AS channel, conv_id * 1000 + turn AS idx, CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN conv_id * 1000 + lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) END AS parent
                           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
       w(channel, idx, up, d) AS (SELECT channel, idx, parent, 1 FROM m WHERE parent IS NOT NULL
                                  UNION ALL SELECT w.channel, w.idx, m.parent, d + 1 FROM w JOIN m ON m.idx = w.up WHERE m.parent IS NOT NULL AND d < 11),
       r AS (SELECT channel, idx, arg_max(up, d) AS root FROM w GROUP BY channel, idx),
       l AS (SELECT channel, idx FROM m WHERE idx NOT IN (SELECT idx FROM r) AND idx NOT IN (SELECT root FROM r)),
       g AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY channel ORDER BY idx) > 45 THEN 1 ELSE 0 END AS brk FROM l),
       s AS (SELECT *, sum(brk) OVER (PARTITION BY channel ORDER BY idx ROWS UNBOUNDED PRECEDING) AS n FROM g),
       f AS (SELECT channel, min(idx) OVER (PARTITION BY channel, n) AS thread, idx FROM s),
       e AS (SELECT max(idx) - 60 AS mark FROM m),
       a AS (SELECT channel, root AS thread, idx FROM r, e WHERE idx < mark UNION SELECT channel, root, root FROM r, e WHERE idx < mark
             UNION SELECT channel, thread, idx FROM f, e WHERE idx + 1440 < mark)
       SELECT channel, thread, idx AS index FROM (SELECT *, row_number() OVER (PARTITION BY channel, thread ORDER BY idx) AS k FROM a) WHERE k <= 40""",
)
def _(spark, sf):
    """The messages of thread_members as a stream in channels of 50 conversations: what is settled when all has been read."""
    from ..streaming.streams import run_to_files
    from ..streaming.threads import thread_stream

    c = t(spark, sf, "conversations").where("conv_id is not null and turn is not null")
    index, nothing = F.col("conv_id") * 1000 + F.col("turn"), F.lit(None).cast("bigint")
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    reply = F.when((F.col("role") == "assistant") & (F.col("conv_id") % 2 == 0), F.col("conv_id") * 1000 + before)
    e = c.select(
        F.floor(F.col("conv_id") / 50).alias("channel"),
        F.timestamp_millis((index + 1440) * 60_000).alias("ts"),  # a row at the epoch would be late from the start
        index.alias("index"),
        nothing.alias("messageIndex"),
        nothing.alias("threadRootMessageIndex"),
        reply.alias("repliesToEventIndex"),
    )
    base = new_scratch_path(spark, "thread-stream")
    e.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{base}/in")
    out = run_to_files(thread_stream(stream, "ts", "channel"), f"{base}/out", f"{base}/state")
    return out.select(F.col("channel").cast("long").alias("channel"), "thread", "index")
