"""The jobs as queries: each runs twice into one new folder and gives what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.catalogue import bm25_sql, packed_sql, sentences_sql, tidy_sql
from quarry.storage import shared_dir

from . import ingest_corpus, retrieval_report


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_ingest_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as chunks; the second run finds nothing new.  The glob is there as a stream's path can't be a plain file."""
    folder = _folder(spark, "ingest-corpus")
    for _ in range(2):
        out = ingest_corpus.run(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/corpus", f"{folder}/checkpoint")
    return out


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages as questions, in all documents; the second run writes the same again."""
    folder = _folder(spark, "retrieval-report")
    for _ in range(2):
        out = retrieval_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{folder}/report")
    return out


QUERIES = {"job1_ingest_corpus": job1_ingest_corpus, "job2_retrieval_report": job2_retrieval_report}

_PARTS = packed_sql("string_split(text, chr(10) || chr(10))", "chr(10) || chr(10)", 2, 1500)
_FINE = packed_sql(sentences_sql("p"), "' '", 1, 1500)
_MEASURES = ", ".join([*(f"CAST(coalesce(place, 99) <= {k} AS DOUBLE) AS recall_{k}" for k in (1, 3, 5, 10)), "round(coalesce(1.0 / place, 0.0), 6) AS rr"])
_MEANS = ", ".join(f"round(avg({c}), 4) AS {c}" for c in ("recall_1", "recall_3", "recall_5", "recall_10"))

SQL = {
    "job1_ingest_corpus": f"""
WITH d AS (SELECT doc_id, lang, coalesce(nullif(source, ''), 'unknown') AS source, {tidy_sql("text")} AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
  c AS (SELECT *, CASE WHEN length(text) <= 1500 THEN [text] ELSE {_PARTS} END AS parts, length(text) <= 1500 AS whole FROM d WHERE text <> ''),
  u AS (SELECT doc_id, lang, source, whole, unnest(parts) AS p, generate_subscripts(parts, 1) AS n FROM c),
  s AS (SELECT doc_id, lang, source, n, CASE WHEN whole OR length(p) <= 1500 THEN [p] ELSE {_FINE} END AS fine FROM u),
  f AS (SELECT doc_id, lang, source, n, unnest(fine) AS text, generate_subscripts(fine, 1) AS m FROM s),
  g AS (SELECT doc_id, lang, source, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, m) - 1 AS INTEGER) AS part, substr(sha256(text), 1, 16) AS content_hash FROM f)
SELECT concat_ws(':', source, doc_id, content_hash) AS id, doc_id, part, lang, text, CAST(length(text) AS INTEGER) AS chars, content_hash, CAST(0 AS BIGINT) AS batch, source
FROM g QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id, part) = 1""",
    "job2_retrieval_report": bm25_sql()
    + f""", held AS (SELECT DISTINCT item_id AS question_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
  cases AS (SELECT question_id, count(*) AS holders, CASE WHEN count(*) = 1 THEN 'single' ELSE 'several' END AS category FROM held GROUP BY question_id),
  grid AS (SELECT question_id, doc_id AS id FROM cases CROSS JOIN documents),
  lt AS (SELECT item_id AS question_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark),
  lm AS (SELECT question_id, doc_id AS id, count(*) AS score FROM lt JOIN post USING (term) GROUP BY ALL),
  lr AS (SELECT question_id, id, lm.score, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(lm.score, 0) DESC, id) AS rank FROM grid LEFT JOIN lm USING (question_id, id)),
  fr AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(bs.score, 0) DESC, id) AS rank FROM grid LEFT JOIN bs USING (question_id, id)),
  v AS (SELECT question_id, id, rank FROM lr WHERE rank <= 30 UNION ALL SELECT question_id, id, rank FROM fr WHERE rank <= 30),
  fs AS (SELECT question_id, id, round(sum(1.0 / (60 + rank)), 8) AS score FROM v GROUP BY ALL),
  ranked AS (
    SELECT 'lexical' AS strategy, question_id, id, rank FROM lr WHERE score IS NOT NULL
    UNION ALL SELECT 'bm25', question_id, id, rank FROM br
    UNION ALL SELECT 'hybrid', question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) FROM fs),
  top AS (SELECT strategy, question_id, string_agg(id, ',' ORDER BY rank) AS retrieved, min(rank) FILTER (WHERE held.id IS NOT NULL) AS place
          FROM (SELECT * FROM ranked WHERE rank <= 10) r LEFT JOIN held USING (question_id, id) GROUP BY ALL),
  sc AS (SELECT s.strategy, c.*, coalesce(retrieved, '') AS retrieved, {_MEASURES}
         FROM cases c CROSS JOIN (VALUES ('lexical'), ('bm25'), ('hybrid')) s(strategy) LEFT JOIN top t ON t.strategy = s.strategy AND t.question_id = c.question_id)
SELECT CAST(question_id AS VARCHAR) AS name, CAST(1 AS BIGINT) AS cases, holders, recall_1, recall_3, recall_5, recall_10, rr, retrieved, strategy, 'case' AS level FROM sc
UNION ALL SELECT category, count(*), CAST(sum(holders) AS BIGINT), {_MEANS}, round(avg(rr), 4), NULL, strategy, CASE WHEN GROUPING(category) = 0 THEN 'category' ELSE 'all' END
FROM sc GROUP BY GROUPING SETS ((strategy, category), (strategy))""",
}
