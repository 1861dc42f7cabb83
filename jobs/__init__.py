"""Runnable jobs: ``python -m jobs.ingest_corpus`` and ``python -m jobs.retrieval_report``."""
