"""Readers and writers of chunks, cases, events, decisions, embeddings and logs."""
