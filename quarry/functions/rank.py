"""Functions over ranked id arrays and expected-id groups (an AND of ORs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recall_at_k(expected: Column, retrieved: Column, k: int) -> Column:
    """Share of the expected groups with an alternate among the first k; null without groups."""
    top = F.slice(retrieved, 1, k)
    hits = F.size(F.filter(expected, lambda g: F.arrays_overlap(g, top)))
    return hits / F.nullif(F.size(expected), F.lit(0))


def flat_ids(expected: Column) -> Column:
    return F.array_distinct(F.flatten(expected))


def reciprocal_rank(expected: Column, retrieved: Column) -> Column:
    """1 / place of the first retrieved id that any group names, 0 without one."""
    wanted = flat_ids(expected)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(retrieved), F.lit(1))), lambda i: F.array_contains(wanted, F.get(retrieved, i - 1)))
    return F.coalesce(F.lit(1.0) / F.array_min(places), F.lit(0.0))


def normalise_expected(raw: Column) -> Column:
    """array<string> whose entries may be JSON lists to array<array<string>>."""
    return F.transform(raw, lambda e: F.when(e.startswith("["), F.from_json(e, "array<string>")).otherwise(F.array(e)))


def kept_citations(citations: Column, retrieved: Column) -> Column:
    """Citations that were retrieved, in order and with repeats."""
    return F.filter(citations, lambda c: F.array_contains(retrieved, c))


def unresolved(citations: Column, known: Column) -> Column:
    return F.filter(citations, lambda c: ~F.array_contains(known, c))
