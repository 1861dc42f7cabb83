"""Schemas of the stored entities."""

CHUNK = (
    "id string, source_type string, title string, text string, url string, meta variant, provenance variant, "
    "content_hash string, status string"
)
CASE = "id string, category string, question string, expected_chunk_ids array<string>, must_mention array<string>, must_not_mention array<string>, notes string"
EVENT = (
    "index bigint, timestamp bigint, messageIndex bigint, senderId string, text string, threadRootMessageIndex bigint, "
    "repliesToEventIndex bigint, reactions map<string,int>, isBot boolean, deleted boolean"
)
LOG = (
    "ts timestamp, question string, strategy string, retrieved array<string>, cited array<string>, refused boolean, "
    "confidence double, latency_ms bigint, unresolved_citations array<string>"
)
EMBEDDING = "model string, key string, embedding array<float>"

SOURCE_TYPES = ("faq", "blog", "guidelines", "terms", "help_channel", "manual")
CATEGORIES = ("answerable", "refusal", "ambiguous", "injection")
#: Least number of cases of each category, and of all.
CATEGORY_MINIMUMS = {"answerable": 25, "refusal": 8, "ambiguous": 4, "injection": 3}
LEAST_CASES = 40
