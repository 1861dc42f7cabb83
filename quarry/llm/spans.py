"""Operator 4 - substring dedup by sliding sentence spans.

A sentence ends with a word that ends in . ! or ?, or at a line break.  From every sentence starts one span, and one
ends at every sentence: the shortest run of at least ``sentences`` sentences that has ``min_words``
words (by default 1: every run of ``sentences`` sentences).  Thus every sentence of a repeated passage of that many sentences
and words lies in a repeated span.  Span hashes (128 bits over the lower-cased words) meet globally; of equal
spans the first by (id, row, place) stays, and sentences covered by any other one are removed.

A batch sends one row for each of its distinct spans: its later occurrences of a span are
non-first whatever the rest of the corpus holds.  So a passage that a third of all documents
share costs the receiving task one row per batch.

Spans end at sentence ends.  With ``passage_words`` (the query: 51) every window of so many
words counts as well, wherever it starts: a word is also removed if it stands in a non-first
occurrence of such a window, so a longer repeated passage goes whole, whatever its punctuation.  The smallest hash of
the ANCHOR-word runs in a window picks the window's bucket; windows beside each other mostly share it and
are sent as one run of 64-bit hashes.  Text with a period shorter than a window shrinks to its first period.

Rows are told apart by a number and not by their id.  ``dedup_spans`` numbers and writes the rows once, finds and
removes.  ``repeated_spans`` and ``remove_spans`` alone number rows by their place in the plan, which is the same for both
as long as the plan is (a table scan); a column ``__row`` is taken as the number.

Defined results: null and empty texts have no sentences and lose nothing; texts with fewer
sentences or words than a span never lose any; rows with equal ids are separate rows and may lose to each other, the first in the
table stays; null ids come last and stay null; no rows give no
rows; extra columns pass through ``remove_spans``, whose own columns replace others so named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blobs import deal, exchange, gather, runs, schema_of
from .common import buckets_for, scratch, table
from .vectext import mix, text_bytes, word_places

SENTENCES, MIN_WORDS = 2, 1
#: The query's spans have so many words: most shorter ones that repeat are single lines, which line dedup is for.
QUERY_WORDS = 14
PASSAGE_WORDS, ANCHOR = 51, 24  # a passage has over 50 words
NO_ID = (1 << 63) - 1
ROW = "__row"
CHUNK = 2 << 20
SENT = 200_000  # spans that a task holds before it sends them
SENT_WINDOWS = 2_000_000
SCHEMA = "doc_id long, row_no long, start long, n_words long, n_spans long, first_doc_id long"
_STEPS = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_SPAN = ["<u8", "<u8", "<i8", "<i8", "<u4", "<u4"]  # both hash halves (none, holder: known as later), id, row, first word, words
_FOUND = ["<i8", "<i8", "<u4", "<u4", "<i8"]  # id, row, first word, words, id of an earlier holder


def sentence_starts(places: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Indexes of the words that start a sentence."""
    n = len(places)
    if not n:
        return np.zeros(0, np.int64)
    lines = np.cumsum(buf == 10)
    space = np.isin(buf, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    before = np.maximum.accumulate(np.where(space, -1, np.arange(len(buf))))  # last byte of a word at or before
    first = np.zeros(n, dtype=bool)
    first[0] = True
    last = before[places[1:] - 1]
    first[1:] = np.isin(buf[last], np.frombuffer(b".!?", np.uint8)) | (lines[places[1:]] != lines[last])
    first[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(first)


def run_hashes(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of words[a:b] for each pair."""
    out = []
    for step in _STEPS:
        up = np.full(len(words) + 1, np.uint64(step))
        down = np.full(len(words) + 1, np.uint64(pow(step, -1, 1 << 64)))
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)))
        out.append(mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
    return out


def spans_of(words, offsets, places, buf, sentences: int, min_words: int):
    """(document, first word, words, h1, h2) of every span."""
    starts = sentence_starts(places, buf, offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    ends = np.append(starts[1:], len(words)) if len(starts) else starts
    every = np.arange(len(starts))
    # The first sentence at or after i + sentences - 1 that brings min_words words, and so backwards.
    last = np.maximum(every + sentences - 1, np.searchsorted(ends, starts + min_words, "left"))
    first = np.minimum(every - sentences + 1, np.searchsorted(starts, ends - min_words, "right") - 1)
    ahead, behind = last < len(starts), first >= 0
    pairs = np.concatenate((every[ahead] << 32 | last[ahead], first[behind] << 32 | every[behind]))
    pairs = np.unique(pairs)
    i, j = pairs >> 32, pairs & 0xFFFFFFFF
    same = doc[i] == doc[j]
    i, j = i[same], j[same]
    a, b = starts[i], ends[j]
    h1, h2 = run_hashes(words, a, b)
    d = doc[i]
    return d, a - offsets[d], b - a, h1, h2


def windows_of(words: np.ndarray, offsets: np.ndarray, size: int):
    """(document, first word, hash, anchor's place, anchor's hash) of every window of ``size`` words in one text."""
    n = len(words) - size + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.uint64))
    k = min(ANCHOR, size)
    at = np.arange(len(words) - k + 1)
    anchor = run_hashes(words, at, at + k)[0]
    # Sliding minimum by doubling; of equal ones the first place, so that equal windows have equal anchors.
    low, width, want = anchor >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64), 1, size - k + 1
    while width < want:
        step = min(width, want - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    at = np.arange(n)
    doc = np.searchsorted(offsets, at, "right") - 1
    at = at[at + size <= offsets[doc + 1]]
    doc, place = np.searchsorted(offsets, at, "right") - 1, (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return doc, at - offsets[doc], run_hashes(words, at, at + size)[1], place, anchor[place]


def later_windows(h, i, row, a, size: int):
    """Of windows in the order (id, row, place): which are the first of their hash, and (id, row, start, words, holder) of the later ones' stretches."""
    order = np.argsort(h, kind="stable")
    start, count = runs(h[order])
    first = np.zeros(len(h), bool)
    first[order[start]] = True
    at = np.flatnonzero(~first)
    holder = np.empty(len(h), np.int64)
    holder[order] = np.repeat(i[order[start]], count)
    # Windows that start at neighbouring words of one text are one stretch.
    new = np.concatenate(([True], (row[at[1:]] != row[at[:-1]]) | (a[at[1:]] != a[at[:-1]] + 1))) if len(at) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    length = np.diff(head, append=len(at))
    at = at[head]
    return first, (i[at], row[at], a[at], length + size - 1, holder[at])


def chunks_of(batch: pa.RecordBatch):
    """(ids, rows, texts) of stretches of about CHUNK bytes of a batch (id, row, text)."""
    ids = np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], dtype=np.int64)
    rows = np.array(batch.column(1).to_pylist(), dtype=np.int64)
    texts, at = text_bytes(batch.column(2)), 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (size < CHUNK or stop == at):
            size += len(texts[stop])
            stop += 1
        yield ids[at:stop], rows[at:stop], texts[at:stop], stop == len(texts)
        texts[at:stop] = [None] * (stop - at)
        at = stop


def repeated_windows(texts: DataFrame, size: int, partitions: int, few: int) -> DataFrame:
    """found() rows of the non-first windows of ``size`` words of texts (id, row, text)."""

    def flush(parts):
        i, row, a, h, place, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((a, row, i))
        i, row, a, h, place, key = (x[order] for x in (i, row, a, h, place, key))
        first, stretches = later_windows(h, i, row, a, size)
        none = np.zeros(len(stretches[0]), "<u8")
        if len(none):
            yield heads(place_of(stretches[1], partitions), *stretches, np.ones(len(none), np.int64), none)
        i, row, a, h, place, key = (x[first] for x in (i, row, a, h, place, key))
        if len(h):
            same = (row[1:] == row[:-1]) & (place[1:] == place[:-1]) & (a[1:] == a[:-1] + 1)
            at = np.flatnonzero(np.concatenate(([True], ~same)))
            length = np.diff(at, append=len(h))
            bucket = (key[at] % np.uint64(partitions)).astype(np.int32)
            yield heads(bucket, i[at], row[at], a[at], np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), length, h)

    def heads(bucket, i, row, a, n, holder, length, h):
        """One row a bucket: id, row, start, words (0: a run of first windows), holder and number of hashes of each run; and the hashes."""
        arrays = zip((i, row, a, n, holder, length), [*_FOUND, "<u4"], strict=True)
        runs_ = deal(bucket, [x.astype(t) for x, t in arrays])
        values = deal(np.repeat(bucket, length), [h.astype("<u8")])
        columns = [*runs_.columns, values.columns[1]]
        return pa.RecordBatch.from_arrays(columns, ["bucket", *(f"a{j}" for j in range(len(columns) - 1))])

    def send(batches):
        parts, held, sent = [], 0, 0
        for b in batches:
            for ids, rows, texts, _ in chunks_of(b):
                d, a, h, place, key = windows_of(*word_places(texts)[:2], size)
                parts.append((ids[d], rows[d], a, h, place + sent, key))
                held += len(d)
                sent += 1 << 40  # places of different chunks differ
                if held >= SENT_WINDOWS:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)

    def receive(batches):
        i, row, a, n, holder, length, h = gather(batches, [*_FOUND, "<u4", "<u8"])
        if not len(i):
            return
        known = n > 0
        if known.any():
            yield found(i[known], row[known], a[known], n[known], holder[known], few)
        h = h[~np.repeat(known, length)]
        i, row, a, length = i[~known], row[~known], a[~known].astype(np.int64), length[~known].astype(np.int64)
        if not len(h):
            return
        a = np.repeat(a - np.cumsum(length) + length, length) + np.arange(len(h))
        i, row = np.repeat(i, length), np.repeat(row, length)
        order = np.lexsort((a, row, i))
        stretches = later_windows(h[order], i[order], row[order], a[order], size)[1]
        if len(stretches[0]):
            yield found(*stretches, few)

    return exchange(texts.mapInArrow(send, schema_of(7)), partitions).mapInArrow(receive, schema_of(5))


def numbered(docs: DataFrame) -> DataFrame:
    return docs if ROW in docs.columns else docs.withColumn(ROW, F.monotonically_increasing_id())


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: int = SENTENCES,
    min_words: int = MIN_WORDS,
    passage_words: int | None = None,
) -> DataFrame:
    """Stretches to remove: doc_id, row_no, start and n_words (words), n_spans, first_doc_id.

    n_spans: spans, and with ``passage_words`` runs of windows, in the stretch.  first_doc_id: a document
    that holds the stretch's first span earlier.
    """
    texts = numbered(docs).select(F.col(id_col).cast("long"), ROW, F.col(text_col))
    partitions = buckets_for(texts)
    few = max(1, partitions // 8)  # later occurrences are few beside all spans

    def send(batches):
        parts, held = [], 0
        for b in batches:
            for ids, rows, texts, last in chunks_of(b):
                d, a, n, h1, h2 = spans_of(*word_places(texts), sentences, min_words)
                parts.append((h1, h2, ids[d], rows[d], a, n))
                held += len(d)
                if held >= SENT:
                    yield from first_and_later(*(np.concatenate(x) for x in zip(*parts, strict=True)), partitions)
                    parts, held = [], 0
        if held:
            yield from first_and_later(*(np.concatenate(x) for x in zip(*parts, strict=True)), partitions)

    def receive(batches):
        later, first = [], []
        for b in batches:
            known = np.array([len(x) == 0 for x in b.column(1).to_pylist()], dtype=bool)
            later.append(b.filter(pa.array(known)))
            first.append(b.filter(pa.array(~known)))
        _, holder, i, row, a, n = gather(later, _SPAN)
        if len(i):
            yield found(i, row, a, n, holder.view(np.int64), few)
        h1, h2, i, row, a, n = gather(first, _SPAN)
        new, holder, (i, row, a, n) = ordered(h1, h2, i, row, a, n)[:3]
        if not new.all():
            yield found(i[~new], row[~new], a[~new], n[~new], holder[~new], few)

    def merge(batches):
        i, row, a, n, first = gather(batches, _FOUND)
        if not len(i):
            return
        order = np.lexsort((first, n, a, row))
        i, row, a, n, first = i[order], row[order], a[order].astype(np.int64), n[order].astype(np.int64), first[order]
        # Stretches: spans of a row that touch or overlap.
        start, count = runs(row)
        base = np.repeat(np.arange(len(start)), count) * (1 << 40)
        reach = np.maximum.accumulate(base + a + n)
        new = np.concatenate(([True], base[1:] + a[1:] > reach[:-1]))
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(i)) - 1
        real = lambda x: pa.array(x, pa.int64(), mask=x == NO_ID)
        yield pa.RecordBatch.from_arrays(
            [real(i[at]), pa.array(row[at]), pa.array(a[at]), pa.array(reach[stop] - base[at] - a[at]), pa.array(np.diff(np.append(at, len(i)))), real(first[at])],
            [f.split()[0] for f in SCHEMA.split(", ")],
        )

    later = exchange(texts.mapInArrow(send, schema_of(6)), partitions).mapInArrow(receive, schema_of(5))
    if passage_words:
        later = later.unionByName(repeated_windows(texts, passage_words, partitions, few))
    return exchange(later, few).mapInArrow(merge, SCHEMA)


def place_of(row: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(row.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def found(i, row, a, n, first, buckets: int) -> pa.RecordBatch:
    return deal(place_of(row, buckets), [x.astype(t) for x, t in zip((i, row, a, n, first), _FOUND, strict=True)])


def ordered(h1, h2, i, row, a, n):
    """Spans by hash and then (id, row, place): which are the first of their hash, the first's id, the other columns and the hashes."""
    order = np.lexsort((a, row, i, h2, h1))
    h1, h2, i, row, a, n = (x[order] for x in (h1, h2, i, row, a, n))
    new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))) if len(h1) else np.zeros(0, bool)
    holder = i[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h1) else i
    return new, holder, (i, row, a, n), (h1, h2)


def first_and_later(h1, h2, i, row, a, n, buckets: int):
    """Mapper rows: first spans dealt by hash; those known as later ones have no hash, and their holder in its second half's place."""
    new, holder, rest, (h1, h2) = ordered(h1, h2, i, row, a, n)
    cast = lambda arrays: [x.astype(t, copy=False) for x, t in zip(arrays, _SPAN, strict=True)]
    yield deal((h1[new] % np.uint64(buckets)).astype(np.int32), cast([h1[new], h2[new], *(x[new] for x in rest)]))
    if not new.all():
        out = deal(place_of(rest[1][~new], buckets), cast([h1[~new], holder[~new].view(np.uint64), *(x[~new] for x in rest)]))
        yield out.set_column(1, "a0", pa.array([b""] * out.num_rows, pa.binary()))


def _cut(batches):
    for b in batches:
        at, gone_at = b.schema.get_field_index("__text"), b.schema.get_field_index("__gone")
        kept = []
        for text, gone in zip(text_bytes(b.column(at)), b.column(gone_at).to_pylist(), strict=True):
            if gone:
                _, _, places, _ = word_places([text])
                edges = [*places.tolist(), len(text)]
                out, last = [], 0
                for g in sorted(gone, key=lambda g: g["start"]):
                    out.append(text[last : edges[g["start"]]])
                    last = edges[min(g["start"] + g["n_words"], len(places))]
                text = b"".join([*out, text[last:]])
            kept.append(text)
        keep = [i for i in range(b.num_columns) if i not in (at, gone_at)]
        names = [b.schema.field(i).name for i in keep]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "kept_text"])


def remove_spans(docs: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with kept_text instead of its text.  spans: repeated_spans() of the same docs."""
    lost = spans.groupBy("row_no").agg(F.collect_list(F.struct("start", "n_words")).alias("__gone"))  # at most a text's own stretches
    rest = [c for c in docs.columns if c not in (text_col, "kept_text", "__text", "__gone", ROW)]
    joined = numbered(docs).select(ROW, *[F.col(f"`{c}`") for c in rest], F.col(text_col).alias("__text"))
    joined = joined.join(lost.withColumnRenamed("row_no", ROW), ROW, "left").drop(ROW)
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(_cut, schema)


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with kept_text instead of its text; rows are numbered and written once.  options: those of repeated_spans."""
    rows = scratch(docs.drop(ROW).withColumn(ROW, F.monotonically_increasing_id()), "spans-rows")
    return remove_spans(rows, repeated_spans(rows, id_col, text_col, **options), text_col)


def op4_sentence_spans(spark, sf_dir):
    """Every stretch of sentences, and every passage of over 50 words, that an earlier place of the corpus already holds."""
    return repeated_spans(table(spark, sf_dir, "documents"), min_words=QUERY_WORDS, passage_words=PASSAGE_WORDS)
