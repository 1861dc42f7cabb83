"""Operator 5 - n-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of distinct word shingles; two link when |x & y| / |x | y| reaches
num / den.  A link needs need(n) = ceil(n * num / den) common shingles of either set of n, so of any
n - need(n) + l shingles of x (an l-match prefix) at least l are in y.

1. Classes: equal sets are one class, represented by its least id.
2. Pruning: every document sends a multi-match prefix in hash order; one that meets too few of
   its shingles elsewhere can't link and leaves.
3. Order: among the classes left, shingles are ordered by how many classes have them, rarest
   first.  Classes with fewer than need(n) shared shingles leave; the others' 1-match prefixes
   in this order connect them into loose clusters, which no link crosses.
4. Join: a cluster is joined in memory.  Each probe lengthens its prefix while the candidates it
   sheds, at the cost of verifying them, outweigh the postings it has to read, and requires
   correspondingly more shared prefix shingles before an exact count.  Pairs that links already
   connect are not counted again, so a large group of copies costs a pass for a few probes and
   never all its pairs.  Clusters over ``block_tokens`` shingles are first thinned out around a
   pivot, then split: every two of their blocks meet in one task, and the links are connected.

Values move as arrays (see blobs).  No step sends pairs of a group.

Defined results: a null or empty text and one without words has no shingles and component_id
its own id; fewer than k words are one shingle; rows with equal ids are one document for
linking; a null id links by its text and is returned as null, never as the least id
unless it is alone; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import deal, deal_owned, exchange, gather, runs, schema_of
from .common import buckets_for, mark, new_scratch_path, release, scratch, scratch_at, table
from .components import connected_components
from .vectext import mix, shingle_hashes, text_bytes, word_hashes

K, NUM, DEN = 5, 80, 100
NO_ID = (1 << 63) - 1
NOBODY = -NO_ID
SENT = 500_000  # shingles that a task holds before it sends them
SAMPLE = 5  # one shingle in so many is a required match of the pruning prefix
CHUNK = 2 << 20


def need(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def sample_match(n: int, num: int, den: int) -> int:
    """Matches that the pruning prefix, of n - need(n) + so many shingles, must have."""
    return min(need(n, num, den), -(-n // SAMPLE))


def document_sets(batch: pa.RecordBatch, k: int):
    """(id, sorted distinct shingle hashes) of each row; memory follows CHUNK and the longest text."""
    ids = [NO_ID if i is None else i for i in batch.column(0).to_pylist()]
    texts, at, n = text_bytes(batch.column(1)), 0, batch.num_rows
    while at < n:
        stop, size = at, 0
        while stop < n and (size < CHUNK or stop == at):
            size += len(texts[stop])
            stop += 1
        hashes, offsets = shingle_hashes(*word_hashes(texts[at:stop]), k)
        for i in range(at, stop):
            s = hashes[offsets[i - at] : offsets[i - at + 1]]
            yield ids[i], np.unique(s)
        at = stop


def summaries(k: int):
    def run(batches):
        for b in batches:
            ids, sizes, prints = [], [], []
            for i, s in document_sets(b, k):
                ids.append(i)
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
            p = np.frombuffer(b"".join(prints), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["id", "n", "p1", "p2"]
            )

    return run


def shared_counts(docs: DataFrame, k: int, num: int, den: int, partitions: int) -> DataFrame:
    """(id, shared): how many shingles of each document's pruning prefix other documents send too.

    The prefix is in hash order and allows sample_match(n) matches: a document that links has at
    least so many shared shingles in it, less one for rounding.  Shingles travel as 48 bits besides their bucket; equal
    ones of different shingles only prune less.  A batch sends one row for a shingle that several of its
    documents have and counts it for them at once, so that a shingle of a third of all
    documents reaches its task once a batch.
    """

    few = max(1, partitions // 4)  # the sums are small beside the shingles

    def send(batches):
        for b in batches:
            tokens, owners, held = [], [], 0
            for i, s in document_sets(b, k):
                n = len(s)
                tokens.append(s[: n - need(n, num, den) + sample_match(n, num, den)])
                owners.append(np.full(len(tokens[-1]), i, dtype=np.int64))
                held += len(tokens[-1])
                if held >= SENT:
                    yield from dealt(np.concatenate(tokens), np.concatenate(owners))
                    tokens, owners, held = [], [], 0
            if held:
                yield from dealt(np.concatenate(tokens), np.concatenate(owners))

    def dealt(t, o):
        _, inverse, count = np.unique(t, return_inverse=True, return_counts=True)
        often = count[inverse] > 1
        first = np.zeros(len(count), dtype=np.int64)
        first[inverse[::-1]] = np.arange(len(t))[::-1]
        sent = ~often
        sent[first[count > 1]] = True
        speaker = np.where(often, NOBODY, o)[sent]
        t = t[sent]
        yield deal_owned(((t >> np.uint64(48)) % np.uint64(partitions)).astype(np.int32), speaker, [t.astype("<u4"), (t >> np.uint64(32)).astype("<u2")])
        who, counts = np.unique(o[often], return_counts=True)
        if len(who):
            known = deal((mix(who.view(np.uint64)) % np.uint64(partitions)).astype(np.int32), [who, counts.astype("<u4")])
            empty = pa.array([b""] * known.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*known.columns, empty, empty], ["bucket", "a0", "a1", "a2", "a3"])

    def count(batches):
        known, rest = [], []
        for b in batches:
            is_known = np.array([len(x) == 0 for x in b.column(3).to_pylist()], dtype=bool)
            known.append(b.filter(pa.array(is_known)))
            rest.append(b.filter(pa.array(~is_known)))
        ids, counts = gather(known, ["<i8", "<u4"])
        owner, length, low, high = gather(rest, ["<i8", "<u4", "<u4", "<u2"])
        owner = np.repeat(owner, length)
        t = (high.astype(np.uint64) << np.uint64(32)) | low
        order = np.argsort(t, kind="stable")
        _, c = runs(t[order])
        shared = owner[order][np.repeat(c, c) > 1]
        who, n = np.unique(np.concatenate((shared[shared != NOBODY], np.repeat(ids, counts))), return_counts=True)
        if len(who):
            yield deal((mix(who.view(np.uint64)) % np.uint64(few)).astype(np.int32), [who, n.astype("<u4")])

    def total(batches):
        who, n = gather(batches, ["<i8", "<u4"])
        order = np.argsort(who, kind="stable")
        start, _ = runs(who[order])
        if len(start):
            sums = np.add.reduceat(n[order].astype(np.int64), start)
            yield pa.RecordBatch.from_arrays([pa.array(who[order][start]), pa.array(sums)], ["id", "shared"])

    out = docs.mapInArrow(send, schema_of(4))
    for n, step, schema in ((partitions, count, schema_of(2)), (few, total, "id long, shared long")):
        out = exchange(out, n).mapInArrow(step, schema)
    return out


def set_rows(k: int):
    def run(batches):
        for b in batches:
            ids, sets = [], []
            for i, s in document_sets(b, k):
                ids.append(i)
                sets.append(s)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "tokens"])

    return run


def list_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an Arrow list<long> column."""
    lengths = np.array([len(x) for x in column], dtype=np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate(([0], np.cumsum(lengths)))


def cluster_edges(sets: DataFrame, num: int, den: int, partitions: int) -> DataFrame:
    """(a, b): each class and the least class that shares a shingle of their rarest-first prefixes."""

    def place(x):
        return (mix(x.view(np.uint64)) % np.uint64(partitions)).astype(np.int32)

    def by_token(batches):
        for b in batches:
            values, offsets = list_parts(b.column(1))
            ids = np.array(b.column(0).to_pylist(), dtype=np.int64)
            if len(values):
                yield deal_owned(place(values), np.repeat(ids, np.diff(offsets)), [values])

    def count(batches):
        owner, length, t = gather(batches, ["<i8", "<u4", "<u8"])
        owner = np.repeat(owner, length)
        _, inverse, c = np.unique(t, return_inverse=True, return_counts=True)
        df = c[inverse]
        # Shingles of one class only are sent back as their number: they fill the front of its prefix.
        alone, n_alone = np.unique(owner[df == 1], return_counts=True)
        on = df > 1
        who = np.concatenate((owner[on], alone))
        order = np.argsort(who, kind="stable")
        values = np.concatenate((t[on], n_alone.astype("<u8")))[order]
        degree = np.concatenate((df[on], np.zeros(len(alone), df.dtype)))[order].astype("<u4")
        if len(who):
            yield deal_owned(place(who[order]), who[order], [values, degree])

    def prefixes(batches):
        owner, length, t, df = gather(batches, ["<i8", "<u4", "<u8", "<u4"])
        if not len(t):
            return
        owner = np.repeat(owner, length)
        order = np.lexsort((t, df, owner))
        owner, t, df = owner[order], t[order], df[order]
        start, count = runs(owner)
        alone = np.add.reduceat(np.where(df == 0, t, np.uint64(0)), start).astype(np.int64)
        marks = np.add.reduceat((df == 0).astype(np.int64), start)
        n = count - marks + alone
        length = np.maximum(0, n + n * num // -den + 1 - alone)  # n - need(n) + 1 less the lonely ones
        position = np.arange(len(t)) - np.repeat(start + marks, count)
        on = (position >= 0) & (position < np.repeat(length, count))
        if on.any():
            yield deal(place(t[on]), [t[on], owner[on]])

    def edges(batches):
        t, i = gather(batches, ["<u8", "<i8"])
        if not len(t):
            return
        order = np.lexsort((i, t))
        t, i = t[order], i[order]
        start, c = runs(t)
        low = np.repeat(i[start], c)
        pairs = np.unique(np.stack([i[i != low], low[i != low]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    steps = [(by_token, schema_of(3)), (count, schema_of(4)), (prefixes, schema_of(2)), (edges, "a long, b long")]
    out = sets
    for i, (step, schema) in enumerate(steps):
        out = (exchange(out, partitions) if i else out).mapInArrow(step, schema)
    return out.distinct()


def join_block(ids: list[int], sets: list[np.ndarray], num: int, den: int, max_match: int = 8) -> list[int]:
    """For each member the least id its links lead to inside the block."""
    m = len(ids)
    sizes = np.array([len(s) for s in sets])
    _, flat, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    postings = owner[np.argsort(flat, kind="stable")]  # documents of token 0, of token 1, ...
    first = np.concatenate(([0], np.cumsum(df)))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    label = np.arange(m)
    members: dict[int, list[int]] = {i: [i] for i in range(m)}
    probed = np.zeros(m, dtype=bool)

    counts = np.zeros(m, dtype=np.int64)  # cleared after each probe where it was touched

    def read(tokens: np.ndarray) -> np.ndarray:
        """Count the members that have these shingles; gives them, with repeats."""
        found = np.concatenate([postings[first[t] : first[t + 1]] for t in tokens]) if len(tokens) else np.zeros(0, np.int64)
        np.add.at(counts, found, 1)
        return found

    def open_ones(found: np.ndarray, x: int, least: int) -> np.ndarray:
        """Members among ``found`` that may still link to x and that no link connects to it already."""
        found = np.unique(found)
        n = sizes[x]
        return found[(counts[found] >= least) & (label[found] != label[x]) & (sizes[found] * num <= n * den) & (n * num <= sizes[found] * den)]

    def probe(x: int) -> None:
        tokens = flat[bounds[x] : bounds[x + 1]]
        tokens = tokens[np.argsort(df[tokens], kind="stable")]  # rarest first
        n = len(tokens)
        base = n - need(n, num, den)
        touched = [read(tokens[:base])]
        match, candidates, shed = 0, None, 0
        while base + match < n and match < max_match:  # lengthen the prefix while that pays
            t = tokens[base + match]
            if candidates is not None and df[t] >= shed * n // 8:
                break
            touched.append(read(tokens[base + match : base + match + 1]))
            match += 1
            before = touched if candidates is None else [candidates]  # a candidate of more matches was one of fewer
            found = open_ones(np.concatenate(before), x, match)
            shed = len(found) if candidates is None else max(1, len(candidates) - len(found))
            candidates = found
            if not len(found):
                break
        if candidates is not None and len(candidates):
            if len(candidates) > 32:  # one pass over the rest of the postings counts them all
                touched.append(read(tokens[base + match :]))
                common = counts[candidates]
            else:
                mine = np.sort(tokens)
                common = np.array([np.isin(mine, flat[bounds[y] : bounds[y + 1]], assume_unique=True).sum() for y in candidates])
            union = sizes[candidates] + n - common
            for y in candidates[den * common >= num * union]:
                a, b = label[x], label[y]
                if a != b:
                    if len(members[a]) < len(members[b]):
                        a, b = b, a
                    label[members[b]] = a
                    members[a] += members.pop(b)
        for found in touched:
            counts[found] = 0

    # Whatever stays outside the largest group must have been probed; the largest need not be.
    center = int(np.argmax(np.add.reduceat(np.append(df[flat], 0), bounds[:-1]) / np.maximum(sizes, 1)))
    probed[center] = True
    probe(center)
    while True:
        big = max(members, key=lambda r: len(members[r]))
        rest = np.flatnonzero(~probed & (label != big))
        if not len(rest):
            break
        for x in rest.tolist():
            if label[x] != big and not probed[x]:
                probed[x] = True
                probe(x)
    least = {r: min(ids[i] for i in group) for r, group in members.items()}
    return [least[r] for r in label.tolist()]


def join_blocks(num: int, den: int):
    """Arrow map over partitions sorted by (cluster, part): (id, root) of members that link."""

    def flush(ids, sets):
        roots = join_block(ids, sets, num, den)
        pairs = [(i, r) for i, r in zip(ids, roots, strict=True) if i != r]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    def run(batches):
        key, ids, sets = None, [], []
        for b in batches:
            values, offsets = list_parts(b.column(3))
            for j, k in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if k != key:
                    if len(ids) > 1:
                        yield flush(ids, sets)
                    key, ids, sets = k, [], []
                ids.append(b.column(2)[j].as_py())
                sets.append(values[offsets[j] : offsets[j + 1]].copy())
        if len(ids) > 1:
            yield flush(ids, sets)

    return run


def around_pivots(placed: DataFrame, large: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Large clusters thinned out by one pivot each: (placed with ``blocks``, links to pivots).

    The Jaccard distance is a metric.  Members that link to the pivot are connected already; one of
    them can only matter to a member x that doesn't link to the pivot, and only if its own
    distance to the pivot is within the threshold of x's.  The others leave, so a group of near
    copies around its pivot costs one pass over it, however large it is.
    """
    inside = placed.join(large, "component")
    first = inside.groupBy("component").agg(F.min_by(F.struct("id", "tokens"), "id").alias("pivot"))
    first = scratch(first, "jaccard-pivots")
    common = F.size(F.array_intersect("tokens", "pivot.tokens"))
    union = F.size("tokens") + F.size("pivot.tokens") - common
    measured = scratch(
        inside.join(first, "component").select("component", "id", "tokens", "blocks", F.col("pivot.id").alias("pivot"), (1 - common / union).alias("far"), (common * den >= union * num).alias("near")),
        "jaccard-measured",
    )
    least = measured.where("not near").groupBy("component").agg(F.min("far").alias("least"))
    reach = (den - num) / den + 1e-9
    rest = measured.join(least, "component").where(~F.col("near") | (F.col("far") >= F.col("least") - reach))
    small = placed.join(large, "component", "left_anti").withColumn("blocks", F.lit(None).cast("int"))
    links = measured.where("near and id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    return small.select("component", "id", "tokens", "blocks").unionByName(rest.select("component", "id", "tokens", "blocks")), links


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = K,
    num: int = NUM,
    den: int = DEN,
    block_tokens: int = 4_000_000,
    broadcast_ids: int = 1_000_000,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, class_id (least id of the equal set).

    block_tokens: shingles joined in one task's memory.  broadcast_ids: up to so many ids of
    active classes are broadcast (8 MB); beyond that the texts are shuffled to them.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    partitions = buckets_for(texts)
    since = mark()
    kept = new_scratch_path(spark, "jaccard-docs"), new_scratch_path(spark, "jaccard-labels")
    all_docs = scratch_at(texts.mapInArrow(summaries(k), "id long, n long, p1 long, p2 long"), kept[0])
    classes = all_docs.where("n > 0").groupBy("p1", "p2").agg(F.min("id").alias("class_id"))
    # Of a linked pair the larger set gains at least as many needed shingles as allowed matches, but for rounding.
    required = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") * num / den), F.ceil(F.col("n") / SAMPLE)) - 1)
    met = all_docs.join(shared_counts(texts, k, num, den, partitions), "id").where(F.col("shared") >= required)
    active = classes.join(met.select("p1", "p2").distinct(), ["p1", "p2"]).select(F.col("class_id").alias("__id"))
    active = scratch(active.distinct(), "jaccard-active")
    few = active.count() <= broadcast_ids
    chosen = texts.withColumn("__id", F.coalesce(F.col(id_col), F.lit(NO_ID))).join(
        F.broadcast(active) if few else active, "__id", "left_semi"
    )
    sets = scratch(chosen.select(id_col, text_col).mapInArrow(set_rows(k), "id long, tokens array<long>"), "jaccard-sets")
    loose = connected_components(cluster_edges(sets, num, den, partitions))
    placed = sets.join(loose, "id")
    mass = placed.groupBy("component").agg(F.sum(F.size("tokens")).alias("mass"))
    large = scratch(mass.where(F.col("mass") > block_tokens).select("component", F.ceil(2 * F.col("mass") / block_tokens).cast("int").alias("blocks")), "jaccard-large")
    n_large = large.count()
    if n_large:
        placed, near = around_pivots(placed, large, num, den)
        mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        parts = F.transform(
            F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != mine), lambda j: F.least(j, mine).cast("long") * 2**31 + F.greatest(j, mine)
        )
        placed = placed.withColumn("part", F.explode(F.when(F.col("blocks") > 1, parts).otherwise(F.array(F.lit(0).cast("long")))))
    else:
        placed = placed.withColumn("part", F.lit(0).cast("long"))
    links = (
        placed.select("component", "part", "id", "tokens")
        .repartition(partitions, "component", "part")
        .sortWithinPartitions("component", "part", "id")
        .mapInArrow(join_blocks(num, den), "a long, b long")
    )
    if n_large:
        links = links.unionByName(near)
    links = scratch(links, "jaccard-links")
    roots = connected_components(links) if n_large else links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = classes.join(roots, classes["class_id"] == roots["id"], "left").select(
        "p1", "p2", "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    labels = scratch_at(labels, kept[1])
    release(spark, since, kept)
    # Both sides of the last join are plain exchanges: a hot class can be split
    out = all_docs.join(labels, ["p1", "p2"], "left")
    real = lambda c: F.nullif(c, F.lit(NO_ID))
    linked = F.col("n") > 0
    return out.select(
        real(F.col("id")).alias(id_col),
        F.col("n").alias("n_shingles"),
        real(F.when(linked, F.col("component_id")).otherwise(F.col("id"))).alias("component_id"),
        real(F.when(linked, F.col("class_id")).otherwise(F.col("id"))).alias("class_id"),
    )


def op5_jaccard_join(spark, sf_dir):
    """Components of all documents at five words and a similarity of 0.8, and classes of equal sets."""
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[ \t\n\v\f\r]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE
           WHEN len(words) = 0 THEN []
           WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
           ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS print FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * common >= 80 * (nx.n + ny.n - common)
), r AS (
  WITH RECURSIVE c(id, low) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT e.y, c.low FROM c JOIN e ON e.x = c.id WHERE c.low < e.y
  ) SELECT id, min(low) AS component_id FROM c GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id,
       CASE WHEN n.n > 0 THEN min(d.doc_id) OVER (PARTITION BY n.print) ELSE d.doc_id END AS class_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id
"""
