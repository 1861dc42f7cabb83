"""Operator 1 - benchmark decontamination by spaced-seed hashing.

A mask such as 110110111011 keeps some positions of a window of words and ignores others.
Every window of every item is hashed under every mask; a document window with an equal hash
agrees with the item at the kept positions, whatever stands at the ignored ones.  Each hit
fixes a diagonal (document position minus item position), and along it words are compared
around the hit: the stretch of the best score (+1 a match, ``-mismatch`` a substitution) is a
leak if it has ``min_match`` equal words and at least ``min_identity`` of its words are equal.

Items of the same words are one class, named by its least id.  A hash stands for every class and every place that hold it, and all of them are
compared.  Hashes that the same classes hold at the same distances, as the windows of a shared passage do, are one group, so that a document meets
their items once and not once for each window.  Of stretches of a document that lie for the most part in each other the one of most equal words is reported, so a
passage that many items share is one row, with the number of classes that hold it.

Up to ``broadcast_bytes`` of item texts, their hashes (under 20 bytes a word and mask) are broadcast and met where the documents are read, so
texts are never shuffled.  A larger benchmark meets the documents in one join of hashes, of whatever size: document windows that
a bitmap of bounded size doesn't turn away travel as hashes to those of the items, and the few texts with a hit to the items' words.

Both sides are normalised by the same function: letter case and the characters of PUNCTUATION are ignored; words made of those alone
don't count.  An item takes every mask that is not longer than it, and needs ``min_match`` equal words, or ``min_share`` of its own if that is less.  An item of
up to SHORT words is also hashed whole: of ``exact_below`` words or more under shapes that leave out all but two of its parts, so that it is met whichever
words are replaced, as long as it has what it needs; a shorter one as it stands.  An item of under ``inside`` words is too common to be
evidence inside a text: it is a leak where it is the whole document.  No item is left out.

Defined results: null or empty texts on either side match nothing; null ids stay null; repeated
rows are reported each; ties between stretches go to the least item id, then the first; no items or no
documents give no rows; extra columns play no part.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast, scratch, table
from .vectext import mix, text_bytes, word_hashes

#: Of random sets of six with seven kept words: the one that meets most 15 to 30 word passages with a fifth of their words changed.
MASKS = ("11010101011", "1110010111", "1101101011", "11110111", "10111010011", "1111111")
MIN_MATCH, MIN_IDENTITY, MISMATCH = 10, 0.6, 1.0
MIN_SHARE, EXACT_BELOW, INSIDE = 0.8, 8, 5
SHORT = 14  # words of items that are hashed whole as well, so that none is lost by its place of changed words
BROADCAST_BYTES = 4 << 20
PART_ITEMS, PART_WORDS = 4096, 1 << 20  # of a group's members that meet documents, and of a document's candidates that are compared, in one row
BITMAP_BITS = 1 << 28  # of the bitmap that is broadcast in the join of a large benchmark: 32 MB
CHUNK = 2 << 20
EXPANDED = 1 << 20  # candidates of a document that are told apart at once
PUNCTUATION = b".,;:!?\"'()[]"
SCHEMA = "doc_id long, item_id long, start long, length long, matched long, item_words long, n_items long"
_STEP = np.uint64(0xD1342543DE82EF95)


def plain_words(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and offsets of an Arrow string column: the one normaliser of documents and items."""
    return word_hashes([t.translate(None, PUNCTUATION) for t in text_bytes(pc.utf8_lower(column))])


def mask_hashes(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the kept words of the window starting at each position."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(salt))
    for j, bit in enumerate(mask):
        if bit == "1":
            h = h * _STEP + words[j : j + n]
    return mix(h)


def share_words(n: int, share: float) -> int:
    """Equal words that an item of n words needs at least."""
    return int(np.ceil(round(share * n, 9)))


def whole_shapes(n: int, lost: int) -> list[str]:
    """Masks of n words of which one keeps only equal words wherever up to ``lost`` words differ: two of lost + 2 parts each."""
    part = np.arange(n) * min(lost + 2, n) // n
    return sorted({"".join("1" if p in pair else "0" for p in part) for pair in combinations(range(part[-1] + 1), 2)}) if lost else ["1" * n]


class Rules:
    """What counts as a leak, and the shapes that items are hashed under."""

    def __init__(self, masks=MASKS, min_match=MIN_MATCH, min_identity=MIN_IDENTITY, mismatch=MISMATCH, min_share=MIN_SHARE, exact_below=EXACT_BELOW, inside=INSIDE):
        self.masks, self.min_match, self.min_identity, self.mismatch = masks, min_match, min_identity, mismatch
        self.min_share, self.exact_below, self.inside = min_share, exact_below, inside
        #: (shape, salt, least and most words of the items hashed under it)
        self.shapes = [(m, 1 + i, max(len(m), exact_below), None) for i, m in enumerate(masks)]
        for n in range(1, SHORT + 1):
            lost = n - self.needed(n) if n >= exact_below else 0
            self.shapes += [(m, 100 * n + j, n, n) for j, m in enumerate(whole_shapes(n, lost))]

    def needed(self, n: int) -> int:
        """Equal words that an item of n words needs."""
        return min(self.min_match, share_words(n, self.min_share)) if n >= self.exact_below else n

    def seeds(self, words: np.ndarray):
        """(hash, place, shape) arrays of one item's windows."""
        n, out = len(words), []
        for k, (shape, salt, least, most) in enumerate(self.shapes):
            if n >= least and (most is None or n <= most):
                h = mask_hashes(words, shape, salt)
                out.append((h, np.arange(len(h)), np.full(len(h), k)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))

    def used(self, sizes: np.ndarray) -> list[int]:
        """Shapes that items of such sizes are hashed under."""
        return [k for k, (_, _, least, most) in enumerate(self.shapes) if ((sizes >= least) & ((sizes <= most) if most else True)).any()]

    def verify(self, words: np.ndarray, candidates) -> list[tuple]:
        """(start, length, matched, item id, item words, n_items) of a document's stretches.  candidates: (item words, item id, diagonal, n_items)."""
        found = []
        for item, item_id, diagonal, n_items in candidates:
            low, high = max(0, diagonal), min(len(words), diagonal + len(item))
            equal = words[low:high] == item[low - diagonal : high - diagonal]
            need = self.needed(len(item))
            if np.count_nonzero(equal) < need:
                continue
            if len(item) <= SHORT:  # a short item counts from its first equal word to its last
                same = np.flatnonzero(equal)
                a, b = (int(same[0]), int(same[-1]) + 1) if len(same) else (0, 0)
                if len(item) < self.inside and len(words) != len(item):
                    continue
            else:
                a, b = best_stretch(equal, self.mismatch)
            matched = int(equal[a:b].sum())
            if matched >= need and matched >= self.min_identity * (b - a):
                found.append((low + a, b - a, matched, item_id, len(item), n_items))
        return one_of_each(found)


def rank(f: tuple) -> tuple:
    """Order of stretches (start, length, matched, id, ...): the best first."""
    return -f[2], f[3] is None, f[3] or 0, f[0], f[4]


def one_of_each(found: list[tuple]) -> list[tuple]:
    """The best of equal stretches, with the most items that one of them is shared by."""
    best: dict[tuple, tuple] = {}
    for f in found:
        old = best.setdefault(f[:2], f)
        best[f[:2]] = (*min(f, old, key=rank)[:5], max(f[5], old[5]))
    return list(best.values())


def apart(found: list[tuple]) -> list[tuple]:
    """Of stretches (start, length, matched, id, ...) the best ones, less those of which half or more lies in better ones."""
    if len(found) < 2:
        return found
    out: list[list] = []
    covered = np.zeros(max(f[0] + f[1] for f in found), dtype=bool)
    for f in sorted(one_of_each(found), key=rank):
        if 2 * np.count_nonzero(covered[f[0] : f[0] + f[1]]) < f[1]:
            covered[f[0] : f[0] + f[1]] = True
            out.append([*f])
        else:  # what it has in common with a better one, that one shares with as many items
            for k in out:
                if k[0] < f[0] + f[1] and f[0] < k[0] + k[1]:
                    k[5] = max(k[5], f[5])
    return sorted(map(tuple, out), key=lambda f: f[0])


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the rows in order, and where there a row differs from the one before."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return order, new


class Holders:
    """Who holds which hash: of each hash (in order) a group and a place; of each group its members, (item, place from there) from ``ends[g]`` to ``ends[g + 1]``, and how many items they are."""

    def __init__(self, h: np.ndarray, item: np.ndarray, place: np.ndarray):
        order, _ = distinct(h, item, place)
        h, item, place = h[order], item[order], place[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        other = new.copy()
        other[1:] |= item[1:] != item[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h)))
        self.hashes, self.place = h[new], place[new].astype(np.int32)
        away = place - np.repeat(place[new], size)
        sums = [np.zeros(0, np.uint64)] * 2
        if len(h):  # 128 bits of a hash's set of members
            sums = [np.add.reduceat(mix(mix(item.astype(np.uint64) * _STEP + np.uint64(salt)) + away.astype(np.uint64)), first) for salt in (1, 2)]
        order, new = distinct(*sums)
        self.group = np.empty(len(first), dtype=np.int32)
        self.group[order] = np.cumsum(new) - 1
        one = order[new]  # a hash of each group
        self.ends = np.concatenate(([0], np.cumsum(size[one])))
        at = np.repeat(first[one] - self.ends[:-1], size[one]) + np.arange(self.ends[-1])
        self.item, self.away = item[at].astype(np.int32), away[at].astype(np.int32)
        self.count = np.add.reduceat(other.astype(np.int64), first)[one].astype(np.int32) if len(h) else np.zeros(0, np.int32)

    def candidates(self, group: np.ndarray, base: np.ndarray, most: int = EXPANDED) -> np.ndarray:
        """(item, diagonal, items that share it) as rows of an array, of a document's distinct (group, base)."""
        out = np.zeros((3, 0), dtype=np.int64)
        sizes = np.diff(self.ends)[group]
        part = np.cumsum(sizes) // most
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            n = sizes[mine]
            at = np.repeat(self.ends[group[mine]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            some = np.stack([self.item[at], np.repeat(base[mine], n) - self.away[at], np.repeat(self.count[group[mine]], n)]).astype(np.int64)
            out = np.concatenate([out, some], axis=1)
            order = np.lexsort((-out[2], out[1], out[0]))
            out = out[:, order]
            new = np.ones(out.shape[1], dtype=bool)
            new[1:] = (out[:2, 1:] != out[:2, :-1]).any(0)
            out = out[:, new]
        return out.T


class Seeds:
    """The hashes of a benchmark's windows, with a bitmap that turns most words away."""

    def __init__(self, ids: list, words: np.ndarray, offsets: np.ndarray, rules: Rules):
        classes: dict[bytes, int] = {}
        self.ids: list = []
        self.items: list[np.ndarray] = []
        for i, a, b in zip(ids, offsets[:-1], offsets[1:], strict=True):
            if b > a:
                at = classes.setdefault(words[a:b].tobytes(), len(classes))
                if at == len(self.items):
                    self.ids.append(i)
                    self.items.append(words[a:b])
                elif i is not None:
                    self.ids[at] = i if self.ids[at] is None else min(i, self.ids[at])
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        self.ids, self.items = [self.ids[k] for k in order], [self.items[k] for k in order]
        parts = [rules.seeds(w) for w in self.items]
        h = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        place = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, int)
        self.held = Holders(h, item, place)
        self.hashes = self.held.hashes
        self.shapes = rules.used(np.array([len(w) for w in self.items], dtype=int))
        self.bitmap = bitmap_of(self.hashes, max(16, int(np.ceil(np.log2(len(self.hashes) + 1))) + 5))

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in h, entry of this table) of all equal hashes."""
        maybe = np.flatnonzero(in_bitmap(self.bitmap, h))
        at = np.searchsorted(self.hashes, h[maybe])
        same = at < len(self.hashes)
        same[same] = self.hashes[at[same]] == h[maybe[same]]
        return maybe[same], at[same]


def bitmap_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    at = np.unique(hashes & np.uint64((1 << bits) - 1))
    out = np.zeros(1 << (bits - 3), np.uint8)
    np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8))
    return out


def in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def best_stretch(equal: np.ndarray, mismatch: float) -> tuple[int, int]:
    """First stretch [a, b) of the highest sum of +1 and -mismatch."""
    sums = np.concatenate(([0.0], np.cumsum(np.where(equal, 1.0, -mismatch))))
    gain = sums - np.minimum.accumulate(sums)
    b = int(np.argmax(gain))
    a = int(np.flatnonzero(sums[: b + 1] == sums[: b + 1].min())[-1]) if b else 0
    return a, b


def chunks_of(texts, size: int = CHUNK):
    """(first, last) rows of stretches of about ``size`` bytes of an Arrow string column."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at = 0
    while at < len(lengths):
        stop, n = at, 0
        while stop < len(lengths) and (n < size or stop == at):
            n += lengths[stop]
            stop += 1
        yield at, stop
        at = stop


def windows(words: np.ndarray, offsets: np.ndarray, rules: Rules, shapes: list[int], keep):
    """(document, place, entry of keep, shape) of windows in one document whose hash ``keep`` takes: (positions, entries)."""
    out = []
    for k in shapes:
        shape, salt = rules.shapes[k][:2]
        at, entry = keep(mask_hashes(words, shape, salt))
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + len(shape) <= offsets[doc + 1]
        out.append((doc[inside], (at - offsets[doc])[inside], entry[inside], np.full(inside.sum(), k)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def record(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(len(names))], names)


def _search(shared, rules: Rules):
    """shared: a broadcast Seeds."""

    def run(batches):
        seeds = shared.value
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for first, stop in chunks_of(b.column(1)):
                words, offsets = plain_words(b.column(1).slice(first, stop - first))
                doc, at, entry, _ = windows(words, offsets, rules, seeds.shapes, seeds.hits)
                if not len(doc):
                    continue
                group, base = seeds.held.group[entry], at - seeds.held.place[entry]
                order, new = distinct(doc, group, base)
                doc, group, base = doc[order][new], group[order][new], base[order][new]
                bounds = [*np.flatnonzero(np.diff(doc, prepend=-1)).tolist(), len(doc)]
                for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                    d = int(doc[low])
                    some = seeds.held.candidates(group[low:high], base[low:high])
                    found = rules.verify(words[offsets[d] : offsets[d + 1]], ((seeds.items[i], seeds.ids[i], g, c) for i, g, c in some.tolist()))
                    rows += [(ids[first + d], item_id, start, length, matched, size, n) for start, length, matched, item_id, size, n in apart(found)]
            yield record(rows)

    return run


def joined(texts: DataFrame, items: DataFrame, rules: Rules, bitmap_bits: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Leaks of a benchmark of any size: texts (id, text) and items (id, text) meet by their hashes."""
    spark = texts.sparkSession

    def item_words(batches):
        for b in batches:
            words, offsets = plain_words(b.column(1))
            values = pa.array(words.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)], ["item_id", "words"])

    def item_seeds(batches):
        for b in batches:
            for item, words in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h, place, _ = rules.seeds(words.values.to_numpy(zero_copy_only=False).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), item, np.int64)), pa.array(place.astype(np.int32))], ["h", "item", "place"])

    def doc_seeds(bitmap, shapes):
        def run(batches):
            for b in batches:
                ids = b.column(0).to_pylist()
                for first, stop in chunks_of(b.column(1)):
                    part = b.column(1).slice(first, stop - first)
                    words, offsets = plain_words(part)

                    def keep(h):
                        maybe = np.flatnonzero(in_bitmap(bitmap.value, h))
                        return maybe, h[maybe]

                    doc, at, h, _ = windows(words, offsets, rules, shapes, keep)
                    d = digests(part)[doc]
                    yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.uint64).view(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(at.astype(np.int32))], ["h", "d1", "d2", "at"])

        return run

    def with_digest(batches):
        for b in batches:
            d = digests(b.column(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], ["id", "text", "d1", "d2"])

    stretch = "start long, length long, matched long, item_id long, item_words long, n_items long"
    names = [f.split()[0] for f in stretch.split(", ")]

    def of_text(rows):
        """Rows (d1, d2, *stretch) as a batch."""
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(2 + len(names))], ["d1", "d2", *names])

    def verify(batches):
        for b in batches:
            rows = []
            for i, row in enumerate(b.column(3)):
                words, _ = plain_words(b.column(2).slice(i, 1))
                some = ((c["words"].values.to_numpy(zero_copy_only=False).view(np.uint64), c["item_id"].as_py(), c["diagonal"].as_py(), c["n_items"].as_py()) for c in row)
                rows += [(b.column(0)[i].as_py(), b.column(1)[i].as_py(), *f) for f in rules.verify(words, some)]
            yield of_text(rows)

    def choose(batches):
        for b in batches:
            rows = []
            for i, row in enumerate(b.column(2).to_pylist()):
                rows += [(b.column(0)[i].as_py(), b.column(1)[i].as_py(), *f) for f in apart([tuple(c[n] for n in names) for c in row])]
            yield of_text(rows)

    classes = items.mapInArrow(item_words, "item_id long, words array<long>").where(F.size("words") > 0)
    classes = classes.groupBy("words").agg(F.min("item_id").alias("item_id")).select(F.xxhash64("words").alias("item"), "item_id", "words")
    classes = scratch(classes, "leaks-items")
    seeds = scratch(classes.select("item", "words").mapInArrow(item_seeds, "h long, item long, place int"), "leaks-seeds")
    heads = seeds.groupBy("h", "item").agg(F.min("place").alias("place")).groupBy("h").agg(F.min(F.struct("item", "place")).alias("first"), F.count("*").alias("n_items"))
    seeds = seeds.join(heads.select("h", F.col("first.place").alias("zero"), "n_items"), "h").withColumn("away", F.col("place") - F.col("zero"))
    marks = [F.bit_xor(F.xxhash64(F.lit(salt), "item", "away")).alias(name) for salt, name in ((1, "g1"), (2, "g2"))]  # 128 bits of a hash's set of members
    hashes = seeds.groupBy("h").agg(*marks, F.first("zero").alias("zero"), F.first("n_items").alias("n_items"), F.count("*").alias("n"))
    hashes = scratch(hashes.withColumn("parts", F.ceil(F.col("n") / PART_ITEMS).cast("int")).drop("n"), "leaks-hashes")
    one = hashes.groupBy("g1", "g2").agg(F.min_by(F.struct("h", "parts"), "h").alias("one")).select("g1", "g2", "one.*")
    members = seeds.select("h", "item", "away").join(one, "h").select("g1", "g2", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int").alias("part"), "item", "away")
    members = scratch(members, "leaks-members")
    sizes = np.array([r[0] for r in classes.select(F.least(F.size("words"), F.lit(64))).distinct().collect()], dtype=int)  # 64 at most
    bit = F.col("h").bitwiseAND(F.lit(bitmap_bits - 1))
    words_of_bits = hashes.groupBy(F.shiftright(bit, 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int"))).alias("v")).toArrow()
    bitmap = np.zeros(bitmap_bits // 32, np.uint32)
    bitmap[words_of_bits["at"].to_numpy()] = words_of_bits["v"].to_numpy().astype(np.uint32)
    shared = broadcast(spark, bitmap.astype("<u4").view(np.uint8))
    met = texts.mapInArrow(doc_seeds(shared, rules.used(sizes)), "h long, d1 long, d2 long, at int").join(hashes, "h")
    met = met.groupBy("d1", "d2", "g1", "g2", (F.col("at") - F.col("zero")).alias("base")).agg(F.max("n_items").alias("n_items"), F.max("parts").alias("parts"))
    met = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(members, ["g1", "g2", "part"])
    hits = met.groupBy("d1", "d2", "item", (F.col("base") - F.col("away")).alias("diagonal")).agg(F.max("n_items").alias("n_items"))
    hits = scratch(hits.join(classes.select("item", F.size("words").alias("n_words")), "item"), "leaks-hits")
    shares = hits.groupBy("d1", "d2").agg(F.ceil(F.sum("n_words") / PART_WORDS).cast("int").alias("shares"))  # a row for each text with a hit
    shares = scratch(shares, "leaks-shares")
    few = shares.limit(broadcast_rows + 1).count() <= broadcast_rows
    near = texts.mapInArrow(with_digest, "id long, text string, d1 long, d2 long")
    if few:
        near = near.join(F.broadcast(shares.select("d1", "d2")), ["d1", "d2"], "left_semi")  # only texts with a hit travel
    near = scratch(near, "leaks-near")
    share = F.pmod(F.xxhash64("item", "diagonal"), F.col("shares")).alias("share")
    found = hits.join(shares, ["d1", "d2"]).select("d1", "d2", "item", "diagonal", "n_items", share).join(classes, "item")
    found = found.groupBy("d1", "d2", "share").agg(F.collect_list(F.struct("words", "item_id", "diagonal", "n_items")).alias("found"))  # PART_WORDS, about
    bodies = near.groupBy("d1", "d2").agg(F.first("text").alias("text"))
    leaks = bodies.join(found, ["d1", "d2"]).select("d1", "d2", "text", "found").mapInArrow(verify, f"d1 long, d2 long, {stretch}")
    leaks = leaks.groupBy("d1", "d2").agg(F.collect_list(F.struct(*names)).alias("found"))  # distinct stretches of one text, of each share
    leaks = leaks.mapInArrow(choose, f"d1 long, d2 long, {stretch}")
    out = near.select(F.col("id").alias("doc_id"), "d1", "d2").join(leaks, ["d1", "d2"])
    return out.select(*[f.split()[0] for f in SCHEMA.split(", ")])


def digests(column) -> np.ndarray:
    """128 bits of each text as two longs: texts that are equal share their hits."""
    raw = b"".join(xxhash.xxh3_128_digest(t) for t in text_bytes(column))
    return np.frombuffer(raw, dtype="<i8").reshape(-1, 2)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
    bitmap_bits: int = BITMAP_BITS,
    **rules,
) -> DataFrame:
    """Leaks: doc_id, item_id, start and length (words of the document), matched, item_words, n_items.

    n_items: how many items of different words hold the stretch's most shared window.  rules: the parameters of Rules.
    """
    rules = Rules(**rules)
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    rows = items.select(F.col(item_col).cast("long"), F.col(item_text_col)).where(F.col(item_text_col).isNotNull())
    if (rows.agg(F.sum(F.octet_length(item_text_col))).first()[0] or 0) > broadcast_bytes:
        return joined(texts, rows, rules, bitmap_bits)
    known = rows.collect()  # broadcast_bytes at most
    seeds = Seeds([r[0] for r in known], *plain_words(pa.array([r[1] for r in known], pa.string())), rules)
    return texts.mapInArrow(_search(broadcast(docs.sparkSession, seeds), rules), SCHEMA)


def op1_decontamination(spark, sf_dir):
    """Every leak of an item of ``benchmark`` in ``documents``."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
