"""Operator 7 - quality rules by line sequence labelling.

A linear-chain conditional random field with two states, content and boilerplate, labels a
text's lines by Viterbi decoding.  It is trained here, on the driver, from the whole texts of a bounded
sample of labelled documents (``sample`` ids of each quality, least hash first).  Line labels are weak: a line of a good document is
content, a line of a bad one boilerplate.  Training pages are spliced from runs of lines of both kinds, so that the
field sees both states in one page and learns how they follow each other.  After each round but the last the lines of bad documents that the
field takes for content become content, as bad documents hold ordinary lines too; a document whose lines would all change keeps its labels.
A document is kept if it passes the base rules and at least ``min_share`` of its words stand in content lines.

Base rules: under 50 words, or more than half of the words in repeated three-word windows, fail.

Defined results: a null or empty text has no words and fails; a text of blank lines too; ties
between states go to content; without labels of both kinds every line is content; rows are judged
one by one, so repeated or null ids don't matter; extra columns pass through where no output
column has their name; very long texts cost memory in proportion to themselves only.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

MIN_WORDS, MAX_REPEAT, MIN_SHARE = 50, 50, 0.5
SAMPLE = 300
ROUNDS, PAGE_LINES, RUN_LINES = 2, 48, 12  # of training: rounds, lines of a spliced page, most lines of a run in it
LONG = 50_000  # words from which windows are counted as numbers
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MARKS = SYMBOLS + b"!"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
FEATURES = 12
OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")


def repeat_words_of_long(words: list[bytes]) -> int:
    """repeat_words with 8 bytes a window."""
    numbers: dict[bytes, int] = {}
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
    pairs = np.unique(w[:-1] << 32 | w[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] << 32 | w[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(len(w), dtype=bool)
    for shift in range(3):
        covered[shift : len(again) + shift] |= again
    return int(covered.sum())


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice, first finds included."""
    if len(words) > LONG:
        return repeat_words_of_long(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    covered, reach = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + 3 - max(i, reach)
            reach = i + 3
    return covered


def line_features(lines: list[bytes]) -> tuple[list[list[float]], list[int]]:
    """Features and word counts of the lines that have words, in order."""
    out, sizes, seen = [], [], set()
    for line in lines:
        words = line.split()
        n = len(words)
        if not n:
            continue
        size = len(line)
        again = sum(map(bytes.__eq__, words, words[1:]))
        out.append(
            [
                1.0,
                min(1.0, math.log1p(n) / 5),
                float(n < 4),
                min(1.0, 4 * (size - len(line.translate(None, MARKS))) / size),
                (size - len(line.translate(None, UPPER))) / size,
                (size - len(line.translate(None, DIGITS))) / size,
                1.0 - len(set(words)) / n,
                again / n,
                float(line in seen),
                float(line.rstrip()[-1:] in (b".", b"!", b"?")),
                min(1.0, (size - n) / n / 15),
                float(b"|" in line),
            ]
        )
        sizes.append(n)
        seen.add(line)
    return out, sizes


class LineField:
    """Linear-chain conditional random field with states 0 (content) and 1 (boilerplate)."""

    def __init__(self, weights: np.ndarray | None = None, transitions: np.ndarray | None = None):
        self.weights = np.zeros((FEATURES, 2)) if weights is None else weights
        self.transitions = np.zeros((2, 2)) if transitions is None else transitions

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = 150, rate: float = 0.3, decay: float = 1e-3) -> LineField:
        """Gradient ascent (Adam) on the mean log likelihood; sequences are padded to one length.  labels: a state for each line."""
        if not sequences or len(set(np.concatenate(labels).tolist())) < 2:
            return self
        longest = max(len(s) for s in sequences)
        x = np.zeros((len(sequences), longest, FEATURES))
        y = np.zeros((len(sequences), longest), dtype=np.int64)
        on = np.zeros((len(sequences), longest), dtype=bool)
        for i, (s, states) in enumerate(zip(sequences, labels, strict=True)):
            x[i, : len(s)], y[i, : len(s)], on[i, : len(s)] = s, states, True
        truth_x = np.zeros((FEATURES, 2))
        truth_t = np.zeros((2, 2))
        weight = 1.0 / on.sum(1)  # every sequence counts the same
        share = weight[:, None] * on
        for c in (0, 1):
            truth_x[:, c] = np.einsum("il,ilf->f", share * (y == c), x)
            for d in (0, 1):
                truth_t[c, d] = ((y[:, :-1] == c) & (y[:, 1:] == d) & on[:, 1:]).sum(1) @ weight
        params = np.zeros(FEATURES * 2 + 4)
        m, v = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, steps + 1):
            w, t = params[: FEATURES * 2].reshape(FEATURES, 2), params[FEATURES * 2 :].reshape(2, 2)
            score = x @ w
            alpha, beta = np.zeros_like(score), np.zeros_like(score)
            alpha[:, 0] = score[:, 0]
            for i in range(1, longest):
                new = score[:, i] + np.logaddexp(alpha[:, i - 1, :1] + t[0], alpha[:, i - 1, 1:] + t[1])
                alpha[:, i] = np.where(on[:, i, None], new, alpha[:, i - 1])
            for i in range(longest - 2, -1, -1):
                ahead = score[:, i + 1] + beta[:, i + 1]
                new = np.logaddexp(t[:, 0] + ahead[:, :1], t[:, 1] + ahead[:, 1:])
                beta[:, i] = np.where(on[:, i + 1, None], new, 0.0)
            total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            p = np.exp(alpha + beta - total[:, None, None]) * share[:, :, None]
            expect_x = np.einsum("ilc,ilf->fc", p, x)
            expect_t = np.zeros((2, 2))
            if longest > 1:
                both = on[:, 1:] * weight[:, None]
                for a in (0, 1):
                    for b in (0, 1):
                        e = np.exp(np.minimum(0, alpha[:, :-1, a] + t[a, b] + score[:, 1:, b] + beta[:, 1:, b] - total[:, None]))
                        expect_t[a, b] = (e * both).sum()
            grad = np.concatenate(((truth_x - expect_x).ravel(), (truth_t - expect_t).ravel())) / len(sequences) - decay * params
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return LineField(params[: FEATURES * 2].reshape(FEATURES, 2), params[FEATURES * 2 :].reshape(2, 2))

    def decode(self, features: list[list[float]] | np.ndarray) -> list[int]:
        """The best state sequence; ties go to content."""
        (t00, t01), (t10, t11) = self.transitions.tolist()
        back, a, b = [], 0.0, 0.0
        for i, (s0, s1) in enumerate((np.array(features) @ self.weights).tolist()):
            if i:
                from0, from1 = b + t10 > a + t00, b + t11 > a + t01
                a, b = (b + t10 if from0 else a + t00) + s0, (b + t11 if from1 else a + t01) + s1
                back.append((from0, from1))
            else:
                a, b = s0, s1
        state, out = int(b > a), []
        for step in reversed(back):
            out.append(state)
            state = int(step[state])
        return [*out, state][::-1]


def judge(text: str | None, field: LineField, min_share: float = MIN_SHARE) -> tuple:
    """The values of OUTPUT for one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT * n
    share = 0.0
    if n:
        features, sizes = line_features(lines)
        share = sum(s for s, state in zip(sizes, field.decode(features), strict=True) if not state) / n
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated, failed, share, not failed and share >= min_share


def spliced(docs: list[np.ndarray], states: list[np.ndarray], seed: int, page: int = PAGE_LINES, run: int = RUN_LINES) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pages of about ``page`` lines made of runs of up to ``run`` lines; every line of every document stands in one of them."""
    rng = random.Random(seed)
    pieces = []
    for d, n in enumerate(map(len, docs)):
        at = 0
        while at < n:
            stop = min(n, at + rng.randint(1, run))
            pieces.append((d, at, stop))
            at = stop
    rng.shuffle(pieces)
    pages: list[list[tuple[int, int, int]]] = [[]]
    lines = 0
    for piece in pieces:
        if lines >= page:
            pages.append([])
            lines = 0
        pages[-1].append(piece)
        lines += piece[2] - piece[1]
    join = lambda of: [np.concatenate([of[d][a:b] for d, a, b in p]) for p in pages if p]
    return join(docs), join(states)


def fit_lines(docs: list[np.ndarray], bad: list[bool], rounds: int = ROUNDS, seed: int = 7) -> LineField:
    """A field from the line features of documents and their quality."""
    states = [np.full(len(d), int(b)) for d, b in zip(docs, bad, strict=True)]
    field = LineField()
    for r in range(rounds):
        field = LineField().fit(*spliced(docs, states, seed + r))
        for i, b in enumerate(bad):
            if b and any(now := field.decode(docs[i])):
                states[i] = np.array(now)
    return field


def _feature_rows(batches):
    names = ["doc_id", "quality", "rank", "features"]
    for b in batches:
        rows = []
        for i, q, t in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            raw = (t or "").encode()
            if features := line_features(raw.split(b"\n"))[0]:
                rows.append((i, q, hashlib.sha256(raw).digest(), np.array(features, dtype="<f4").tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names)


def train_field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineField:
    """labels: doc_id and quality (1 good, 0 bad).  The features of at most 2 * sample documents reach the driver.

    Of several labels of an id the worst counts; of several documents with an id the one of the least hash.
    """
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for quality in (0, 1):
        part = one.where(F.col("quality") == quality).select("doc_id", "quality").orderBy(*order).limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    found = texts.mapInArrow(_feature_rows, "doc_id long, quality int, rank binary, features binary")
    rows = found.groupBy("doc_id").agg(F.min_by(F.struct("quality", "features"), "rank").alias("best")).select("doc_id", "best.*").collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit_lines([np.frombuffer(bytes(r.features), dtype="<f4").reshape(-1, FEATURES).astype(float) for r in rows], [r.quality == 0 for r in rows])


def _judge_rows(field: LineField, min_share: float, keep_text: bool):
    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("__text")
            judged = [judge(x.as_py(), field, min_share) for x in b.column(at)]
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            new = [pa.array([j[i] for j in judged], t) for i, t in enumerate(types)]
            rest = [i for i in range(b.num_columns) if i != at or keep_text]
            names = ["text" if i == at else b.schema.field(i).name for i in rest]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), *new], [*names, *OUTPUT])

    return run


def quality_rules(docs: DataFrame, field: LineField, text_col: str = "text", min_share: float = MIN_SHARE, keep_text: bool = False) -> DataFrame:
    """``docs`` with the columns of OUTPUT; the text (then named ``text``) only if keep_text."""
    rest = [c for c in docs.columns if c != text_col and c not in OUTPUT and c != "__text"]
    source = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).alias("__text"))
    kinds = [T.LongType()] * 5 + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    fields = [docs.schema[c] for c in rest] + ([T.StructField("text", T.StringType())] if keep_text else [])
    schema = T.StructType(fields + [T.StructField(n, k) for n, k in zip(OUTPUT, kinds, strict=True)])
    return source.mapInArrow(_judge_rows(field, min_share, keep_text), schema)


def op7_quality_rules(spark, sf_dir):
    """Verdicts on all documents, by a field trained on ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, train_field(docs, table(spark, sf_dir, "labels")))
