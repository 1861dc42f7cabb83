"""Operator 3 - order-preserving packing by dynamic programming.

Documents of a partition are tokenised in order into one stream; each ends with ``eos``.
Windows are cut at document ends (free) and at sentence ends (a truncation penalty); only inside a sentence that is longer
than a window there are inner cuts (a larger penalty), before words where it has some.  A window of n tokens costs ``size - n`` of padding.  As padding is separable,

    g[j] = size + penalty[j] + min(g[i] for i with pos[j] - size <= pos[i] < pos[j])

holds for g = cost + pos, so the best previous cut is a sliding-window minimum and a
monotone queue gives each transition in constant amortised time.  Blocks of about
``block_tokens`` tokens are solved one after another, which bounds memory; a block ends at a
document end.  Nothing is shuffled.

Ids are those of the public byte-level BPE vocabulary.  Its rank file is read by tiktoken, which
gives the same ids as the tokenizers file at a quarter of the time; texts that hold a special
token's string, or that tiktoken gives up on, go through tokenizers itself.

Defined results: a null or empty text is the single id ``eos``; repeated rows and ids are packed
one by one; documents longer than a sequence are cut into several pieces; an empty table gives
no pieces.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import executor_env, table

SIZE, EOS = 2048, 1
SENTENCE_PENALTY, HARD_PENALTY = 4, 64
HARD_STEP = 64  # tokens between two inner cuts of a sentence that is longer than a window
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class Tokenizer:
    """Ids of one byte-level BPE vocabulary, and which tokens end a sentence or follow one."""

    def __init__(self, json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken"):
        import public_tokenizers
        import tiktoken

        executor_env()
        self.json_path = public_tokenizers.path(json_name)
        with open(public_tokenizers.path(ranks_name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(self.json_path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens", [])
        self.special = [x["content"] for x in added]
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        n = max([*ranks.values(), *(x["id"] for x in added)]) + 1
        self.ends, self.opens = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        for token, i in ranks.items():
            self.ends[i] = token[-1:] in b".!?\n" if token else False
            self.opens[i] = token[:1] in b" \n\t\r" if token else False
        self._slow = None

    def slow(self, text: str) -> np.ndarray:
        if self._slow is None:
            from tokenizers import Tokenizer as T

            self._slow = T.from_file(self.json_path)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return self.slow(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
        except BaseException as e:  # the Rust side panics with a class of its own on extreme runs of one kind
            if type(e).__name__ != "PanicException":
                raise
            return self.slow(text)


def cut_points(docs: list[np.ndarray], ends: np.ndarray, opens: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Candidate cut positions of a block in order (last: its end) and their penalties; no gap is over ``size``."""
    stream = np.concatenate(docs)
    kind = np.full(len(stream) + 1, -1, dtype=np.int64)
    kind[np.flatnonzero(ends[stream[:-1]] & opens[stream[1:]]) + 1] = SENTENCE_PENALTY
    kind[np.cumsum([len(d) for d in docs])] = 0
    at = np.flatnonzero(kind >= 0)
    gaps = np.diff(np.concatenate(([0], at)))
    step = max(1, min(HARD_STEP, size // 2))
    for i in np.flatnonzero(gaps > size):
        inner = np.arange(at[i] - gaps[i] + step, at[i], step)
        word = np.flatnonzero(opens[stream[inner[0] - step : at[i]]]) + inner[0] - step  # starts of words in the sentence
        near = np.searchsorted(word, inner, "right") - 1
        word = np.append(word, -1)[near]
        kind[np.where(word > inner - step, word, inner)] = HARD_PENALTY
    kind[0] = -1
    at = np.flatnonzero(kind >= 0)
    return at.tolist(), kind[at].tolist()


def best_cuts(at: list[int], penalty: list[int], size: int) -> list[int]:
    """Ends of the windows of least padding plus penalties; at[] must leave no gap over size."""
    n = len(at)
    back = [0] * n
    queue: deque = deque([(0, 0, -1)])  # (position, cost + position, index), costs rising
    pop, push, popleft = queue.pop, queue.append, queue.popleft
    for j in range(n):
        pos = at[j]
        low = pos - size
        while queue[0][0] < low:
            popleft()
        _, g, back[j] = queue[0]
        g += size + penalty[j]
        while queue and queue[-1][1] >= g:
            pop()
        push((pos, g, j))
    cuts, j = [], n - 1
    while j >= 0:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def pack_block(ids: list, docs: list[np.ndarray], ends: np.ndarray, opens: np.ndarray, size: int, first: int, out: dict) -> int:
    """Append the pieces of one block to out's columns; returns the next free sequence id."""
    at, penalty = cut_points(docs, ends, opens, size)
    cuts = best_cuts(at, penalty, size)
    doc, begin, sequence = 0, 0, first  # begin: where doc starts in the stream
    a = 0
    for b in cuts:
        offset = 0
        while a < b:
            end = begin + len(docs[doc])
            stop = min(b, end)
            piece = docs[doc][a - begin : stop - begin]
            row = (ids[doc], a - begin, stop - a, zlib.crc32(piece.astype("<u4", copy=False).tobytes()), len(docs[doc]), sequence, offset)
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
            offset += stop - a
            a = stop
            if a == end:
                doc, begin = doc + 1, end
        sequence += 1
    return sequence


def pack(size: int, eos: int, block_tokens: int):
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def record(out: dict) -> pa.RecordBatch:
        columns = [pa.array(v, pa.int64()) for v in out.values()]
        if out["sequence_id"]:
            s, n = np.array(out["sequence_id"]), np.array(out["length"])
            seq, inverse = np.unique(s, return_inverse=True)
            total = np.bincount(inverse, weights=n, minlength=len(seq)).astype(np.int64)
            columns.append(pa.array(total[inverse]))
        else:
            columns.append(pa.array([], pa.int64()))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        from pyspark import TaskContext

        tokenizer = Tokenizer()
        sequence = TaskContext.get().partitionId() << 36
        ids, docs, tokens = [], [], 0
        tail = np.array([eos], dtype=np.uint32)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = text.as_py()
                docs.append(np.concatenate((tokenizer.ids(t), tail)) if t else tail)
                ids.append(doc_id)
                tokens += len(docs[-1])
                if tokens >= block_tokens:
                    out: dict = {n: [] for n in names[:-1]}
                    sequence = pack_block(ids, docs, tokenizer.ends, tokenizer.opens, size, sequence, out)
                    yield record(out)
                    ids, docs, tokens = [], [], 0
        if docs:
            out = {n: [] for n in names[:-1]}
            pack_block(ids, docs, tokenizer.ends, tokenizer.opens, size, sequence, out)
            yield record(out)

    return run


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, eos: int = EOS, block_tokens: int = 1 << 20
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pack(size, eos, block_tokens), SCHEMA)


def op3_packing(spark, sf_dir):
    """All documents in sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
