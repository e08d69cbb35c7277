"""Packing token sequences into windows of fixed length by non-negative least squares.

A document's ids (with an end id) are cut at multiples of the window; full windows stand alone. The remainders, rounded
up to units, form a histogram. All shallow combinations of up to DEPTH remainders that fill a window exactly are the
columns of a matrix; non-negative least squares finds how often each is to be repeated so that the histogram is used up.
The counts are rounded down and limited to what is there; what is left is packed greedily, each piece into the
sequence with least room that takes it.

This is solved for groups of about GROUP_TOKENS tokens within a task, whose histograms are alike, so there is no
shuffle, memory is bounded, and a lost task is repeated alone. Every sequence is padded to the window, except one that
fills half of it or less, which is padded to the next power of two.

Defined results: a null or empty text is the end id alone; a text longer than a window is cut at its multiples; repeated
rows are packed each; an empty table gives no rows; ids of null documents are null.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, prepare

DEPTH, UNITS, GROUP_TOKENS, CACHE_WORDS = 3, 128, 8_000_000, 1_500_000
LETTER, DIGIT, BLANK = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
#: The vocabulary's published pre-token pattern for lower-case texts within Latin-1; other texts go to the library itself.
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{BLANK}{LETTER}{DIGIT}]+")


class WordTokenizer:
    """Token ids of whole texts, as the public library gives them; remembers the ids of words.

    Within Latin-1 the vocabulary's normalizer only lowers case and its words are encoded independently, so each new
    word is given to the library once. Other texts, and those with a special token's string, are given to it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start = array("i"), array("q", [0])

    def _learn(self, words: list[str]) -> None:
        for word, e in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.number[word] = len(self.start) - 1
            self.flat.extend(e.ids)
            self.start.append(len(self.flat))

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with the end id after each text, and the number of ids of each text."""
        if len(self.number) > CACHE_WORDS:
            self.reset()
        found: list[list[str] | None] = []
        places: list[list[int | None]] = []
        new: set[str] = set()
        get = self.number.get
        for text in texts:
            try:
                text.encode("latin-1")
                plain = not any(s in text for s in self.special)
            except UnicodeEncodeError:
                plain = False
            words = LATIN.findall(text.lower()) if plain else None
            found.append(words)
            at = list(map(get, words or ()))
            places.append(at)
            if None in at:
                new.update(w for w, k in zip(words, at, strict=True) if k is None)
        if new:
            self._learn(sorted(new))
        flat, start = np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32), np.frombuffer(self.start, np.int64)
        parts, counts = [], np.zeros(len(texts), np.int64)
        last = np.array([end], np.int32)
        for k, words in enumerate(found):
            if words is None:
                ids = np.array(self.library.encode(texts[k], add_special_tokens=False).ids, np.int32)
            else:
                at = places[k]
                at = np.array(list(map(get, words)) if None in at else at, np.int64)
                first = start[at]
                size = start[at + 1] - first
                ends = np.cumsum(size)
                ids = flat[np.repeat(first - ends + size, size) + np.arange(ends[-1])] if len(words) else flat[:0]
            parts += [ids, last]
            counts[k] = len(ids) + 1
        joined = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        del flat, start
        return joined, counts


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for a vocabulary in a Python process; tasks that share a process share its words."""
    return kept(f"words {path}", lambda: WordTokenizer(path))


@lru_cache(maxsize=4)
def combinations(units: int, depth: int) -> tuple[tuple[int, ...], ...]:
    """All multisets of up to ``depth`` lengths from 1 to ``units`` whose sum is ``units``."""

    def rest(total: int, least: int, left: int) -> Iterator[tuple[int, ...]]:
        if total >= least:
            yield (total,)
        if left > 1:
            for a in range(least, total // 2 + 1):
                for more in rest(total - a, a, left - 1):
                    yield (a, *more)

    return tuple(rest(units, 1, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson, on normal equations.

    It ends when no column would lower the residual, or after ``rounds`` columns have come in: what it has by then is a
    valid start, and what a plan leaves over is packed greedily. With histograms of several shapes it ends before (tests).
    """
    gram, target = a.T @ a, a.T @ b
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = target - gram @ x
        slope[free] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(b.max())):
            break
        free[best] = True
        while True:
            own = np.flatnonzero(free)
            try:
                y = np.linalg.solve(gram[np.ix_(own, own)], target[own])
            except np.linalg.LinAlgError:
                y = np.linalg.lstsq(gram[np.ix_(own, own)], target[own], rcond=None)[0]
            if (y > 0).all():
                x[:] = 0
                x[own] = y
                break
            down = own[y <= 0]
            now = x[own]
            step = np.min(now[y <= 0] / np.maximum(now[y <= 0] - y[y <= 0], 1e-300))
            x[own] = now + step * (y - now)
            x[down[x[down] <= 1e-12]] = 0
            drop = own[x[own] <= 1e-12]
            if not len(drop):
                drop = down[:1]
            free[drop] = False
            x[drop] = 0
    return x


@lru_cache(maxsize=4)
def _matrix(units: int, depth: int) -> np.ndarray:
    combos = combinations(units, depth)
    a = np.zeros((units, len(combos)))
    for k, c in enumerate(combos):
        for u in c:
            a[u - 1, k] += 1
    return a


def plan(lengths: np.ndarray, window: int, units: int = UNITS, depth: int = DEPTH) -> list[list[int]]:
    """Sequences as lists of indexes into ``lengths`` (each from 1 to the window)."""
    unit = -(-window // units)
    units = -(-window // unit)
    kind = -(-lengths // unit)
    there = [np.flatnonzero(kind == u + 1).tolist() for u in range(units)]
    combos, sequences = combinations(units, depth), []
    if len(lengths) >= depth:
        x = nnls(_matrix(units, depth), np.array([len(t) for t in there], float), 2 * units)
        for k in np.argsort(-x, kind="stable"):
            times = int(x[k] + 1e-6)
            if times < 1:
                break
            for _ in range(times):
                need = combos[k]
                if any(len(there[u - 1]) < need.count(u) for u in set(need)):
                    break
                sequences.append([there[u - 1].pop() for u in need])
    left = sorted((i for t in there for i in t), key=lambda i: (-lengths[i], i))
    rooms = sorted((window - int(sum(lengths[i] for i in s)), k) for k, s in enumerate(sequences))
    rooms = [r for r in rooms if r[0] > 0]
    for i in left:
        size = int(lengths[i])
        at = bisect.bisect_left(rooms, (size, -1))
        if at == len(rooms):
            sequences.append([i])
            room, k = window - size, len(sequences) - 1
        else:
            room, k = rooms.pop(at)
            sequences[k].append(i)
            room -= size
        if room:
            bisect.insort(rooms, (room, k))
    return sequences


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end: int = 2, id_col: str = "doc_id", text_col: str = "text", group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, next_id = tokenizer(vocabulary), TaskContext.get().partitionId() << 33

        def packed(ids: np.ndarray, names: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
            nonlocal next_id
            full, rest = counts // window, counts % window
            pieces = full + (rest > 0)
            doc = np.repeat(np.arange(len(counts)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, length = nth * window, np.minimum(window, counts[doc] - nth * window)
            offset, sequence, padded = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), np.full(len(doc), window, np.int64)
            whole = np.flatnonzero(length == window)
            sequence[whole] = next_id + np.arange(len(whole))
            next_id += len(whole)
            part = np.flatnonzero(length < window)
            sequences = plan(length[part], window)
            used = [sum(int(length[part[i]]) for i in s) for s in sequences]
            for k, s in enumerate(sequences):
                at = 0
                for i in s:
                    offset[part[i]], sequence[part[i]] = at, next_id
                    at += int(length[part[i]])
                if used[k] <= window // 2:
                    padded[part[s]] = 1 << (used[k] - 1).bit_length()
                next_id += 1
            begin = (np.cumsum(counts) - counts)[doc] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [names.take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, counts[doc], sequence, offset, padded))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"])

        kept: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        size = 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 250):
                ids, counts = words.encode([t or "" for t in texts[at : at + 250]], end)
                kept.append((ids, batch.column(0).slice(at, 250), counts))
                size += len(ids)
                if size >= group_tokens:
                    yield packed(np.concatenate([k[0] for k in kept]), pa.concat_arrays([k[1] for k in kept]), np.concatenate([k[2] for k in kept]))
                    kept, size = [], 0
        if kept:
            yield packed(np.concatenate([k[0] for k in kept]), pa.concat_arrays([k[1] for k in kept]), np.concatenate([k[2] for k in kept]))

    kind = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded_length bigint"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kind)
