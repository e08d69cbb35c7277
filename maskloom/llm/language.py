"""Language identification: script ranges, then Viterbi over the scores of words with a penalty for switching.

Learning counts hashed character trigrams (with word edges) and letters by script for each language, over a sample of
about SAMPLE labelled texts chosen by hash; whole texts, summed in Spark. A language is a candidate for a word only
if it has a share of the word's script. A word's score for a language is the sum of its trigrams' log probabilities, less the
best language's. The best path through the languages, with PENALTY for each change, labels every word; the language with most
letters in words that are evidence is the text's, their share of all letters is the score. Viterbi runs over pieces of PIECE words at once, joined by their max-plus products,
which gives the same path as word by word.

Defined results: a null text, or one without a letter or without evidence, is ``und`` with score 0 and has no spans; ties go to the first language in order; words of
a script that no language has are no evidence; without labelled texts everything is ``und``; equal texts have equal results.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, mix64, prepare

SAMPLE, BUCKETS, PENALTY, PIECE, SHARE, CACHE_WORDS = 20_000, 1 << 16, 12.0, 64, 0.01, 1_000_000
#: First code points of blocks by script, in order; what lies below the first letter of a script belongs to it.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0E00, "thai"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
NUMBER = np.array([NAMES.index(n) for _, n in SCRIPTS])
WORD = re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each with a blank before and after, and each word's length."""
    points = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.fromiter(map(len, words), np.int64, len(words))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of all words' trigrams, the first of each word among them, and each word's script by its first letter."""
    points, size = _codes(words)
    starts = np.cumsum(size + 2) - size - 2
    ends = np.cumsum(size)
    at = np.repeat(starts - ends + size, size) + np.arange(ends[-1])
    p = points.astype(np.uint64)
    h = mix64(p[at] << np.uint64(42) | p[at + 1] << np.uint64(21) | p[at + 2])
    return (h % np.uint64(BUCKETS)).astype(np.int64), ends - size, NUMBER[np.searchsorted(STARTS, points[starts + 1], "right") - 1]


@dataclass
class Model:
    languages: list[str]
    log: np.ndarray  # buckets x languages
    allowed: np.ndarray  # scripts x languages

    def scores(self, words: list[str]) -> np.ndarray:
        """Words x languages, the best candidate 0."""
        bucket, first, script = trigrams(words)
        out = np.add.reduceat(self.log[bucket], first, axis=0)
        may = self.allowed[script]
        out = np.where(may, out, -np.inf)
        with np.errstate(invalid="ignore"):
            out -= out.max(axis=1, keepdims=True)
        out[~may.any(axis=1)] = 0
        return np.maximum(out, -60.0).astype(np.float32)

    def evidence(self, words: list[str]) -> np.ndarray:
        """Whether some language has a share of each word's script."""
        letters = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
        return self.allowed.any(axis=1)[NUMBER[np.searchsorted(STARTS, letters, "right") - 1]]


def fold(doc_id: Column) -> Column:
    """The contract's remainder: crc32 of the id as text, mod 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key: Column | None = None, sample: int = SAMPLE) -> Model:
    """The model of labelled rows; ``key`` (an expression) decides by hash which rows are in the sample."""
    prepare(docs.sparkSession)
    key = F.xxhash64("doc_id", text_col) if key is None else key
    labelled = docs.where(F.col(lang_col).isNotNull())
    n = labelled.select(lang_col).count()
    if n > sample:
        labelled = labelled.where(F.shiftrightunsigned(key, 1) <= (sample << 63) // n)  # of 63 bits: also right where n is billions of times the sample
    rows = labelled.where(F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words := _words(text):
                    bucket, first, script = trigrams(words)
                    own = grams.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                    own += np.bincount(bucket, minlength=len(own))
                    own[BUCKETS:] += np.bincount(script, weights=np.diff(np.append(first, len(bucket))), minlength=len(NAMES)).astype(np.int64)
        for lang, own in grams.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])

    sums = rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.collect()  # at most BUCKETS + scripts rows for each language
    languages = sorted({r["lang"] for r in found})
    table = np.zeros((BUCKETS + len(NAMES), max(1, len(languages))))
    number = {x: k for k, x in enumerate(languages)}
    for r in found:
        table[r["bucket"], number[r["lang"]]] = r["n"]
    grams, letters = table[:BUCKETS], table[BUCKETS:]
    log = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS))
    allowed = letters > SHARE * letters.sum(axis=0)
    return Model(languages, log.astype(np.float32), allowed)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word: ``scores`` of all texts' words, ``counts`` of words in each text."""
    if not len(scores):
        return np.zeros(0, np.int64)
    k = scores.shape[1]
    pieces = -(-counts // PIECE)
    total = int(pieces.sum())
    begin, piece0 = np.cumsum(counts) - counts, np.cumsum(pieces) - pieces
    word_text = np.repeat(np.arange(len(counts)), counts)
    slot = piece0[word_text] * PIECE + np.arange(len(scores)) - begin[word_text]
    padded = np.zeros((total * PIECE, k), np.float32)
    padded[slot] = scores
    padded = padded.reshape(total, PIECE, k)
    # What each piece adds on the way from each language before it to each at its end.
    way = np.full((total, k, k), -np.inf, np.float32)
    way[:, np.arange(k), np.arange(k)] = 0
    for t in range(PIECE):
        way = np.maximum(way, way.max(axis=2, keepdims=True) - penalty) + padded[:, t, None, :]
    # Over the pieces of each text, all texts at once.
    best, came = np.zeros((len(counts), k), np.float32), np.zeros((total, k), np.int64)
    order = np.argsort(-pieces, kind="stable")
    live = np.searchsorted(-pieces[order], -np.arange(1, int(pieces.max()) + 1), "right")
    for c, n in enumerate(live.tolist()):
        own = order[:n]
        step = best[own][:, :, None] + way[piece0[own] + c]
        came[piece0[own] + c] = step.argmax(axis=1)
        best[own] = step.max(axis=1)
    enter, leave = np.zeros(total, np.int64), np.zeros(total, np.int64)
    state = best.argmax(axis=1)
    for c in range(len(live) - 1, -1, -1):
        own = order[: live[c]]
        leave[piece0[own] + c] = state[own]
        state[own] = came[piece0[own] + c, state[own]]
        enter[piece0[own] + c] = state[own]
    # Inside all pieces at once, from the language before to the one at the end.
    value = np.full((total, k), -np.inf, np.float32)
    value[np.arange(total), enter] = 0
    back = np.zeros((PIECE, total, k), np.int16)
    for t in range(PIECE):
        top = value.argmax(axis=1)
        change = value[np.arange(total), top][:, None] - penalty
        stay = value >= change
        back[t] = np.where(stay, np.arange(k)[None, :], top[:, None])
        value = np.where(stay, value, change) + padded[:, t]
    path = np.zeros((total, PIECE), np.int64)
    state = leave.copy()
    for t in range(PIECE - 1, -1, -1):
        path[:, t] = state
        state = back[t, np.arange(total), state].astype(np.int64)
    return path.reshape(-1)[slot]


class Labeller:
    """Labels texts; remembers the scores of words."""

    def __init__(self, model: Model):
        self.model, self.number, self.table = model, {}, np.zeros((0, len(model.languages)), np.float32)
        self.evident = np.zeros(0, bool)

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float], np.ndarray, np.ndarray]:
        """Language and score of each text, and the languages of its words with their numbers of words."""
        if not self.model.languages:
            return ["und"] * len(texts), [0.0] * len(texts), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        if len(self.number) > CACHE_WORDS:
            self.number, self.table, self.evident = {}, self.table[:0], self.evident[:0]
        found = [_words(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        get = self.number.get
        at = [k for words in found for k in map(get, words)]
        if None in at:
            new = list(dict.fromkeys(w for words in found for w in words if w not in self.number))
            self.table = np.concatenate([self.table, self.model.scores(new)])
            self.evident = np.concatenate([self.evident, self.model.evidence(new)])
            base = len(self.number)
            self.number.update((w, base + k) for k, w in enumerate(new))
            at = [k for words in found for k in map(get, words)]
        path = viterbi(self.table[np.array(at, np.int64)], counts)
        size = np.fromiter((len(w) for words in found for w in words), np.int64, len(at))
        k = len(self.model.languages)
        text = np.repeat(np.arange(len(texts)), counts)
        letters = np.bincount(text * k + path, weights=size * self.evident[np.array(at, np.int64)], minlength=len(texts) * k).reshape(-1, k)
        top, total = letters.argmax(axis=1), np.bincount(text, weights=size, minlength=len(texts))
        known = letters.any(axis=1)
        names = [self.model.languages[i] if ok else "und" for i, ok in zip(top.tolist(), known.tolist(), strict=True)]
        share = np.where(known, letters.max(axis=1) / np.maximum(total, 1), 0.0)
        return names, share.tolist(), path, counts


def predict(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (default: all), lang_pred, score (or ``names``) and, if asked, spans (language, first word, words) of mixed texts."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.log, model.allowed))  # BUCKETS x languages
    own = [F.col(c) for c in (docs.columns if keep is None else keep)]
    source = docs.select(*own, F.col(text_col).cast("string").alias("_text of " + text_col))
    extra = f"`{names[0]}` string, `{names[1]}` double" + ", spans array<struct<lang: string, first_word: int, n_words: int>>" * spans
    kind = T.StructType(source.schema.fields[:-1] + T.StructType.fromDDL(extra).fields)
    schema = to_arrow_schema(kind)
    name = f"language {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = kept(name, lambda: Labeller(Model(*shared.value)))
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                found, share, path, counts = labeller.label(part.column(part.num_columns - 1).to_pylist())
                made: list[Any] = [pa.array(found, pa.string()), pa.array(share, pa.float64())]
                if spans:
                    made.append(pa.array(_runs(path, counts, found, labeller.model.languages), schema.field("spans").type))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*part.columns[:-1], *made], schema, strict=True)], schema=schema)

    return source.mapInArrow(run, kind)


def _runs(path: np.ndarray, counts: np.ndarray, found: list[str], languages: list[str]) -> list[list[dict[str, Any]]]:
    out, at = [], 0
    for n, lang in zip(counts.tolist(), found, strict=True):
        own = path[at : at + n]
        at += n
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])).tolist() if lang != "und" else []
        out.append([{"lang": languages[own[a]], "first_word": a, "n_words": b - a} for a, b in zip(edge, [*edge[1:], n][: len(edge)], strict=True)])
    return out
