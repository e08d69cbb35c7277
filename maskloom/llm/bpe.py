"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's symbols stand in an array; leaf i of the tree holds the merge rank of symbol i with its right neighbour
(infinite if they don't merge), inner nodes hold minima. The root is the leftmost pair of lowest rank. A merge updates
three leaves, each on one path to the root, so a pre-token of n bytes takes O(n log n), however long it is.

Defined results: a null or empty text has no ids and decodes to the empty text; equal texts have equal ids; text in
several scripts is cut into pre-tokens as the vocabulary's pattern says; the string of a special token is that token's
single id, as the public library has it by default.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, prepare

#: Pre-tokens that a Python worker remembers; longer ones than KEPT_CHARS are encoded anew each time.
CACHE_WORDS, KEPT_CHARS = 600_000, 48
SPACE = r"\t-\r \x85\xa0  -     　"
#: The vocabulary's published pre-token pattern, for any text and for texts within Latin-1, where the standard library's faster engine serves.
ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
LETTER, DIGIT, BLANK = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{BLANK}{LETTER}{DIGIT}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


def byte_names() -> dict[int, str]:
    """The printable character that names each byte in byte-level vocabularies: itself if printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Codec:
    """Vocabulary, merges and special tokens from a tokenizer file; encodes and decodes whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, names = spec["model"]["vocab"], byte_names()
        self.byte_id = [vocab[names[b]] for b in range(256)]
        self.shift = max(vocab.values()).bit_length()
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << self.shift | vocab[b], rank << self.shift | vocab[a + b])
        byte_of = {c: b for b, c in names.items()}
        self.token_bytes = {i: bytes(map(byte_of.__getitem__, t)) for t, i in vocab.items() if all(c in byte_of for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: merge at the tree's root until no pair is left."""
        merges, shift = self.merges, self.shift
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        if n == 1:
            return ids
        low, none = n.bit_length(), 1 << 62
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if (m := merges.get(ids[i] << shift | ids[i + 1])) is not None:
                tree[size + i] = m << low | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before, at, new_id = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << low) - 1, (1 << shift) - 1
        while (root := tree[1]) != none:
            i = root & at
            new = ids[i] = root >> low & new_id
            gone = after[i]
            j = after[i] = after[gone]
            ids[gone] = -1
            changes = [(gone, none)] if gone < n - 1 else []
            if j < n:
                before[j] = i
                m = merges.get(new << shift | ids[j])
                changes.append((i, none if m is None else m << low | i))
            else:
                changes.append((i, none))
            if (h := before[i]) >= 0:
                m = merges.get(ids[h] << shift | new)
                changes.append((h, none if m is None else m << low | h))
            for leaf, value in changes:
                k = size + leaf
                tree[k] = value
                k >>= 1
                while k:
                    a, b = tree[2 * k], tree[2 * k + 1]
                    if a > b:
                        a = b
                    if tree[k] == a:
                        break
                    tree[k] = a
                    k >>= 1
        return [x for x in ids if x >= 0]

    def words(self, text: str) -> list[tuple[int, ...]]:
        """The ids of each pre-token, in order."""
        try:
            text.encode("latin-1")
            found = LATIN.findall(text)
        except UnicodeEncodeError:
            found = ANY.findall(text)
        known = self.known
        out = list(map(known.get, found))
        if None in out:
            if len(known) > CACHE_WORDS:
                known.clear()
            for k, ids in enumerate(out):
                if ids is None:
                    word = found[k]
                    if (ids := known.get(word)) is None:
                        ids = tuple(self.merge(word.encode()))
                        if len(word) <= KEPT_CHARS:
                            known[word] = ids
                    out[k] = ids
        return out

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not self.cut.search(text):
            return list(chain.from_iterable(self.words(text)))
        ids: list[int] = []
        at = 0
        for m in self.cut.finditer(text):
            ids += chain.from_iterable(self.words(text[at : m.start()]))
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + list(chain.from_iterable(self.words(text[at:])))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One codec for a vocabulary in a Python process."""
    return kept(f"bpe {path}", lambda: Codec(path))


def encode_documents(docs: DataFrame, vocabulary: str, whole: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``whole``, the ids and the decoded text. Narrow: no shuffle."""
    prepare(docs.sparkSession)
    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        names = list(map(str, range(max(own.token_bytes) + 1)))
        for batch in batches:
            out: list[list[Any]] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                ids = own.encode(text) if text else []
                decoded = own.decode(ids)
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                if whole:
                    out[3].append(ids)
                    out[4].append(decoded)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            columns += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())] if whole else []
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kind)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text from a column of ids; null ids decode to the empty text."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")
