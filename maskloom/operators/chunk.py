"""Tokens, overlapping chunks, and detection in long documents chunk by chunk. Narrow: a document is resolved in its row.

Defined results: null and blank texts have no tokens, chunks or spans; equal texts have equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import engine
from ..functions.columns import per_text
from ..functions.patterns import KEYWORDS, dictionary
from .detect import by_dictionary

MOST_TOKENS, CHUNK, OVERLAP = 50_000, 512, 64
TOO_LONG = "Input exceeds maximum token limit"


def chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, start_token, end_token, start (byte), text of each chunk."""
    own = per_text(lambda t: engine.chunks(t, size, overlap), "struct<start_token: int, end_token: int, start: int, text: string>")
    return docs.select("doc_id", F.inline(own(F.col("text"))))


def long_spans(text: str, pattern: str | None, size: int = CHUNK, overlap: int = OVERLAP, most: int = MOST_TOKENS) -> list[tuple[object, ...]]:
    """entity_type, start, end, value, source, error of the merged spans of all chunks; over the limit one row with the error."""
    tokens = engine.tokens(text)
    if len(tokens) > most:
        return [(None, None, None, None, None, TOO_LONG)]
    own = set()
    for _, _, base, part in engine.chunks(text, size, overlap, tokens):
        own |= {(s[0], s[1] + base, s[2] + base, s[3], s[4], s[5]) for s in engine.regex_spans(part) + by_dictionary(part, pattern)}
    return [(s[0], s[1], s[2], s[3], s[5], None) for s in engine.merge(own)]


def tier4_detect(docs: DataFrame, words: Iterable[str] = KEYWORDS, size: int = CHUNK, overlap: int = OVERLAP, most: int = MOST_TOKENS) -> DataFrame:
    """doc_id, entity_type, start, end, value, source of the merged spans of all chunks; a document over the limit is one row with ``error``."""
    pattern = dictionary(list(words))
    own = per_text(lambda t: long_spans(t, pattern, size, overlap, most), "struct<entity_type: string, start: int, end: int, value: string, source: string, error: string>")
    return docs.select("doc_id", F.inline(own(F.col("text"))))
