"""Masking: detect, resolve overlaps, substitute. Narrow: one Arrow pass, a text never leaves its row.

A session is the column ``session_id``; substitutes are functions of (session, type, original), so the vault of a
session is the distinct rows of what was masked, and masking needs no lookup. Nothing here writes the vault anywhere.

Defined results: a null text stays null and has no spans; a null session is a session of its own; rows with equal session and text get equal
masked texts; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import engine
from ..functions.columns import SUB, masked, per_text
from ..functions.engine import Recognizer, Span
from .detect import by_rules, keyword_rules, usable
from .spans import summary, summary_text


def as_name(kind: str) -> str:
    """The pipeline's type for substitutes: persons get names."""
    return "NAME" if kind == "PERSON" else kind


def resolver(rules: Iterable[tuple[str, str]] = (), mock: bool = True, keywords: Iterable[str] = (), recognizers: Iterable[Recognizer] = ()):
    """A function from a text (and the JSON of external entities) to its resolved spans."""
    own, plugged = [*usable(rules), *usable(keyword_rules(keywords))], [*([engine.mock_ner] if mock else []), *recognizers]

    def resolve(text: str, entities: str | None = None) -> list[Span]:
        places = engine.Places(text)
        found = engine.regex_spans(text, places)
        if entities is not None:
            found += engine.entity_spans(text, entities, places)
        for recognizer in plugged:
            found += engine.recognized(text, recognizer, places)
        return engine.merge(found + by_rules(text, own, places))

    return resolve


def with_masked(docs: DataFrame, made: Column) -> DataFrame:
    """``docs`` with the fields ``spans`` and ``masked`` of a struct column."""
    return docs.withColumn("_made", made).withColumns({"spans": F.col("_made.spans"), "masked": F.col("_made.masked")}).drop("_made")


def mask_pipeline(docs: DataFrame, rules: Iterable[tuple[str, str]] = (), entities: Column | None = None, mock: bool = True, keywords: Iterable[str] = (), recognizers: Iterable[Recognizer] = ()) -> DataFrame:
    """Pattern detections, external entities, recognizers (the mock one, and any callable from a text to spans) and user rules, merged and replaced.

    ``docs`` has doc_id, session_id and text; the result adds spans and masked.
    """
    resolve = resolver(rules, mock, keywords, recognizers)
    return with_masked(docs, masked(resolve, F.col("text"), F.col("session_id"), *([entities] if entities is not None else []), name=as_name))


def rules_from_json(text: str) -> list[tuple[str, str]]:
    """User rules [{pattern, replacement_type}]; one malformed element voids the list."""
    try:
        rows = json.loads(text)
        out = [(r["pattern"], r["replacement_type"]) for r in rows] if isinstance(rows, list) else []
    except (ValueError, TypeError, KeyError):
        return []
    return out if all(isinstance(x, str) for r in out for x in r) else []


def keywords_from_json(text: str) -> list[str]:
    """Keywords ["…"]; one malformed element voids the list."""
    try:
        rows = json.loads(text)
    except ValueError:
        return []
    return rows if isinstance(rows, list) and all(isinstance(x, str) for x in rows) else []


def mask_text_greedy(docs: DataFrame, detections: Column) -> DataFrame:
    """The stand-alone masker: valid detections (in their order), nested ones dropped, right-most first; keys are the ``value`` fields."""

    def resolve(text: str, own: list[dict] | None) -> list[tuple[str, int, int, str]]:
        good = [(d["entity_type"], d["start"], d["end"], d["value"]) for d in own or [] if d["is_valid"]]
        return engine.greedy(good, len(text.encode()))

    return with_masked(docs, masked(resolve, F.col("text"), F.col("session_id"), detections))


def vault(masked_docs: DataFrame, right_first: bool = True) -> DataFrame:
    """session_id, norm_type, original, substitute, seq: each key once, with the place of its first registration.

    The pipeline registers a text's spans from right to left, the stand-alone masker from left to right; documents in order of id.
    """
    # One generator over one column: nothing of the masking is computed twice.
    numbered = F.transform("spans", lambda s, i: F.struct(s["entity_type"].alias("norm_type"), s["original"].alias("original"), s["sub"].alias("substitute"), (F.size("spans") - i if right_first else i).alias("i")))
    rows = masked_docs.select("session_id", "doc_id", F.inline(numbered))
    return rows.groupBy("session_id", "norm_type", "original", "substitute").agg(F.min(F.struct("doc_id", "i")).alias("seq"))


def without_session(rows: DataFrame, session_id: object) -> DataFrame:
    """A vault without one session; its replies then stay as they are."""
    return rows.where(~F.col("session_id").eqNullSafe(F.lit(session_id)))


def replace_sessions(rows: DataFrame, new: DataFrame) -> DataFrame:
    """A vault in which the sessions of ``new`` have the rows of ``new`` only: masking again forgets what the session had."""
    kept = rows.join(new.select(F.col("session_id").alias("_s")).distinct(), F.col("session_id").eqNullSafe(F.col("_s")), "left_anti")
    return kept.unionByName(new)


def reverse_vault(forward: DataFrame) -> DataFrame:
    """session_id, substitute, original, norm_type: where originals collide on one substitute, the latest registration wins."""
    latest = F.max(F.struct("seq", "original", "norm_type")).alias("m")
    return forward.groupBy("session_id", "substitute").agg(latest).select("session_id", "substitute", F.col("m.original").alias("original"), F.col("m.norm_type").alias("norm_type"))


def mask_summary(docs: DataFrame) -> DataFrame:
    """doc_id, names, pan, aadhaar, summary: what would be hidden."""
    resolve = resolver()
    kinds = per_text(lambda t: [(s[0],) for s in resolve(t)], "struct<entity_type: string>")
    own = docs.select("doc_id", kinds(F.col("text")).alias("_k")).select("doc_id", summary(F.col("_k")).alias("c"))
    return own.select("doc_id", F.col("c.names").alias("names"), F.col("c.pan").alias("pan"), F.col("c.aadhaar").alias("aadhaar"), summary_text(F.col("c")).alias("summary"))


def redact_pii(docs: DataFrame, mark: str = "X") -> DataFrame:
    """doc_id, redacted: plain redaction by four patterns, one after the other."""
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else engine.redact(t, mark) for t in texts.to_pylist()], pa.string())

    return docs.select("doc_id", run(F.col("text")).alias("redacted"))


def profiled(masked_docs: DataFrame) -> DataFrame:
    """doc_id, input_len and output_len in bytes; the caller measures time."""
    return masked_docs.select("doc_id", F.octet_length("text").alias("input_len"), F.octet_length("masked").alias("output_len"))
