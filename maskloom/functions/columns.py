"""Column functions: the engine on Arrow batches. Each is one narrow pass; a text never leaves its row, and nothing is kept between rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import engine
from .substitutes import day_offset, normalized, substitute

SPAN = "struct<entity_type: string, start: int, end: int, value: string, confidence: float, source: string>"
DETECTION = "struct<entity_type: string, start: int, end: int, value: string, is_valid: boolean>"
MATCH = "struct<start: int, end: int, value: string>"
SUB = "array<struct<start: int, end: int, entity_type: string, original: string, sub: string>>"


def arrow_type(ddl: str) -> pa.DataType:
    return to_arrow_type(T._parse_datatype_string(ddl) if isinstance(ddl, str) else ddl)


def lists(rows: Sequence[Iterable[tuple[Any, ...]] | None], kind: pa.DataType) -> pa.Array:
    """array<struct> of tuples; None is null."""
    own = [list(r) if r is not None else None for r in rows]
    flat = [x for r in own if r is not None for x in r]
    ends, at = [0], 0
    for r in own:
        at += len(r) if r is not None else 0
        ends.append(at)
    fields = list(kind.value_type)
    columns = list(zip(*flat, strict=True)) if flat else [()] * len(fields)
    items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    mask = pa.array([r is None for r in own]) if any(r is None for r in own) else None
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, type=kind, mask=mask)


def per_text(make: Callable[..., Iterable[tuple[Any, ...]]], item: str) -> Callable[..., Column]:
    """A column function from a text (and other columns) to an array of tuples; a null text gives an empty array."""
    kind = arrow_type(f"array<{item}>")

    @F.arrow_udf(f"array<{item}>")
    def run(*columns: pa.Array) -> pa.Array:
        return lists([make(*row) if row[0] is not None else [] for row in zip(*(c.to_pylist() for c in columns), strict=True)], kind)

    return run


def matches(text: Column, pattern: str) -> Column:
    """All matches with UTF-8 byte offsets: array<struct<start, end, value>>; empty ones are dropped."""
    return per_text(lambda t: engine.found(t, engine.Places(t), pattern), MATCH)(text)


def token_spans(text: Column) -> Column:
    """Maximal runs without white space, with byte offsets."""
    return per_text(engine.tokens, MATCH)(text)


def _tuples(own: list[dict[str, Any]] | None) -> list[tuple[Any, ...]]:
    return [tuple(x.values()) for x in own or []]


def merge_array(own: Column) -> Column:
    """Of each chain of overlapping spans the best one; see ``engine.merge``."""
    return per_text(lambda own: engine.merge(_tuples(own)), SPAN)(own)


def _same_kind(run: Callable[[list[dict[str, Any]], Any], list[dict[str, Any]]], own: Column, kind: str, *more: Column) -> Column:
    made = arrow_type(kind)

    @F.arrow_udf(kind)
    def each(*columns: pa.Array) -> pa.Array:
        return pa.array([None if r is None else run(r, *x) for r, *x in zip(*(c.to_pylist() for c in columns), strict=True)], made)

    return each(own, *more)


def not_contained(own: Column, kind: str) -> Column:
    """Spans of an array (of type ``kind``, with start and end) that no other strictly contains."""
    return _same_kind(lambda r: engine.not_contained(r, "start", "end"), own, kind)


def greedy(own: Column, size: Column, kind: str) -> Column:
    """The stand-alone masker's choice of spans of an array whose elements have start, end and ord."""
    return _same_kind(lambda r, n: engine.greedy(sorted(r, key=lambda s: s["ord"]), n, "start", "end"), own, kind, size)


def stitch(text: Column, replacements: Column) -> Column:
    """``text`` with disjoint byte ranges (array<struct<start, end, ..., sub>>, in order) replaced."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        return pa.array([None if t is None else engine.stitch(t, ((x["start"], x["end"], x["sub"]) for x in r or ())) for t, r in zip(texts.to_pylist(), ranges.to_pylist(), strict=True)], pa.string())

    return run(text, replacements)


def substituted(kind: Column, original: Column, salt: Column) -> Column:
    """The substitute of each original; null originals have none."""

    @F.arrow_udf("string")
    def run(kinds: pa.Array, originals: pa.Array, salts: pa.Array) -> pa.Array:
        return pa.array([None if o is None else substitute(normalized(k or ""), o, s) for k, o, s in zip(kinds.to_pylist(), originals.to_pylist(), salts.to_pylist(), strict=True)], pa.string())

    return run(kind, original, salt.cast("string"))


def replaced(spans: Iterable[tuple[str, int, int, str]], salt: str | None, name: Callable[[str], str] = str) -> list[tuple[int, int, str, str, str]]:
    """start, end, normalized type, original, substitute of spans (type, start, end, value)."""
    days = day_offset(salt)
    return [(s[1], s[2], k := normalized(name(s[0])), s[3], substitute(k, s[3], salt, days)) for s in spans]


def masked(resolve: Callable[..., Iterable[tuple[Any, ...]]], text: Column, salt: Column, *more: Column, name: Callable[[str], str] = str) -> Column:
    """struct<spans, masked>: ``resolve`` (text and the columns ``more``) gives the disjoint spans of a text, which get substitutes."""
    kind = arrow_type(SUB)

    @F.arrow_udf(f"struct<spans: {SUB}, masked: string>")
    def run(texts: pa.Array, salts: pa.Array, *others: pa.Array) -> pa.Array:
        spans: list[Any] = []
        out: list[str | None] = []
        for t, s, *own in zip(texts.to_pylist(), salts.to_pylist(), *(c.to_pylist() for c in others), strict=True):
            subs = replaced(resolve(t, *own), s, name) if t is not None else []
            spans.append(subs)
            out.append(None if t is None else engine.stitch(t, ((a, b, sub) for a, b, _, _, sub in subs)))
        return pa.StructArray.from_arrays([lists(spans, kind), pa.array(out, pa.string())], ["spans", "masked"])

    return run(text, salt.cast("string"), *more)
