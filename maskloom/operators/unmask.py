"""Unmasking: exact replacement in order of substitute length, then fuzzy restoring of tokens.

Replies and pairs are grouped together by session. A session with more than SLICE replies is dealt into slices, each with the session's
pairs, so that a hot session is many tasks. A task indexes its session's pairs once (see ``engine.Pairs``): a reply looks up only pairs whose
first characters it has, a token only substitutes that share a piece with it, so time grows with replies plus pairs, not with their product.

Defined results: a null text stays null; a session without pairs leaves its replies as they are; a null session is a session of its own;
empty substitutes are skipped; repeated rows have equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import engine
from ..functions.columns import arrow_type, lists

SLICE = 5_000
FUZZY = "array<struct<utf16_start: int, utf16_end: int, masked: string, revealed: string>>"
HITS = "array<struct<start: int, end: int, masked: string, revealed: string>>"


def _each(replies: DataFrame, reverse: DataFrame, more: str, restore: Callable[[engine.Pairs, str], tuple[Any, ...]], slice_rows: int = SLICE) -> DataFrame:
    """``replies`` (with session_id and text) and the columns ``more`` (DDL) that ``restore`` makes of a session's pairs and a text."""
    added = T._parse_datatype_string(more)
    kind = T.StructType(replies.schema.fields + added.fields)
    schema, types = to_arrow_schema(kind), [arrow_type(f.dataType) for f in added.fields]
    at, width, session = replies.columns.index("text"), len(replies.columns), replies.schema["session_id"].dataType
    pairs = reverse.select(F.col("session_id").cast(session).alias("session_id"), "substitute", "original", "norm_type").where("substitute <> '' and original is not null")
    # Sessions beyond a slice; their number is at most that of all replies by the slice's size.
    hot = replies.groupBy("session_id").count().where(F.col("count") > slice_rows).select(F.col("session_id").alias("_s"), F.ceil(F.col("count") / slice_rows).cast("int").alias("_slices"))
    dealt = lambda df: df.join(hot, F.col("session_id").eqNullSafe(F.col("_s")), "left").withColumn("_slices", F.coalesce("_slices", F.lit(1))).drop("_s")
    left = dealt(replies).withColumn("_slice", F.pmod(F.xxhash64(*(F.col(f.name) for f in replies.schema if not isinstance(f.dataType, T.MapType))), F.col("_slices")).cast("int")).drop("_slices")
    right = dealt(pairs).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")

    def run(own: pa.Table, there: pa.Table) -> pa.Table:
        known = engine.Pairs(zip(*(there.column(c).to_pylist() for c in ("substitute", "original", "norm_type")), strict=True))
        made = [restore(known, t) if t is not None else (None,) * len(types) for t in own.column(at).to_pylist()]
        columns = [lists([m[k] for m in made], x) if pa.types.is_list(x) else pa.array([m[k] for m in made], x) for k, x in enumerate(types)]
        kept = [c.combine_chunks() for c in own.columns[:width]]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip([*kept, *columns], schema, strict=True)], schema=schema)

    # A number of partitions that is given is kept: sessions are few bytes but much work, and would be merged into a few tasks.
    parts = int(replies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_session = lambda df: df.repartition(parts, "session_id", "_slice").groupBy("session_id", "_slice")
    return by_session(left).cogroup(by_session(right)).applyInArrow(run, kind)


def unmask_exact(replies: DataFrame, reverse: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """``replies`` (reply_id, session_id, text) with ``exact``; a session without a vault leaves the text as it is."""
    return _each(replies, reverse, "exact string", lambda pairs, text: (pairs.exact(text),), slice_rows)


def fuzzy_tokens(replies: DataFrame, reverse: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """The best pair of each token of the exactly restored texts: reply_id, start, end (characters), masked, revealed."""
    rows = _each(replies, reverse, f"hits {HITS}", lambda pairs, text: (pairs.fuzzy(pairs.exact(text)),), slice_rows)
    return rows.select("reply_id", F.inline("hits"))


def unmask_fuzzy(replies: DataFrame, reverse: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """reply_id, text, fuzzy_spans (UTF-16 offsets into the restored text, masked, revealed)."""

    def restore(pairs: engine.Pairs, text: str) -> tuple[Any, ...]:
        exact = pairs.exact(text)
        return engine.revealed(exact, pairs.fuzzy(exact))

    rows = _each(replies, reverse, f"restored string, fuzzy_spans {FUZZY}", restore, slice_rows)
    return rows.select("reply_id", F.col("restored").alias("text"), "fuzzy_spans")


def unmask_json(replies: DataFrame, reverse: DataFrame) -> DataFrame:
    """reply_id, json: {text, fuzzy_spans} in one line."""
    return unmask_fuzzy(replies, reverse).select("reply_id", F.to_json(F.struct("text", "fuzzy_spans")).alias("json"))
