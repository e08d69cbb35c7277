"""Span sets as tables: filters, duplicates, the two conflict policies, summaries.

Chains (``merge_spans``) keep one span of every run of overlapping ones; the greedy policy (``greedy_spans``) drops nested spans
and prefers the right-most start. Tables shuffle once, by document; the array forms don't shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import greedy, not_contained
from ..functions.patterns import PRIORITY


def priority(source: Column) -> Column:
    """How sources rank in conflicts."""
    return F.coalesce(F.element_at(F.create_map(*(x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v)))), source), F.lit(0))


def distinct_spans(spans: DataFrame) -> DataFrame:
    return spans.dropDuplicates(["doc_id", "start", "end", "entity_type", "source"])


def merge_spans(spans: DataFrame) -> DataFrame:
    """The best span of each chain: islands by a running maximum of ends, then rank 1; one exchange by document."""
    own = distinct_spans(spans.where("start < end"))
    by = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), F.desc(priority(F.col("source"))), "entity_type")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("_new", (before.isNull() | (F.col("start") >= before)).cast("int"))
    own = own.withColumn("_chain", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy("doc_id", "_chain").orderBy(F.desc(F.col("end") - F.col("start")), F.desc(priority(F.col("source"))), "start", F.desc("end"), "entity_type")
    return own.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_new", "_chain", "_k")


def drop_contained_array(own: Column, kind: str) -> Column:
    """Spans of an array of type ``kind`` that no other span strictly contains; equal spans stay."""
    return not_contained(own, kind)


def greedy_array(own: Column, size: Column, kind: str) -> Column:
    """From right to left, each span that ends before the last one taken starts; spans carry ``ord``, their input order. Result from left to right."""
    return greedy(own, size, kind)


def summary(own: Column) -> Column:
    """Counts of names, PAN and Aadhaar among spans."""
    count = lambda *kinds: F.size(F.filter(own, lambda s: s["entity_type"].isin(*kinds)))
    return F.struct(count("PERSON", "NAME").alias("names"), count("PAN").alias("pan"), count("AADHAAR").alias("aadhaar"))


def summary_text(counts: Column) -> Column:
    plural = F.when(counts["names"] == 1, "").otherwise("s")
    return F.concat(F.lit("Hidden: "), counts["names"].cast("string"), F.lit(" name"), plural, F.lit(", "), counts["pan"].cast("string"), F.lit(" PAN, "), counts["aadhaar"].cast("string"), F.lit(" Aadhaar"))
