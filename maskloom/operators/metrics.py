"""Scores of predictions: argmax, agreement, entity-level precision, recall and F1 on BIO tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def argmax(logits: Column) -> Column:
    """The first place of the largest value, from 0."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def similarity(a: Column, b: Column) -> Column:
    """Matching places in per cent of all places."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, same * 100.0 / F.size(a)).otherwise(F.lit(0.0))


def entities(tags: Column) -> Column:
    """array<struct<kind, start, end>> (end inclusive) of BIO tags; an inside tag of another type, or after outside, begins an entity."""
    none = F.array().cast("array<struct<kind: string, start: int, end: int>>")
    indexed = F.transform(tags, lambda t, i: F.struct(F.substring(t, 1, 1).alias("p"), F.substring(t, 3, 100).alias("k"), i.alias("i")))

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        goes_on = (x["p"] == "I") & (F.size(out) > 0) & (last["kind"] == x["k"]) & (last["end"] == x["i"] - 1)
        longer = F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), F.struct(last["kind"].alias("kind"), last["start"].alias("start"), x["i"].alias("end")))
        return F.when(x["p"] == "O", out).when(goes_on, longer).otherwise(F.array_append(out, F.struct(x["k"].alias("kind"), x["i"].alias("start"), x["i"].alias("end"))))

    return F.aggregate(indexed, none, step)


def scores(rows: DataFrame, pred: str = "pred", true: str = "true") -> DataFrame:
    """One row: precision, recall, f1 over all entities of all rows. Sums are partial before they are exchanged."""
    own = rows.select(entities(F.col(pred)).alias("p"), entities(F.col(true)).alias("t"))
    sums = own.agg(F.sum(F.size(F.array_intersect("p", "t"))).alias("hit"), F.sum(F.size("p")).alias("np"), F.sum(F.size("t")).alias("nt"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return sums.select(ratio("hit", "np").alias("precision"), ratio("hit", "nt").alias("recall"), F.when(F.col("np") + F.col("nt") > 0, 2.0 * F.col("hit") / (F.col("np") + F.col("nt"))).otherwise(F.lit(0.0)).alias("f1"))
