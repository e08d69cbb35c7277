"""Reproducible shuffling and sharding by a Feistel permutation over global row numbers.

Rows are numbered 0..N-1 in the order of (id, text checksum, size). A keyed Feistel network permutes the next larger
power of four; cycle walking (apply it again until the value is below N) makes that a permutation of 0..N-1. Position p
lies in shard p mod S at slot p div S, so anyone can compute where a row number lies, and by the inverse which row lies
at a slot, without a table.

Defined results: a null id sorts before all others; a null text has size 8 and checksum 0; repeated rows take
neighbouring numbers (which of them takes which makes no difference); an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CRC_RULE, crc32_sql, mix64, prepare, shuffle_partitions

ROUNDS = 6
#: Rows that one range of ids holds at most, about; the number of ranges grows with the table.
RANGE_ROWS = 200_000


def _keys(seed: int) -> np.ndarray:
    return mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (2**64 - 1)))


def _half_bits(n: int) -> int:
    return max(1, -(-max(1, n - 1).bit_length() // 2))


def _network(x: np.ndarray, bits: int, keys: np.ndarray, back: bool) -> np.ndarray:
    b, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> b, x & mask
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (mix64(left + key) & mask), left
        else:
            left, right = right, left ^ (mix64(right + key) & mask)
    return (left << b) | right


def permute(x: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (``back``: its inverse) on an array of numbers below n."""
    bits, keys = _half_bits(n), _keys(seed)
    out = np.asarray(x).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _network(out[todo], bits, keys, back)
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def place(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number that lies at a slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def shard(docs: DataFrame, shards: int = 24, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, position, law, shard, slot, grown_shard (null under the law ``rows``).

    Three passes: row count and quantiles of the id, rows in each id range, then the numbering. Only id, size and
    checksum are shuffled, once, by id range; the driver receives the ranges' counts, one for RANGE_ROWS rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(text_col).cast("string")
    ids = docs.select(F.col(id_col).cast("bigint").alias("doc_id"))
    n = ids.count()
    ranges = max(4 * shuffle_partitions(spark), -(-n // RANGE_ROWS))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], max(10_000, 20 * ranges))).head()[0] if ranges > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))
    lowest = -(2**63)

    @F.pandas_udf("bigint")
    def range_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, x.to_numpy(np.int64), "left"))

    range_col = range_of(F.coalesce("doc_id", F.lit(lowest)))
    counts = np.zeros(len(bounds) + 2, np.int64)
    for k, c in ids.select(range_col.alias("r")).groupBy("r").count().collect():
        counts[k + 1] = c
    starts = np.cumsum(counts)

    @F.pandas_udf("struct<row_number: bigint, position: bigint>")
    def positions(r: pd.Series, k: pd.Series) -> pd.DataFrame:
        rows = starts[r.to_numpy(np.int64)] + k.to_numpy(np.int64) - 1
        return pd.DataFrame({"row_number": rows, "position": permute(rows, n, seed)})

    sized = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"),
    ).withColumn("_range", range_col)
    order = Window.partitionBy("_range").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    placed = sized.withColumn("_k", F.row_number().over(order)).withColumn("_p", positions("_range", "_k"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.col("_p.row_number").alias("row_number"), F.col("_p.position").alias("position"), F.lit("rows").alias("law"),
        (F.col("_p.position") % shards).cast("int").alias("shard"), F.floor(F.col("_p.position") / shards).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def oracle_sql(shards: int = 24, seed: int = 20) -> str:
    """The rows of ``shard`` in DuckDB: checksums by bytes, the network in wide integers, cycle walking as a recursion."""
    wide = f"{1 << 64}::UHUGEINT"

    def let(value: str, name: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def mix(x: str) -> str:
        last = let(f"(xor(y, y >> 27) * {0x94D049BB133111EB}::UHUGEINT) % {wide}", "z", "xor(z, z >> 31)")
        return let(x, "x", let(f"(xor(x, x >> 30) * {0xBF58476D1CE4E5B9}::UHUGEINT) % {wide}", "y", last))

    key = mix(f"(i::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT + {seed}::UHUGEINT) % {wide}")
    turn = mix(f"(s.b + k.a) % {wide}")
    halves = f"list_reduce(list_concat([{{'a': p >> bits, 'b': p & low}}], keys), lambda s, k: {{'a': s.b, 'b': xor(s.a, {turn} & low)}})"
    return f"""WITH RECURSIVE rule AS ({CRC_RULE}),
    sized AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size, coalesce({crc32_sql("hex(encode(text))")}, 0) AS text_crc32 FROM documents, rule),
    numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number FROM sized),
    law AS (SELECT n, bits, ((1::UHUGEINT << bits) - 1::UHUGEINT) AS low, list_transform(range(1, {ROUNDS + 1}), lambda i: {{'a': {key}, 'b': 0::UHUGEINT}}) AS keys
        FROM (SELECT n, greatest(1, (length(bin(greatest(1, n - 1))) + 1) // 2)::UHUGEINT AS bits FROM (SELECT count(*) AS n FROM documents))),
    walk AS (SELECT row_number AS r, row_number::UHUGEINT AS p, 0 AS walked FROM numbered
        UNION ALL SELECT r, {let(halves, "s", "(s.a << bits) | s.b")}, walked + 1 FROM walk, law WHERE walked = 0 OR p >= n),
    placed AS (SELECT r AS row_number, p::BIGINT AS position FROM walk, law WHERE walked > 0 AND p < n)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, CAST(row_number AS BIGINT) AS row_number, position, 'rows' AS law,
        CAST(position % {shards} AS INTEGER) AS shard, CAST(position // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM numbered JOIN placed USING (row_number)"""
