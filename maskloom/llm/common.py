"""Helpers that the operators of this subpackage share.

Everything here keeps its state in one of two places: columns of a DataFrame, or Parquet
tables below the folder that ``spark.checkpoint.dir`` names, which driver and executors share.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch; bounds what a Python worker receives at once when texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
#: Spark's settings: most bytes in a batch; whether a plan's shuffle files go when it has ended.
MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    size = re.sub(r"b$", "", spark.conf.get(MOST_BYTES))
    if not size.isdigit() or not 0 < int(size) <= BATCH_BYTES:
        spark.conf.set(MOST_BYTES, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in a single local JVM (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = getattr(spark, "_maskloom_dir", None)
        if not found:
            found = spark._maskloom_dir = "file://" + tempfile.mkdtemp(prefix="maskloom-")
    return found.rstrip("/")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Scratch:
    """Tables that cut lineage: written once into the shared folder, read again by later stages.

    A lost executor costs only the tasks of the stage that runs, as each earlier table stays. ``drop`` removes
    a table that no later stage reads; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def _path(self, name: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def write(self, df: DataFrame, name: str, **options: Any) -> DataFrame:
        """The table, written and read again; shuffle files of its plan go as soon as it is written."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.options(**options).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.drop("")
        except Exception:  # the session has ended already
            return


_kept: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What tasks of one operator share in a Python worker: a model, a vocabulary, known words. Only one such thing stays in memory."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def nothing_kept() -> None:
    """For operators that keep nothing: let go of what others have kept in this worker."""
    _kept.clear()


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, out=out)


def range_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges: equal for equal bytes, wherever they lie and whatever lies around them."""
    total = _powers(MULTIPLIER, len(data))
    total *= BYTE_CODE[data]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(total, out=total)])
    own = total[end] - total[first]
    del total
    own *= _powers(INVERSE, len(data) + 1)[first]
    return mix64(own + (end - first).astype(np.uint64))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes joined, and each text's start (one more for the end); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    column = pc.fill_null(column, b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    joined = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return joined, offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int) -> Iterator[pa.Table]:
    """Tables of whole rows with about ``most`` bytes of text each; a longer text is a table of its own."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most - size, "right")))
            to = min(to, batch.num_rows)
            kept.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - before
            at = to
            if size >= most or at < batch.num_rows:
                yield pa.Table.from_batches(kept)
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def from_ipc(payload: Any) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


BLOCKS = T.StructType([T.StructField("block_id", T.LongType()), T.StructField("payload", T.BinaryType())])


def pack_blocks(df: DataFrame, text: str, block_bytes: int) -> DataFrame:
    """Rows packed into blocks: block_id, payload (an Arrow stream with all columns, zstd). No shuffle.

    A block is what later stages exchange with the rest of the corpus: it pre-aggregates what its rows share, and
    its answers return to it by ``block_id``. Write the result before use: the ids follow the scan's partitions.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        nothing_kept()
        base = TaskContext.get().partitionId() << 32
        for k, table in enumerate(slices(batches, text, block_bytes)):
            yield pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), pa.array([to_ipc(table)], pa.binary())], ["block_id", "payload"])

    return df.mapInArrow(pack, BLOCKS)


def packed(values: np.ndarray) -> bytes:
    """A numeric array as bytes, like bytes of all values beside each other, zstd."""
    raw = np.ascontiguousarray(values)
    return pa.compress(np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T).tobytes(), codec="zstd", asbytes=True) if len(raw) else b""


def unpacked(blob: bytes, n: int, dtype: Any) -> np.ndarray:
    if n == 0:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).ravel()


def small_rows(df: DataFrame, most: int) -> list[Any]:
    """Rows whose number a parameter bounds; more than that is a fault, never a silent cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows where a bound was promised")
    return rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str) -> Any:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: DuckDB SQL: the checksum's change by each byte, and with it the checksum of the bytes that a hex string gives.
CRC_RULE = "SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, j: xor(c >> 1, (c & 1) * 3988292384))) AS steps"


def crc32_sql(hexed: str) -> str:
    """CRC-32 in DuckDB, next to a table of CRC_RULE."""
    codes = f"list_transform(regexp_extract_all({hexed}, '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295)"
