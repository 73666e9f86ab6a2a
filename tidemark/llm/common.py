"""What the training-data operators share: inputs, lineage cuts and Arrow slices."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes that a NumPy kernel handles at a time (a longer text is a slice of its own).
SLICE_BYTES = 2 << 20
#: Bytes of rows that Spark hands to a Python worker at a time.
ARROW_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, whose Arrow batches from now on have ARROW_BYTES at most: long texts would make them large, on either
    side of a Python worker. A session that asks for less keeps its setting."""
    now = spark.conf.get(_BATCH)
    if not now.removesuffix("b").isdigit() or int(now.removesuffix("b")) > ARROW_BYTES:
        spark.conf.set(_BATCH, f"{ARROW_BYTES}b")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    small_batches(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where it is unset, as in tests, a folder under the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the tables written inside, but those written to `stay`: what outlives it must read no others."""
    mine: list[str] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.remove(mine)
        for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, mine):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str, codec: str = "zstd", stay: bool = False, **options: str | int) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lineage cut that outlives lost executors. `options`
    are the writer's; a table written to `stay` outlives a scratch scope."""
    spark = small_batches(df.sparkSession)
    path = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
    if _scopes and not stay:
        _scopes[-1].append(path)
    df.write.options(**options).option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that are broadcast at most (16 bytes each); more are joined by a shuffle.
SMALL = 2_000_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most SMALL rows; df is a written table of narrow rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` over batches, after which the memory that it has freed goes back to the system: Python workers are used again
    by later tasks and stages, and would keep the largest slice that any of them held."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return whole


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, UTF-8 bytes, byte offsets) of consecutive rows of at most `limit` bytes together; null texts are empty."""
    arr = batch.column(batch.schema.get_field_index(column))
    if arr.null_count:
        arr = arr.fill_null("" if not pa.types.is_binary(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    n = len(arr)
    if n == 0:
        return
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[np.ndarray]]:
    """The columns of batches ordered by the first column, in runs of about `least` rows or more of whole groups."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([np.asarray(c) if not pa.types.is_binary(c.type) else np.array(c.to_pylist(), object) for c in batch.columns])
        rows += batch.num_rows
        if rows < least or held[0][0][0] == held[-1][0][-1]:
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        last = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1  # the last group may go on
        yield [c[:last] for c in cols]
        held, rows = [[c[last:] for c in cols]], len(cols[0]) - last
    if rows:
        yield [np.concatenate(c) for c in zip(*held)]
