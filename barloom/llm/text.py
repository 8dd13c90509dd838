"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that end a word: space and \t \n \v \f \r.
WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Most bytes of a batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: Column | str) -> Column:
    """crc32 of the identifier written as text; folds are its remainders."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary"))


def as_bytes(text: Column | str = "text") -> Column:
    """The text as UTF-8 bytes, null as none."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("binary"), F.lit(b""))


def blobs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary Arrow column, without a copy; the offsets start at 0."""
    if pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, off - off[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to `most` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `values` (one for each byte) over each row; rows without bytes get 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python workers hold BATCH_BYTES at most (a longer row stands alone), or fewer where fewer are set. Ten
    thousand rows of texts or sets are tens of megabytes, which a task holds in its buffers and its worker once more."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()
    if not 0 < int(number) * 1024 ** " kmgtp".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: What this worker keeps for its next tasks, one thing at most.
_kept: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What a worker has kept under `key`, made if it has not; what it kept under another key is let go."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Let go what this worker keeps. Workers are used again by later stages, which need the memory for their own."""
    _kept.clear()
    pa.default_memory_pool().release_unused()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the place that driver and executors share (spark.checkpoint.dir). Where it is unset and all runs in one process, as in
    tests, a local one is set; on a cluster it must be set."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/barloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage, and several readers share the work. Rows of megabytes are best left
    uncompressed: a page holds many of them, and the codec would take memory outside the heap for a page at a time."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what `stored` has written; no plan may read it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sampled(df: DataFrame, key: Column, most: int, total: int | None = None) -> DataFrame:
    """About `most` rows of df at most, chosen by a hash of `key`, so alike in every run. For fitting classifiers only."""
    total = df.count() if total is None else total
    if total <= most:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_000)) < int(most / total * 1_000_000))
