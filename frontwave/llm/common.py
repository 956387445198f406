"""What the operators share: scratch folders on the shared store, table readers, word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, read by Spark only (the folder may be in a store that Python cannot open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(batch: pa.RecordBatch, column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in a string or binary column are about ``most`` bytes together, or one row: what a function makes of one is bounded, whatever the batch (Spark bounds that by its bytes)."""
    size = np.frombuffer(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()).buffers()[1], np.int64, batch.num_rows) if batch.num_rows else np.empty(0, np.int64)
    ends, first = np.cumsum(size + 64), 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        yield batch.slice(first, end - first)
        first = end


#: Tables that a worker keeps from task to task, by the name of the operator they are for.
KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """An operator's table that lives on in a worker until a task of another operator comes."""
    return KEPT.setdefault(name, {})


def bounded(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 21, keep: str = "") -> Iterator[pa.RecordBatch]:
    """The :func:`parts` of all batches. A worker lives on beside those of other stages: before a task it forgets what it kept for operators other than ``keep``, and at its end what it holds free goes back to the system."""
    stale = [t for name, t in KEPT.items() if name != keep and t]
    for held in stale:
        held.clear()
    if stale:
        release()
    for batch in batches:
        yield from parts(batch, column, most)
    release()


def release() -> None:
    """Give freed memory of this process back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table_of_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts, end to end, and where each text begins (and the end). A null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(ends, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    every = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return every[bounds[0] : bounds[-1]], bounds - bounds[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset (tests), a temporary one, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark.sparkContext, "_frontwave_dir", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="frontwave-")
        spark.sparkContext._frontwave_dir = made
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/frontwave/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    """Delete what :func:`written` wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hash_unit(column, seed: int):
    """A uniform number in [0, 1) from a value, the same in Spark and in other SQL engines (52 bits of MD5)."""
    digest = F.md5(F.concat(column.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
