"""Shared ground of the training-data operators: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch: texts are long, and Python holds a batch whole.
BATCH_ROWS = "1000"
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; also puts the session settings of these operators in place."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, as ``--py-files`` would; once per Spark application."""
    context = spark.sparkContext
    name = f"factloom-{context.applicationId}.zip"
    if name not in context._python_includes:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="factloom-"), name)
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for n in sorted(names):
                    if n.endswith(".py"):
                        path = os.path.join(folder, n)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)


def configure(spark: SparkSession) -> None:
    ship(spark)
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where it is unset, a local master (tests) gets one of
    its own; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/factloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read from there: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove a written table that nothing needs any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/factloom-" in folder:
            path = hadoop(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@lru_cache(1)
def give_back() -> None:
    """Let a Python worker give large freed blocks back to the system, numpy's and Arrow's: workers live for many
    tasks of many stages, and an executor's memory holds all of them."""
    if TaskContext.get() is not None:
        try:
            ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        except (AttributeError, OSError):
            return  # another C library
        pa.set_memory_pool(pa.system_memory_pool())


def release() -> None:
    """Give small freed blocks back to the system too, those of earlier stages among them."""
    if TaskContext.get() is not None:
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            return  # another C library


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 900_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts hold about ``most`` bytes (one text may be longer)."""
    give_back()
    for batch in batches:
        _, at = text_bytes(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added, or replaced where a name is taken."""
    columns = dict(zip(batch.schema.names, batch.columns)) | new
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from its flat values and the lengths of its rows."""
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
