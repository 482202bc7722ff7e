"""Shared plumbing of the corpus operators: table access, shared scratch space, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch. Texts can be long, so the defaults (10,000 rows, 64 MB) are too much for one Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data folder, read by Spark alone (the folder may be in any store that Spark knows)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fresh(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, or the session's checkpoint folder. Only a local master may go without one."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or (current.get() if current.isDefined() else None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="waymesh-")
        spark.sparkContext.setCheckpointDir(folder)
    return qualified(spark, folder)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI: one without a scheme is in Spark's default file system, wherever that is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI (see :func:`qualified`)."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), os.path.abspath(uri)) if "://" not in uri and not uri.startswith("file:") else fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


_resident: dict = {}


def resident(key, make):
    """What a worker process keeps between its tasks: one thing at a time, so that stages of a pipeline don't add up."""
    if key not in _resident:
        release()
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Drop what an earlier stage has left in this worker process, and give free memory back to the system."""
    _resident.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, places) of an Arrow column of texts: text i is bytes[places[i] : places[i + 1]]; null is the empty text."""
    wide = pa.types.is_large_string(column.type)
    data = column.buffers()[2]
    begin = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[begin[0] : begin[-1]], begin - begin[0]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names))


def row_hash(columns: list[str], seed: int = 0) -> Column:
    """A hash of a row that tells nulls in different columns apart."""
    return F.xxhash64(F.lit(seed), *(x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))))


def hashed_share(df: DataFrame, key: str, rows: int, seed: int = 17) -> DataFrame:
    """All rows, if there are ``rows`` at most; else about as many different rows: those whose hash is small, each once.

    The hash is of the whole row, the key first, so the same rows are taken however the table is split, and a row that is repeated very
    often counts like any other. The number of different rows comes from a sketch that doesn't depend on the split either.
    """
    row = row_hash([key, *(c for c in df.columns if c != key)], seed)
    total, different = df.agg(F.count("*"), F.approx_count_distinct(row)).first()
    if total <= rows:
        return df
    share = fresh("__share", df.columns)
    some = df.withColumn(share, row).filter(F.pmod(share, F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(1, different))))
    return some.dropDuplicates([share]).drop(share)
