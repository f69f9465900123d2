"""Helpers shared by the corpus operators: scratch tables, row locators, bounded broadcasts.

Scratch tables go to the folder that ``spark.checkpoint.dir`` names, which driver and executors
share, so a lost executor never loses them. The setting is only filled in here when it is unset,
as in tests.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows (of a few short columns each) up to which a table counted beforehand is broadcast.
BROADCAST_ROWS = 400_000
#: Bytes of files up to which a staged table is.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster see; a temporary one only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidewright-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        found = "file://" + found
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/tidewright/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    _staged.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


#: Staged tables of this process, in the order in which they were written.
_staged: list[str] = []


def staged() -> int:
    """How many tables are staged so far: a mark for sweep."""
    return len(_staged)


def sweep(spark: SparkSession, since: int, keep: list[DataFrame]) -> None:
    """Delete the tables staged after the mark ``since``, but for ``keep``: nothing may need them any more."""
    kept = {df.staged_at for df in keep}
    for path in _staged[since:]:
        if path not in kept:
            remove(spark, path)
    _staged[since:] = [p for p in _staged[since:] if p in kept]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch data with what is in it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path for Python workers; the same for file:, hdfs: or an object store."""
    return pafs.FileSystem.from_uri(uri)


def located(docs: DataFrame, file: str, row: str) -> DataFrame:
    """``docs`` with the file and row number of each row, which name a row even if ids repeat.

    A frame that isn't a plain file scan is staged first, so that the locator stays the same each
    time it is read.
    """
    def with_locator(df: DataFrame) -> DataFrame:
        hidden = df.metadataColumn("_metadata")  # even where a column of the table has this name
        return df.select("*", hidden["file_path"].alias(file), hidden["row_index"].alias(row))

    try:
        return with_locator(docs)
    except AnalysisException:
        return with_locator(stage(docs, "located"))


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def as_scan(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows can be located as they are, else staged: to be located more than once."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
        return docs
    except AnalysisException:
        return stage(docs, "located")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A staged table, marked for broadcast if it was counted to have at most ``rows`` rows, and its files to have at most ``size`` bytes."""
    path = getattr(df, "staged_at", None)
    if path is not None and bytes_of(df.sparkSession, path) > size:
        return df
    return F.broadcast(df) if df.count() <= rows else df


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def drop_rows(docs: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` without the rows that ``dropped`` (staged) names by ``keys``."""
    return docs.join(bounded(dropped), keys, "left_anti")


def check_hash_seed() -> None:
    """Python's hash() must agree between workers; Spark sees to that unless it is overridden."""
    if sys.flags.hash_randomization and not os.environ.get("PYTHONHASHSEED", "").isdigit():
        raise RuntimeError("PYTHONHASHSEED must be a fixed number for all Python workers")


def batch_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 of a string column, b'' for nulls, without a detour through str."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Bytes of text that a Python worker handles at a time.
PORTION = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str | int = "text", size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of ``size`` bytes of text each, or of one longer text; what a worker holds for a batch doesn't outlive it."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        low = 0
        while low < b.num_rows:
            start = ends[low] - lengths[low]
            high = max(low + 1, int(np.searchsorted(ends, start + size, side="right")))
            yield b.slice(low, high - low)
            low = high
    give_back()


def give_back() -> None:
    """Return memory that this Python worker no longer uses: it stays alive for later tasks, of other stages too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def crc32_of(column: str):
    """Unsigned crc32 of a column's text form."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


#: Arrow batches between the JVM and Python workers, both of which hold whole ones: what Spark has by default, and what is set here in its place.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": (("10000",), "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (("64MB", "67108864b", "67108864"), "8MB")}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, and make Arrow batches small unless the session says otherwise."""
    global _shipped
    for key, (default, small) in _BATCHES.items():
        if spark.conf.get(key) in default:
            spark.conf.set(key, small)
    if _shipped == spark.sparkContext.applicationId:
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tidewright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/tidewright.zip", "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(f"{folder}/tidewright.zip")
    _shipped = spark.sparkContext.applicationId


_shipped = ""


def spread(df: DataFrame) -> DataFrame:
    """``df`` as it is scanned, ready for Python workers; inputs in fewer partitions than cores are dealt out first."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
