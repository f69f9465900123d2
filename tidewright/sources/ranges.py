"""Large archives read by many tasks: each takes a run of the entries that the archive's directory lists.

A first step reads the directories alone, from the ends of the files; runs of entries are then dealt out, and each is read by seeking. The limits hold over the whole
archive: those on what the directory states are checked there, those on nested archives by adding up what the runs have found.
"""

from __future__ import annotations

import hashlib
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..workers import ship
from .archives import ENTRY, Limits, unsafe_name, walk

RUN = "archive string, run int, first int, entries int, bytes long, reason string"
#: How many times an entry may be larger than it is stored before it is refused, if it has at least so many bytes.
RATIO, RATIO_BYTES = 200, 1 << 20
_BROKEN = (zipfile.BadZipFile, RuntimeError, OSError, NotImplementedError, EOFError, ValueError, zipfile.zlib.error)


def _open(path: str):
    files, name = pafs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pafs.LocalFileSystem(), path)
    return files.open_input_file(name)


def list_archives(spark: SparkSession, root: str) -> DataFrame:
    """``archive`` of the .jar, .war, .ear and .zip files below ``root``; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jar,war,ear,zip}").load(root)
    return found.select(F.col("path").alias("archive"))


def runs(archives: DataFrame, run_bytes: int = 64 << 20, limits: Limits = Limits(), ratio: int = RATIO) -> DataFrame:
    """``archive, run, first, entries, bytes, reason`` of runs of entries that have about ``run_bytes`` unpacked, as the directories of the archives state.

    An archive beyond the limits on entries or bytes has runs up to there and a row with the reason; one that can't be opened has only that. Entries that are packed more than ``ratio`` times make a run of their own
    with a reason, which isn't read.
    """
    ship(archives.sparkSession)

    def listed(path: str) -> Iterator[tuple]:
        try:
            with _open(path) as f, zipfile.ZipFile(f) as z:
                infos = z.infolist()
        except _BROKEN:
            yield path, None, None, None, None, "ARCHIVE_FORMAT_INVALID"
            return
        run = first = held = total = many = 0
        for k, info in enumerate(infos):
            many, total = many + (not info.is_dir()), total + info.file_size
            over = "ARCHIVE_ENTRY_COUNT_EXCEEDED" if many > limits.entries else "ARCHIVE_UNCOMPRESSED_SIZE_EXCEEDED" if total > limits.total_bytes else None
            packed = info.file_size >= RATIO_BYTES and info.file_size > ratio * max(info.compress_size, 1)
            if k > first and (over or packed or held + info.file_size > run_bytes):
                yield path, run, first, k - first, held, None
                run, first, held = run + 1, k, 0
            if over:
                yield path, None, k, None, None, over
                return
            held += info.file_size
            if packed:
                yield path, run, k, 1, info.file_size, "ARCHIVE_EXPANSION_RATIO_EXCEEDED"
                run, first, held = run + 1, k + 1, 0
        if first < len(infos):
            yield path, run, first, len(infos) - first, held, None

    def read(batches):
        for b in batches:
            yield pd.DataFrame([r for p in b["archive"] for r in listed(p)], columns=[c.split()[0] for c in RUN.split(", ")], dtype=object)

    return archives.select("archive").mapInPandas(read, RUN)


def entries(archives: DataFrame, keep: tuple[str, ...] = (), limits: Limits = Limits(), run_bytes: int = 64 << 20, ratio: int = RATIO) -> DataFrame:
    """One row for each entry of ``archive`` (paths), as archives.entries gives them, read by runs of about ``run_bytes``.

    Nested archives are opened where they are found, in memory, within the limits on depth and size. Names that come twice in an archive are found over all runs. What is beyond the limits once nested archives are
    counted is told by over_limits.
    """
    spark = archives.sparkSession
    dealt = runs(archives, run_bytes, limits, ratio)
    names = [c.split()[0] for c in ENTRY.split(", ")]
    # Runs are the unit of work.
    work = dealt.where("reason IS NULL").repartition(F.col("archive"), F.col("run"))

    def read_run(path: str, first: int, many: int) -> Iterator[tuple]:
        with _open(path) as f, zipfile.ZipFile(f) as z:
            for info in z.infolist()[first : first + many]:
                if info.is_dir():
                    continue
                reason = "ARCHIVE_ENTRY_PATH_UNSAFE" if unsafe_name(info.filename) else None
                try:
                    with z.open(info) as e:
                        data = e.read(info.file_size + 1)
                except _BROKEN:
                    yield path, info.filename, 0, info.file_size, None, None, "ARCHIVE_ENTRY_UNREADABLE"
                    continue
                if len(data) > info.file_size:
                    reason = reason or "ARCHIVE_ENTRY_SIZE_MISMATCH"
                inner = ()
                if info.filename.lower().endswith((".jar", ".war", ".zip")):
                    if limits.depth < 1:
                        reason = reason or "ARCHIVE_NESTED_DEPTH_EXCEEDED"
                    elif len(data) > limits.nested_bytes:
                        reason = reason or "ARCHIVE_NESTED_SIZE_EXCEEDED"
                    else:
                        inner = walk(path, data, keep, Limits(limits.entries, limits.total_bytes, limits.depth - 1, limits.nested_bytes))
                yield path, info.filename, 0, len(data), hashlib.sha256(data).hexdigest(), data if info.filename.endswith(keep) else None, reason
                for archive, name, depth, size, sha, content, why in inner:
                    yield archive, f"{info.filename}!/{name}".removesuffix("!/"), depth + 1, size, sha, content, why

    def read(batches):
        for b in batches:
            for path, first, many in zip(b["archive"], b["first"], b["entries"]):
                held, size = [], 0
                for row in read_run(path, int(first), int(many)):
                    held.append(row)
                    size += len(row[5] or b"") + 200
                    if size > 8 << 20:
                        yield pd.DataFrame(held, columns=names, dtype=object)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=names, dtype=object)

    ship(spark)
    found = work.select("archive", "first", "entries").mapInPandas(read, ENTRY)
    again = F.row_number().over(Window.partitionBy("archive", "depth", "_name").orderBy("entry", F.col("sha256")))
    plain = F.regexp_replace(F.regexp_replace("entry", r"(^|/)(\./)+", "$1"), "/+", "/")
    found = found.withColumn("_name", plain).withColumn("_again", again)
    found = found.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("depth") == 0) & (F.col("_again") > 1), "ARCHIVE_DUPLICATE_ENTRY").otherwise(F.col("reason"))).drop("_name", "_again")
    refused = dealt.where("reason IS NOT NULL").select("archive", F.lit("").alias("entry"), F.lit(0).alias("depth"), "bytes", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("binary").alias("content"), "reason")
    return found.unionByName(refused)


def over_limits(found: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``archive, reason`` of archives that, with all that is nested in them, hold more than the limits let."""
    g = found.groupBy("archive").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    why = F.when(F.col("n") > limits.entries, "ARCHIVE_ENTRY_COUNT_EXCEEDED").when(F.col("bytes") > limits.total_bytes, "ARCHIVE_UNCOMPRESSED_SIZE_EXCEEDED")
    return g.select("archive", why.alias("reason")).where("reason IS NOT NULL")

