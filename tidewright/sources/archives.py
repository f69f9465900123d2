"""Archives as tables: one row for each entry, nested archives opened within fixed limits, and what is unsafe about them."""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.resolve import ranked_match
from ..workers import ship

ENTRY = "archive string, entry string, depth int, bytes long, sha256 string, content binary, reason string"


@dataclass(frozen=True)
class Limits:
    """Bounds of what is unpacked of one archive; exceeding one is reported, never silent."""

    entries: int = 100_000
    total_bytes: int = 2 << 30
    depth: int = 3
    nested_bytes: int = 64 << 20


def read(spark: SparkSession, root: str) -> DataFrame:
    """``archive, content`` of the .jar, .war, .ear and .zip files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jar,war,ear,zip}").load(root)
    return files.select(F.col("path").alias("archive"), "content")


def unsafe_name(name: str) -> bool:
    flat = name.replace("\\", "/")
    return flat.startswith("/") or flat[1:2] == ":" or ".." in flat.split("/") or "\0" in flat


def walk(archive: str, content: bytes, keep: tuple[str, ...], limits: Limits) -> Iterator[tuple]:
    """The entries of an archive, those of nested ones after their own; the name of a nested entry is outer!/inner."""
    seen = spent = 0
    queue = [("", content, 0)]
    while queue:
        prefix, data, depth = queue.pop(0)
        try:
            z = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
            yield archive, prefix.removesuffix("!/"), depth, len(data), None, None, "ARCHIVE_FORMAT_INVALID"
            continue
        met = set()
        for info in z.infolist():
            if info.is_dir():
                continue
            name, seen = prefix + info.filename, seen + 1
            reason = None
            if seen > limits.entries:
                yield archive, name, depth, info.file_size, None, None, "ARCHIVE_ENTRY_COUNT_EXCEEDED"
                return
            if posixpath.normpath(info.filename) in met:
                reason = "ARCHIVE_DUPLICATE_ENTRY"
            met.add(posixpath.normpath(info.filename))
            if unsafe_name(info.filename):
                reason = "ARCHIVE_ENTRY_PATH_UNSAFE"
            if spent + info.file_size > limits.total_bytes:
                yield archive, name, depth, info.file_size, None, None, "ARCHIVE_UNCOMPRESSED_SIZE_EXCEEDED"
                return
            try:
                with z.open(info) as f:
                    data = f.read(info.file_size + 1)
            except (zipfile.BadZipFile, RuntimeError, OSError, NotImplementedError, EOFError, zipfile.zlib.error):
                yield archive, name, depth, info.file_size, None, None, "ARCHIVE_ENTRY_UNREADABLE"
                continue
            spent += len(data)
            if info.filename.lower().endswith((".jar", ".war", ".zip")):
                if depth + 1 > limits.depth:
                    reason = reason or "ARCHIVE_NESTED_DEPTH_EXCEEDED"
                elif len(data) > limits.nested_bytes:
                    reason = reason or "ARCHIVE_NESTED_SIZE_EXCEEDED"
                else:
                    queue.append((name + "!/", data, depth + 1))
            yield archive, name, depth, len(data), hashlib.sha256(data).hexdigest(), data if info.filename.endswith(keep) else None, reason


def entries(files: DataFrame, keep: tuple[str, ...] = (), limits: Limits = Limits()) -> DataFrame:
    """One row for each entry of ``archive, content``, with its digest; contents only of names that end as ``keep`` says.

    ``reason`` says what is unsafe about an entry, or about the archive from there on. An archive is opened in one
    task, within ``limits``; a null content is an invalid archive.
    """
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            for archive, content in zip(b["archive"], b["content"]):
                rows = []
                for row in walk(archive, content or b"", keep, limits):
                    rows.append(row)
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = [x.split()[0] for x in ENTRY.split(", ")]
    return files.select("archive", "content").mapInPandas(run, ENTRY)


def verdicts(found: DataFrame) -> DataFrame:
    """``archive, n_entries, bytes, safe, reasons`` (sorted, distinct) of ``entries``."""
    g = found.groupBy("archive").agg(F.count("*").alias("n_entries"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return g.select("archive", "n_entries", "bytes", (F.size("reasons") == 0).alias("safe"), "reasons")


def class_name(entry: Column) -> Column:
    """The class that an entry holds, by its path inside the innermost archive; null for others."""
    inner = F.regexp_replace(F.element_at(F.split(entry, "!/"), -1), r"^(META-INF/versions/\d+/|BOOT-INF/classes/|WEB-INF/classes/)+", "")
    return F.when(entry.endswith(".class") & ~entry.endswith("module-info.class"), F.translate(F.regexp_replace(inner, r"\.class$", ""), "/", "."))


def effective(found: DataFrame, release: int) -> DataFrame:
    """The class entries that a Java of ``release`` loads from each archive: of versioned ones the latest not after it."""
    version = F.coalesce(F.regexp_extract("entry", r"META-INF/versions/(\d+)/", 1).try_cast("int"), F.lit(0))
    place = F.when(F.col("entry").contains("!/"), F.regexp_replace("entry", "!/[^!]*$", "")).otherwise("")
    c = found.withColumn("class", class_name(F.col("entry"))).where("class IS NOT NULL").withColumn("version", version).withColumn("place", place).where(F.col("version") <= release)
    row = F.struct("entry", "sha256", "content", "version")
    return c.groupBy("archive", "place", "class").agg(F.max_by(row, F.struct("version", "entry")).alias("r")).select("archive", "place", "class", "r.*")


def class_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``class, change`` (added, removed, modified) between two sets of ``class, sha256``; equal bytes give no row."""
    o, n = old.groupBy("class").agg(F.min("sha256").alias("o")), new.groupBy("class").agg(F.min("sha256").alias("n"))
    both = o.join(n, "class", "full").where(~F.col("o").eqNullSafe(F.col("n")))
    return both.select("class", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("modified").alias("change"))


def packaged(found: DataFrame) -> DataFrame:
    """``archive, entry, sha256, coord, version, status`` of nested archives, with the coordinates that their build metadata states.

    ``found`` as of entries, with the contents of pom.properties kept. Of several coordinates in one archive the one that its file is named after
    counts; where that doesn't settle it the status is ambiguous, without any metadata unresolved.
    """
    nested = found.where(F.lower("entry").rlike(r"\.(jar|war|zip)$")).select("archive", "entry", "sha256")
    text = F.col("content").cast("string")
    get = lambda k: F.regexp_extract(text, rf"(?m)^\s*{k}\s*=\s*(\S+)", 1)
    stated = found.where(F.col("entry").rlike(r"!/META-INF/maven/[^!]*pom\.properties$") & F.col("content").isNotNull())
    stated = stated.select("archive", F.regexp_replace("entry", r"!/META-INF/maven/[^!]*$", "").alias("entry"), F.concat_ws(":", get("groupId"), get("artifactId"), get("version")).alias("gav"), F.concat(get("artifactId"), F.lit("-"), get("version")).alias("named"))
    file = F.regexp_replace(F.element_at(F.split("entry", "/"), -1), r"\.\w+$", "")
    claims = stated.where("gav NOT LIKE '%::%' AND gav NOT LIKE ':%' AND gav NOT LIKE '%:'").select("archive", "entry", "gav", F.when(file == F.col("named"), 0).otherwise(1).alias("match_rank"))
    met = ranked_match(nested, ["archive", "entry"], claims, "gav")
    part = F.split("gav", ":")
    return nested.join(met, ["archive", "entry"]).select("archive", "entry", "sha256", F.concat_ws(":", part[0], part[1]).alias("coord"), part[2].alias("version"), "status")
