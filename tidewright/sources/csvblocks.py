"""Quoted CSV read by many tasks: fields may hold line breaks, and still a file needn't be read from its beginning.

A line break is the end of a record only where the quotes before it are even in number. Lines are read in blocks as any text is; each block's number of quotes, added up over the
blocks before it, tells for every block whether it begins inside a quoted field. Only lines of records that are longer than a line are put together by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, line, first, record``: every record of the CSV files at ``path`` as text, where it begins (block and line of the block) and whether it is its file's first.

    Quotes must be doubled within quoted fields and stand nowhere else; a file with an odd number of them fails. Lines end with LF or CRLF, line breaks within
    fields stay as they are; blank lines between records are left out. A block is sorted in a task, a record put together in one.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    lines = lines.withColumn("quotes", quotes)
    totals = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy("file").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("file", "block", F.coalesce(F.sum("quotes").over(before), F.lit(0)).alias("base"), (F.sum("quotes").over(all_of) % 2).alias("odd"))
    so_far = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file", "block").orderBy("line")
    marked = lines.join(totals, ["file", "block"]).withColumn("inside", (F.col("base") + F.coalesce(F.sum("quotes").over(so_far), F.lit(0))) % 2 == 1)
    odd = F.when(F.col("odd") == 1, F.raise_error(F.concat(F.lit("a quoted field isn't closed: "), "file")).cast("boolean")).otherwise(F.col("inside"))
    marked = marked.withColumn("inside", odd)
    ends_here = (F.col("quotes") % 2 == 0) != F.col("inside")  # an even number of quotes up to the end of the line
    alone = marked.where(~F.col("inside") & ends_here).select("file", "block", "line", "text")
    # Lines of longer records: the last beginning at or before each, in its block or in one before it.
    part = marked.where(F.col("inside") | ~ends_here)
    begins = F.when(~F.col("inside"), F.col("line"))
    part = part.withColumn("start", F.last(begins, ignorenulls=True).over(after.rowsBetween(Window.unboundedPreceding, 0)))
    last = part.groupBy("file", "block").agg(F.max(begins).alias("last"))
    carried = last.select("file", "block", F.last(F.when(F.col("last").isNotNull(), F.struct(F.col("block").alias("b"), F.col("last").alias("l"))), ignorenulls=True).over(before).alias("carried"))
    part = part.join(carried, ["file", "block"]).withColumn("of", F.when(F.col("start").isNotNull(), F.struct(F.col("block").alias("b"), F.col("start").alias("l"))).otherwise(F.col("carried")))
    whole = part.groupBy("file", "of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    both = alone.unionByName(whole.select("file", F.col("of.b").alias("block"), F.col("of.l").alias("line"), "text"))
    first = lines.groupBy("file").agg(F.min(F.struct("block", "line")).alias("_first"))
    out = both.withColumn("record", F.regexp_replace("text", "\r$", "")).join(first, "file")
    return out.select("file", "block", "line", (F.struct("block", "line") == F.col("_first")).alias("first"), "record").where("record != '' OR first")


def read_csv(spark: SparkSession, path: str, columns: list[str], required: list[str] | None = None) -> DataFrame:
    """A CSV table like files.read_csv, of records that many tasks have read; see records for what a file must be like."""
    head = spark.read.option("header", True).csv(path).columns
    clean = [c.lstrip("\ufeff").strip() for c in head]
    if lacking := sorted(set(required or ()) - set(clean)):
        raise ValueError(f"{path}: required columns are missing: {', '.join(lacking)}")
    schema = StructType([StructField(f"_{i}", StringType()) for i in range(len(head))])
    rows = records(spark, path).where("NOT first").select(F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"escape": '"', "maxCharsPerColumn": "-1"}).alias("r"))
    place = {c: i for i, c in reversed(list(enumerate(clean)))}
    return rows.select(*[(F.col(f"r._{place[c]}") if c in place else F.lit(None).cast("string")).alias(c) for c in columns])
