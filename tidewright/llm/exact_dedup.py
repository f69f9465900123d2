"""Exact deduplication as a stateful stream, in DataFrame operations only.

Documents arrive as a table of digests, one row each: SHA-256 of the normalised text, identifier and
content locator (file and row number). A structured-streaming aggregation with RocksDB state, which
lives on disk and never expires, takes them in micro-batches and retains for each digest the identifier and locator of the row that
stays and the size of the group. A hit (a digest seen before) is never taken on trust: the full
bytes of every such row are read again by locator and compared with those of the row that stays.
Digests under which texts differ are grouped again by the texts themselves.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import as_scan, bounded, drop_rows, exists, located, release, remove, scratch, stage, staged, sweep, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Micro-batches in which a table's digests arrive: those of later ones meet the state that earlier ones left.
BATCHES = 2
#: Rows of a group whose texts are compared in one task; a larger group is dealt out in chunks, each with the kept text.
CHUNK_ROWS = 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case; null as empty.

    ``lower`` does just that for pure ASCII, several times faster than ``translate``.
    """
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextmanager
def _rocksdb(spark: SparkSession):
    # Executors give up a stopped query's local copies of its state at the next maintenance; logs take up the disk they
    # fill, not 4 MB for each partition beforehand.
    state = "spark.sql.streaming.stateStore."
    wanted = {f"{state}providerClass": ROCKSDB, f"{state}maintenanceInterval": "5s", f"{state}rocksdb.allowFAllocate": "false"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def digest_state(spark: SparkSession, digests: str, schema, state: str, files: int = 1_000) -> DataFrame:
    """Feed what is new in the folder ``digests`` to the keyed state, ``files`` files a micro-batch, and return its present contents.

    ``state`` holds the stream's checkpoint and its output. Called again after more files arrived in
    ``digests``, it continues from the retained state. Identifier and size only ever grow for a
    digest, so the latest of its updates is the largest.
    """
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/updates/batch={number}")

    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(digests)
    per_digest = arrivals.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("top"), F.count("*").alias("size"))
    with _rocksdb(spark):
        query = per_digest.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    if query.lastProgress is None and not exists(spark, f"{state}/updates"):  # nothing has ever arrived
        return spark.createDataFrame([], "digest string, top struct<doc_id: bigint, file: string, row: bigint>, size bigint")
    updates = spark.read.schema("digest string, top struct<doc_id: bigint, file: string, row: bigint>, size bigint, batch int").parquet(f"{state}/updates")
    return updates.groupBy("digest").agg(F.max("top").alias("top"), F.max("size").alias("size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, file, row, text_sha256, keep_id, keep_file, keep_row, group_size``.

    Texts are equal when identical after lower-casing A-Z only; the row with the largest identifier
    stays. Null texts count as empty, null identifiers sort before all others, and of rows that share
    identifier and text the one with the last locator stays, so exactly one row of each group does.
    An empty table gives an empty result. Other columns of ``docs`` are not read. ``digest`` is a
    parameter for tests, which let different texts collide.
    """
    spark = docs.sparkSession
    rows = located(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "file", "row")
    path = scratch(spark, "digests")
    norm = ascii_lower(F.col("text"))
    digests = rows.select("doc_id", "file", "row", digest(norm).alias("digest"))
    digests.write.parquet(path)
    schema, digests = digests.schema, spark.read.schema(digests.schema).parquet(path)
    state = scratch(spark, "dedup-state")
    files = -(-len(digests.inputFiles()) // BATCHES)
    groups = stage(digest_state(spark, path, schema, state, max(1, files)), "dedup-groups")
    remove(spark, state)
    release(spark)
    repeated = bounded(stage(groups.where("size > 1"), "dedup-repeated"))

    # Hits: read the texts of all rows in groups of two or more by their locators and compare bytes.
    chunks = F.ceil(F.col("size") / CHUNK_ROWS)
    chunk = F.pmod(F.xxhash64("file", "row"), chunks)
    members = stage(digests.join(repeated.select("digest", "size"), "digest").select("file", "row", "digest", chunk.alias("chunk")), "dedup-members")
    texts = rows.select("file", "row", "doc_id", norm.alias("text")).join(bounded(members), ["file", "row"])
    texts = stage(texts.select("digest", "chunk", "doc_id", "file", "row", "text"), "dedup-texts")
    keepers = repeated.select("digest", F.col("top.file").alias("file"), F.col("top.row").alias("row"), chunks.alias("chunks"))
    kept_text = texts.drop("chunk").join(keepers, ["digest", "file", "row"]).select("digest", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), F.col("text").alias("kept_text"))
    differs = stage(texts.join(kept_text, ["digest", "chunk"]).where(F.col("text") != F.col("kept_text")).select("digest").distinct(), "dedup-differs")
    if not differs.isEmpty():
        return _regrouped(digests, groups, texts, differs, digest)
    return digests.join(groups, "digest").select(
        "doc_id", "file", "row", F.col("digest").alias("text_sha256"), F.col("top.doc_id").alias("keep_id"), F.col("top.file").alias("keep_file"), F.col("top.row").alias("keep_row"), F.col("size").alias("group_size"))


def _regrouped(digests: DataFrame, groups: DataFrame, texts: DataFrame, differs: DataFrame, digest) -> DataFrame:
    """As exact_groups, where texts that differ share a digest: those are grouped by the texts."""
    again = texts.join(differs, "digest")
    exact = again.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("top"), F.count("*").alias("size"))
    shape = lambda df: df.select("doc_id", "file", "row", F.col("digest").alias("text_sha256"), F.col("top.doc_id").alias("keep_id"), F.col("top.file").alias("keep_file"), F.col("top.row").alias("keep_row"), F.col("size").alias("group_size"))
    sure = digests.join(differs, "digest", "left_anti").join(groups, "digest")
    return shape(sure).unionByName(shape(again.join(exact, ["digest", "text"])))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept (see exact_groups)."""
    docs = as_scan(docs)
    names = docs.columns
    file, row = _free(names, "_dedup_file"), _free(names, "_dedup_row")
    mark = staged()
    groups = exact_groups(docs, id_col, text_col)
    gone = groups.where("file != keep_file OR row != keep_row").select(F.col("file").alias(file), F.col("row").alias(row))
    gone = stage(gone, "dedup-gone")
    sweep(docs.sparkSession, mark, [gone])
    return drop_rows(located(docs, file, row), gone, [file, row]).drop(file, row)


def _free(names: list[str], wanted: str) -> str:
    while wanted in names:
        wanted += "_"
    return wanted


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = exact_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", "keep_id", "group_size", ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256")


OP7_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
