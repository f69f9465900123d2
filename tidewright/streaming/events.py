"""Structured Streaming over event files, and runs of steps that resume where they stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def windowed_counts(events: DataFrame, at: str, keys: list[str], window: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by window and keys; rows later than ``late`` behind the newest are left out by the watermark. Works on streams and tables."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    span = F.window(at, window, slide) if slide else F.window(at, window)
    return timed.groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def session_counts(events: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """Counts by key and session: rows of a key that are no more than ``gap`` apart."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_diagnostics(spark: SparkSession, folder: str, schema: str, ledger: str, checkpoint: str, rows_of: Callable[[DataFrame], DataFrame], files: int = 100) -> int:
    """Take what is new in ``folder`` (Parquet) through ``rows_of`` and write it to ``ledger``, a folder for each batch; the number of batches taken.

    A batch that is repeated after a failure overwrites its own folder, so nothing comes twice; the checkpoint folder holds what was seen.
    """
    taken = []

    def write(batch: DataFrame, number: int) -> None:
        rows_of(batch).write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        taken.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(taken)


def run_steps(spark: SparkSession, steps: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], folder: str, run_id: str, again_from: str | None = None) -> dict[str, DataFrame]:
    """Results of named steps, each written to ``folder/step`` and read again; a step that this run has finished isn't repeated.

    ``again_from`` names a step that, with all after it, is done anew. A step gets the results of those before it. A result counts once its mark is written.
    """
    names = [n for n, _ in steps]
    if again_from is not None and again_from not in names:
        raise ValueError(f"no step {again_from}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    exists = lambda p: hadoop(p).getFileSystem(conf).exists(hadoop(p))
    done: dict[str, DataFrame] = {}
    anew = False
    for name, work in steps:
        anew |= name == again_from
        path, mark = f"{folder}/{name}", f"{folder}/{name}.done/run={run_id}"
        if anew or not exists(mark):
            anew = True  # what comes after is out of date
            hadoop(f"{folder}/{name}.done").getFileSystem(conf).delete(hadoop(f"{folder}/{name}.done"), True)
            work(done).write.mode("overwrite").parquet(path)
            spark.createDataFrame([(name,)], "step string").coalesce(1).write.mode("overwrite").parquet(mark)
        done[name] = spark.read.parquet(path)
    return done
