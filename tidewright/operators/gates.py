"""Quality gates on what a job writes: counts are observed while the rows are written, so nothing is read a second time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F


@dataclass(frozen=True)
class Gate:
    """A named condition on the observed counts; null counts (of an empty table) are 0."""

    name: str
    holds: Callable[[dict[str, int]], bool]


class GateFailed(ValueError):
    """What was written doesn't pass; ``failed`` names the gates, ``counts`` is what was observed."""

    def __init__(self, path: str, failed: list[str], counts: dict[str, int]):
        super().__init__(f"{path}: {', '.join(failed)} ({', '.join(f'{k}={v}' for k, v in sorted(counts.items()))})")
        self.failed, self.counts = failed, counts


def verdict_counts(status: str, values: tuple[str, ...]) -> dict[str, Column]:
    """Counts of each verdict, of other ones, and of all rows."""
    known = F.coalesce(F.col(status).isin(*values), F.lit(False))
    return {"rows": F.count(F.lit(1)), "other": F.count_if(~known)} | {v: F.count_if(F.col(status) == v) for v in values}


def admitted(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """Rows that pass all ``checks`` (null counts as failed), and an observation of how many each check has dropped: a row is counted by the first it fails.

    The observation has its counts (``dropped_`` and the check's name, ``kept``) once an action over the rows is done.
    """
    first = None
    for name, ok in checks.items():
        bad = ~F.coalesce(ok, F.lit(False))
        first = F.when(bad, F.lit(name)) if first is None else first.when(bad, F.lit(name))
    seen = Observation()
    marked = rows.withColumn("_dropped", first if first is not None else F.lit(None).cast("string"))
    counted = marked.observe(seen, F.count_if(F.col("_dropped").isNull()).alias("kept"), *[F.count_if(F.col("_dropped") == n).alias(f"dropped_{n}") for n in checks])
    return counted.where("_dropped IS NULL").drop("_dropped"), seen


def write_gated(df: DataFrame, path: str, metrics: dict[str, Column], gates: list[Gate], seen: list[Observation] = ()) -> dict[str, int]:
    """Write ``df`` as Parquet and give the counts that were observed on the way, with those of ``seen`` (as of admitted); GateFailed if a gate doesn't hold.

    The rows go to a folder beside ``path`` first and take its place only if all gates hold; what fails stays at path + '.failed' to be looked at, and
    whatever was at ``path`` before is untouched. Each gate is tried, so that all that fail are named.
    """
    spark, own = df.sparkSession, Observation()
    held = f"{path}.failed"
    observed = df.observe(own, *[c.alias(n) for n, c in metrics.items()]) if metrics else df
    observed.write.mode("overwrite").parquet(held)
    counts = {k: int(v or 0) for o in [*([own] if metrics else []), *seen] for k, v in o.get.items()}
    if failed := [g.name for g in gates if not g.holds(counts)]:
        raise GateFailed(path, failed, counts)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(jvm(path), True)
    if not fs.rename(jvm(held), jvm(path)):
        raise OSError(f"{held} can't be moved to {path}")
    return counts
