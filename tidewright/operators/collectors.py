"""A registry of collectors: table functions in Python that find edges in files, each with a row that says how complete it was.

A collector is registered by name, version, phase and the kinds of edges it may give. It runs as a table function over partitions of its files by path, so a file is handled as a whole
and a failure concerns that file alone. A collector that is asked for and missing, that fails, or that gives what it didn't declare makes coverage incomplete.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import Row

from ..workers import ship
from .resolve import ingested

FOUND = "target string, caller string, callee string, kind string, failure string"
EDGES = "collector string, version string, phase string, target string, caller string, callee string, kind string"
#: Reasons of rows that aren't edges, and of collectors that didn't run.
FAILED, UNDECLARED, ABSENT = "COLLECTOR_FAILED", "COLLECTOR_KIND_UNDECLARED", "COLLECTOR_ABSENT"
#: The order in which collectors' edges count: of an edge that several have, the first phase's row stays.
PHASES = ("bytecode", "source", "framework", "runtime")


@dataclass(frozen=True)
class Collector:
    """``find`` gives (caller, callee, kind) for a path and its text; ``applies`` is a SQL condition on path."""

    name: str
    version: str
    phase: str
    kinds: tuple[str, ...]
    find: Callable[[str, str], Iterator[tuple[str, str, str]]]
    applies: str = "true"


class Registry:
    """Collectors by name; a name is registered once, and a phase must be one of PHASES."""

    def __init__(self) -> None:
        self.of: dict[str, Collector] = {}

    def add(self, c: Collector) -> Collector:
        if c.name in self.of:
            raise ValueError(f"{c.name} is registered already")
        if c.phase not in PHASES or not c.kinds:
            raise ValueError(f"{c.name}: a phase of {', '.join(PHASES)} and some kinds of edges must be stated")
        self.of[c.name] = c
        return c

    def collector(self, name: str, version: str, phase: str, kinds: tuple[str, ...], applies: str = "true"):
        """Registers a function as a collector."""
        return lambda find: self.add(Collector(name, version, phase, kinds, find, applies))


def _table_function(c: Collector):
    """The collector as a table function, to be given files partitioned by path."""
    find, kinds = c.find, frozenset(c.kinds)

    class Find:
        def eval(self, row: Row):
            path, text = row["path"], row["text"] or ""
            try:
                for caller, callee, kind in find(path, text):
                    yield (path, caller, callee, kind, None) if kind in kinds else (path, caller, callee, kind, UNDECLARED)
            except Exception as e:  # a collector's fault is a finding, not the job's end
                yield path, None, None, None, f"{FAILED}: {type(e).__name__}"

    return F.udtf(Find, returnType=FOUND)


def collect(registry: Registry, files: DataFrame, asked: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges of the asked collectors (EDGES) and their coverage ``collector, version, target, status, reason``.

    ``files``: path, text. Of edges with equal caller, callee and kind the earliest phase's row stays (ties: by collector, version and target). Coverage has a row for each collector and file that
    it applies to: complete, partial (it gave edges of kinds it didn't declare, which are dropped) or failed; a collector that isn't registered, or that applies to no file, has one row
    with a null target, failed or not_applicable.
    """
    spark = files.sparkSession
    ship(spark)
    parts, rows = [], []
    for name in dict.fromkeys(asked):
        c = registry.of.get(name)
        if c is None:
            rows.append(spark.createDataFrame([(name, None, None, "failed", ABSENT)], "collector string, version string, target string, status string, reason string"))
            continue
        mine = files.select("path", "text").where(c.applies)
        found = _table_function(c)(mine.asTable().partitionBy("path"))
        parts.append((c, found))
        whole = found.groupBy("target").agg(F.min("failure").alias("reason"), F.bool_or(F.startswith("failure", F.lit(FAILED))).alias("_failed"))
        state = mine.select(F.col("path").alias("target")).distinct().join(whole, "target", "left")
        status = F.when(F.col("_failed"), "failed").when(F.col("reason").isNotNull(), "partial").otherwise("complete")
        each = state.select(F.lit(c.name).alias("collector"), F.lit(c.version).alias("version"), "target", status.alias("status"), "reason")
        none = mine.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(c.name).alias("collector"), F.lit(c.version).alias("version"), F.lit(None).cast("string").alias("target"), F.lit("not_applicable").alias("status"), F.lit(None).cast("string").alias("reason"))
        rows.append(each.unionByName(none))
    if not rows:
        raise ValueError("no collector is asked for")
    return _edges(spark, parts), reduce(DataFrame.unionByName, rows)


def _edges(spark: SparkSession, parts: list[tuple[Collector, DataFrame]]) -> DataFrame:
    named = [(c, f.where("failure IS NULL").select(F.lit(c.name).alias("collector"), F.lit(c.version).alias("version"), "target", "caller", "callee", "kind").distinct()) for c, f in parts]
    phases = [(p, reduce(DataFrame.unionByName, of)) for p in PHASES if (of := [f for c, f in named if c.phase == p])]
    if not phases:
        return spark.createDataFrame([], EDGES)
    first = ingested(phases, ["caller", "callee", "kind"])
    names = F.array(*[F.lit(p) for p, _ in phases])
    return first.select("collector", "version", F.get(names, F.col("phase")).alias("phase"), "target", "caller", "callee", "kind")


def targets_coverage(coverage: DataFrame) -> DataFrame:
    """``target, status`` as reports.decide takes it, a row for each collector and target; with an absent collector every target has a failed row more."""
    each = coverage.where("target IS NOT NULL").select("target", "status")
    absent = [F.lit("failed")] * coverage.where(f"target IS NULL AND reason = '{ABSENT}'").count()  # as many as were asked for
    return each.unionByName(each.select("target").distinct().select("target", F.explode(F.array(*absent)).alias("status"))) if absent else each
