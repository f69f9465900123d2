"""Stored results: a query index with a checked version, tables of work keyed by content, rule packs with checked rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

INDEX_VERSION = 1
RULE_FIELDS = ("id", "pattern", "risk")


def write_index(edges: DataFrame, methods: DataFrame, targets: DataFrame, path: str) -> None:
    """Edges by callee, methods and targets as Parquet, and last of all the version, so that a cut-off write isn't taken for an index."""
    edges.repartition("callee").sortWithinPartitions("callee").write.mode("overwrite").parquet(f"{path}/edges")
    methods.write.mode("overwrite").parquet(f"{path}/methods")
    targets.write.mode("overwrite").parquet(f"{path}/targets")
    edges.sparkSession.createDataFrame([(INDEX_VERSION,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``edges, methods, targets`` of an index; ValueError for one of another version."""
    found = [r["version"] for r in spark.read.parquet(f"{path}/version").collect()]
    if found != [INDEX_VERSION]:
        raise ValueError(f"{path}: index version {found}, expected {INDEX_VERSION}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("edges", "methods", "targets")}


def through_cache(inputs: DataFrame, path: str, parser: str, work: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Results of ``work`` for all of ``inputs`` (sha256, content): computed for contents that the cache lacks for this ``parser`` version, read for the others.

    ``work`` returns rows with sha256 and the columns of ``schema``. A content counts as done once its rows, which may be none, are written.
    """
    spark = inputs.sparkSession
    spark.createDataFrame([], "sha256 string").write.mode("append").parquet(f"{path}/done/parser={parser}")
    done = spark.read.schema("sha256 string").parquet(f"{path}/done/parser={parser}")
    todo = inputs.dropDuplicates(["sha256"]).join(done, "sha256", "left_anti")
    keys = [r["sha256"] for r in todo.select("sha256").limit(1).collect()]
    if keys:
        work(todo).write.mode("append").parquet(f"{path}/rows/parser={parser}")
        inputs.select("sha256").distinct().join(done, "sha256", "left_anti").write.mode("append").parquet(f"{path}/done/parser={parser}")
    rows = spark.read.schema(f"sha256 string, {schema}").option("ignoreMissingFiles", True).parquet(f"{path}/rows/parser={parser}") if keys or _exists(spark, f"{path}/rows/parser={parser}") else spark.createDataFrame([], f"sha256 string, {schema}")
    return rows.join(inputs.select("sha256").distinct(), "sha256", "left_semi").distinct()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def rule_pack(spark: SparkSession, text: str) -> DataFrame:
    """The rules of a pack (JSON: id, version, rules) with the pack's id, version and digest; ValueError says what is wrong with it."""
    pack = json.loads(text)
    rules = pack.get("rules")
    if not isinstance(pack.get("id"), str) or not isinstance(rules, list) or not rules:
        raise ValueError("a rule pack has an id and rules")
    for r in rules:
        if lacking := [f for f in RULE_FIELDS if not str(r.get(f) or "").strip()]:
            raise ValueError(f"rule {r.get('id')}: {', '.join(lacking)} missing")
    names = [r["id"] for r in rules]
    if len(set(names)) < len(names):
        raise ValueError("rule ids repeat: " + ", ".join(sorted({n for n in names if names.count(n) > 1})))
    sha = hashlib.sha256(text.encode()).hexdigest()
    rows = [(pack["id"], str(pack.get("version", "")), sha, r["id"], r["pattern"], r["risk"], r.get("since"), r.get("until")) for r in rules]
    return spark.createDataFrame(rows, "pack string, version string, sha256 string, rule string, pattern string, risk string, since int, until int")


def materialised(wanted: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A manifest ``coord, side, sha256, archive, entry`` of the archives that changed dependencies need, and those (coord, side, sha256) no archive holds.

    ``wanted``: coord, side, sha256; ``entries``: archive, entry, sha256. Contents stay where they are; of several places the first by name is listed.
    """
    place = entries.groupBy("sha256").agg(F.min(F.struct("archive", "entry")).alias("p"))
    met = wanted.select("coord", "side", "sha256").distinct().join(place, "sha256", "left")
    return met.where("p IS NOT NULL").select("coord", "side", "sha256", "p.*"), met.where("p IS NULL").select("coord", "side", "sha256")
