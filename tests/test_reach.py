"""Reachability on graphs with and without layers, and what it writes on the way."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import graph


def least(edges, seeds, limit):
    out = {(s, s): 0 for s in seeds}
    for _ in range(limit):
        for (s, n), c in list(out.items()):
            for caller, callee, step in edges:
                if callee == n and c + step <= limit:
                    out[s, caller] = min(out.get((s, caller), 99), c + step)
    return out


@pytest.mark.parametrize("few", (0, 50_000))
def test_least_costs_with_and_without_layers(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(3)
    cyclic = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.choice((1, 2, 5))) for _ in range(20)]
    layered = [(f"{'bcd'[k]}{rng.randrange(4)}", f"{'abc'[k]}{rng.randrange(4)}", rng.choice((1, 1, 2))) for k in range(3) for _ in range(9)]
    for edges, seeds in ((cyclic, ["n0", "n1"]), (layered, ["a0", "a1", "a2"])):
        got = graph.least_costs(spark.createDataFrame(edges, "caller string, callee string, cost int"), spark.createDataFrame([(s,) for s in seeds], "seed string"), 5, "cost")
        assert {(r.seed, r.node): r.cost for r in got.collect()} == least(edges, seeds, 5) and got.count() == len(least(edges, seeds, 5))


def chains(spark, n=40, top=4):
    edges = [(f"{'bcd'[k]}{i}", f"{'abc'[k]}{i}") for i in range(n) for k in range(3)] + [("top", f"d{i}") for i in range(n)]
    return spark.createDataFrame(edges, "caller string, callee string"), spark.createDataFrame([(f"a{i}",) for i in range(n)], "seed string")


def test_what_is_known_is_written_once(spark, monkeypatch):
    written = []
    keep = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (out := keep(df), "seed" in df.columns and written.append(out.count()))[0])
    assert graph.least_costs(*chains(spark), 5).count() == 200
    assert sum(written) == 200


def test_paths_to_few_nodes_are_not_dealt_by_node(spark, monkeypatch):
    plans = []
    keep = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(df))[1])
    got = graph.paths(*chains(spark), 5)
    assert got.groupBy(F.size("path").alias("n")).count().orderBy("n").collect() == [(k, 40) for k in (2, 3, 4, 5)]
    last = [p for p in plans if "Join Inner" in p]
    assert last and all("strategy=broadcast" in p for p in last)


@pytest.mark.parametrize("few", (0, 50_000))
def test_edges_are_dealt_to_the_level_they_belong_to(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    n, read = 40, []
    keep = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (out := keep(df), read.append((df.columns, out.count())))[0])
    edges, seeds = chains(spark, n)
    for run in (lambda: graph.least_costs(edges, seeds, 5), lambda: graph.paths(edges, seeds, 5)):
        read.clear()
        run()
        # 160 edges in four levels: each level takes its own out of what is left, instead of all being dealt again.
        assert [c for names, c in read if "_here" in names] == [160, 120, 80, 40, 0]


def test_levels_are_held_as_compressed_columns(spark):
    df = spark.range(20_000).select(F.concat(F.lit("P"), (F.col("id") % 50).cast("string")).alias("seed"), F.lit("node of a long name").alias("node"))
    out = graph.cut(df)
    files = out.inputFiles()
    assert files and sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in files) < 100_000 and out.count() == 20_000
    graph.forget(out)
    assert not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in files)


def test_a_path_is_written_without_its_seed_beside_it(spark, monkeypatch):
    written = []
    keep = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (written.append(df.columns), keep(df))[1])
    edges, seeds = chains(spark, 3)
    got = graph.paths(edges, seeds, 2)
    assert {(r.seed, tuple(r.path)) for r in got.collect()} == {(f"a{i}", p) for i in range(3) for p in ((f"a{i}", f"b{i}"), (f"a{i}", f"b{i}", f"c{i}"))}
    assert [names for names in written if "path" in names] == [["path"], ["path"]]
