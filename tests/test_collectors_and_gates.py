"""Collectors with their coverage, frozen evidence, and gates on what is written."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import collectors, evidence, gates, reports


def registry():
    r = collectors.Registry()

    @r.collector("lines", "1.2", "source", ("call",), "path LIKE '%.txt'")
    def lines(path, text):
        for line in text.splitlines():
            if line == "broken":
                raise KeyError(line)
            a, b = line.split(">")
            yield a, b, "call"

    @r.collector("odd", "0", "bytecode", ("call",))
    def odd(path, text):
        yield "a", "b", "call"
        yield "x", "y", "guess"

    r.add(collectors.Collector("idle", "3", "runtime", ("call",), lambda p, t: iter(()), "path LIKE '%.none'"))
    return r


def test_collectors_have_edges_and_coverage(spark):
    files = spark.createDataFrame([("1.txt", "a>b\nc>d\na>b"), ("2.txt", "e>f\nbroken"), ("3.bin", "?"), ("4.txt", None)], "path string, text string")
    edges, coverage = collectors.collect(registry(), files, ["lines", "odd", "idle", "missing", "lines"])
    got = {(r.collector, r.version, r.phase, r.caller, r.callee, r.kind) for r in edges.collect()}
    # Edges before a failure stay; of one that two collectors have, the earlier phase's row stays.
    assert got == {("odd", "0", "bytecode", "a", "b", "call"), ("lines", "1.2", "source", "c", "d", "call"), ("lines", "1.2", "source", "e", "f", "call")} and edges.count() == 3
    assert sorted(map(tuple, coverage.collect()), key=str) == sorted([
        ("lines", "1.2", "1.txt", "complete", None), ("lines", "1.2", "2.txt", "failed", "COLLECTOR_FAILED: KeyError"), ("lines", "1.2", "4.txt", "complete", None), ("idle", "3", None, "not_applicable", None), ("missing", None, None, "failed", collectors.ABSENT),
        *[("odd", "0", p, "partial", collectors.UNDECLARED) for p in ("1.txt", "2.txt", "3.bin", "4.txt")],
    ], key=str)
    # An absent collector leaves no target complete, so that nothing is said not to be found.
    empty = {s: spark.createDataFrame([], s) for s in (reports_paths(), "target string, stage string, reason string, blocking boolean", "target string, rank int, reason string", "target string")}
    only = collectors.collect(registry(), files, ["lines"])[1]
    for cover, want in ((only, "not_found_in_static_analysis"), (coverage.where("collector IN ('lines', 'missing')"), "not_analyzed")):
        p, f, c, k = empty.values()
        state = reports.decide(p, f, c, collectors.targets_coverage(cover), k, spark.createDataFrame([("1.txt",)], "target string"))
        assert [r.status for r in state.collect()] == [want]


def reports_paths():
    return "target string, path_seq int, scope string, depth int, complete boolean, ambiguous boolean, truncated boolean, activated boolean, semantic boolean, reason string, stop_reason string"


def test_a_collector_is_registered_once_and_in_full():
    r = registry()
    for wrong in (r.of["lines"], collectors.Collector("new", "1", "nowhere", ("call",), print), collectors.Collector("new", "1", "source", (), print)):
        with pytest.raises(ValueError):
            r.add(wrong)


def nested(rng, depth=3):
    kind = rng.randrange(6 if depth else 4)
    if kind < 4:
        return rng.choice(["", "x", "é\n", 0, 1, -7, 2.5, True, None])
    return [nested(rng, depth - 1) for _ in range(rng.randrange(4))] if kind == 4 else {rng.choice("abcdef") * rng.randrange(1, 3): nested(rng, depth - 1) for _ in range(rng.randrange(4))}


def shuffled(rng, value):
    if isinstance(value, dict):
        items = [(k, shuffled(rng, v)) for k, v in value.items()]
        rng.shuffle(items)
        return dict(items)
    return [shuffled(rng, v) for v in value] if isinstance(value, list) else value


def test_frozen_evidence_is_equal_whatever_the_order_of_keys(spark):
    rng = random.Random(1)
    values = [nested(rng) for _ in range(200)]
    rows = [(k, json.dumps(v), json.dumps(shuffled(rng, v), indent=1, ensure_ascii=False)) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k int, a string, b string").select("k", evidence.frozen(F.col("a")).alias("a"), evidence.frozen(F.col("b")).alias("b"))
    got = {r.k: (r.a, r.same, r.id) for r in df.select("k", evidence.canonical(F.col("a")).alias("a"), (evidence.canonical(F.col("a")) == evidence.canonical(F.col("b"))).alias("same"), evidence.evidence_id(F.col("b")).alias("id")).collect()}
    assert all(json.loads(got[k][0]) == v and got[k][1] for k, v in enumerate(values))
    texts = {json.dumps(v, sort_keys=True) for v in values}
    assert len({x[2] for x in got.values()}) == len(texts)
    bad = spark.createDataFrame([("{",), (None,)], "t string").select(evidence.frozen(F.col("t")).alias("v"))
    assert bad.where("v IS NOT NULL").count() == 0


def test_evidence_is_thawed_compared_and_made_of_sets(spark):
    df = spark.createDataFrame([(1, '{"n": 1, "tags": ["b", "a", "b"], "deep": {"x": [1, 2]}}', '{"deep": {"x": [2, 1]}, "tags": ["a", "b"], "m": null}')], "k int, a string, b string")
    schema = "n int, tags array<string>, deep struct<x: array<int>>"
    v = df.select("k", evidence.frozen(F.col("a")).alias("a"), evidence.frozen(F.col("b")).alias("b"))
    assert v.select(evidence.thawed(F.col("a"), schema).alias("t")).first().t.deep.x == [1, 2]
    assert {(r.field, r.a, r.b) for r in evidence.differences(v, "a", "b", ["k"]).collect()} == {("n", "1", None), ("tags", '["b","a","b"]', '["a","b"]'), ("deep", '{"x":[1,2]}', '{"x":[2,1]}'), ("m", None, "null")}
    sets = df.select(*[evidence.canonical(evidence.as_sets(F.col(c), "tags array<string>", ["tags"])).alias(c) for c in "ab"]).first()
    assert sets.a == sets.b == '{"tags":["a","b"]}'


def test_gates_see_counts_while_rows_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("reachable", "a", "s"), ("uncertain", "b", None), ("odd", None, "s"), ("reachable", "c", "s")], "status string, owner string, signature string")
    good, seen = gates.admitted(rows, {"owner": F.col("owner").isNotNull(), "signature": F.col("signature") != ""})
    path = f"{tmp_path}/out"
    counts = gates.write_gated(good, path, gates.verdict_counts("status", ("reachable", "uncertain")), [gates.Gate("no row is of another kind", lambda c: c["other"] == 0)], [seen])
    assert counts == {"rows": 2, "other": 0, "reachable": 2, "uncertain": 0, "kept": 2, "dropped_owner": 1, "dropped_signature": 1}
    assert spark.read.parquet(path).count() == 2
    strict = [gates.Gate("some are uncertain", lambda c: c["uncertain"] > 0), gates.Gate("none is odd", lambda c: c["other"] == 0), gates.Gate("few rows", lambda c: c["rows"] < 9)]
    with pytest.raises(gates.GateFailed, match="none is odd") as e:
        gates.write_gated(rows, path, gates.verdict_counts("status", ("reachable", "uncertain")), strict)
    assert e.value.failed == ["none is odd"] and spark.read.parquet(path).count() == 2 and spark.read.parquet(path + ".failed").count() == 4
    assert gates.write_gated(rows.limit(0), path, {"rows": F.count(F.lit(1)), "most": F.max(F.length("owner"))}, []) == {"rows": 0, "most": 0}
