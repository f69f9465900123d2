"""Tracing under the stop policy and topological levels, against brute force on random graphs."""

import random

from tidewright.operators import graph

EDGES = "caller string, callee string, confidence string, system boolean, boundary boolean, test boolean, entry boolean"
COST, DECAY = {"high": 1, "medium": 2}, {"high": 0.95, "medium": 0.8}


def brute(edges, seeds, max_cost, max_edges=64):
    """The policy path by path, level by level."""
    into = {}
    for caller, callee, conf, system, boundary, test, entry in set(edges):
        if not test:
            into.setdefault(callee, []).append((caller, conf, system, boundary, entry))
    many = sum(map(len, into.values()))
    out = set()
    for seed, exact in seeds.items():
        seen = {seed: [(0, 1.0)]}
        now = [((seed,), 0, 1.0, None, True)]
        for _ in range(max_edges):
            grown, after = [], []
            for path, cost, score, last, high in now:
                found = [(path + (c,), cost + COST.get(conf, 5), score * DECAY.get(conf, 0.5), conf, high and conf == "high", (system, boundary, entry)) for c, conf, system, boundary, entry in into.get(path[-1], []) if c not in path]
                if not found:
                    out.add((seed, path, cost, round(score, 6), last, "NO_CALLER"))
                grown += found
            came = {}
            for path, cost, score, conf, high, (system, boundary, entry) in sorted(grown, key=lambda g: (g[1], -g[2], g[0])):
                node = path[-1]
                if any(c <= cost and s >= score for c, s in seen.get(node, []) + came.get(node, [])):
                    continue
                came.setdefault(node, []).append((cost, score))
                limit = max(max_cost, min(20, many + 1, 3 * max_cost)) if exact and high else max_cost
                stop = "BUSINESS_ENTRY" if entry else "LOW_CONFIDENCE_EDGE" if cost >= limit and conf == "low" else "DEPTH_LIMIT_REACHED" if cost >= limit else "CONFIDENCE_DECAYED" if score < 0.3 else "SYSTEM_CODE_REACHED" if system else "FRAMEWORK_BOUNDARY" if boundary else None
                if stop:
                    out.add((seed, path, cost, round(score, 6), conf, stop))
                else:
                    after.append((path, cost, score, conf, high))
            for node, states in came.items():
                seen.setdefault(node, []).extend(states)
            now = after
            if not now:
                break
        out |= {(seed, path, cost, round(score, 6), conf, "DEPTH_LIMIT_REACHED") for path, cost, score, conf, _ in now}
    return out


def test_tracing_equals_brute_force(spark):
    rng = random.Random(1)
    for k in range(3):
        names = [f"n{i}" for i in range(14)]
        # One edge for a pair, so that equal paths don't differ in what the edge says.
        pairs = {(rng.choice(names), rng.choice(names)) for _ in range(45)}
        edges = [(a, b, rng.choice(["high", "high", "medium", "low"]), rng.random() < 0.05, rng.random() < 0.05, rng.random() < 0.1, rng.random() < 0.05) for a, b in sorted(pairs)]
        seeds = {n: rng.random() < 0.5 for n in names[:4]}
        df = spark.createDataFrame(edges, EDGES)
        got = graph.traced(df, spark.createDataFrame(list(seeds.items()), "seed string, exact boolean"), 4)
        assert {(r.seed, tuple(r.path), r.cost, r.confidence, r["last"], r.stop) for r in got.collect()} == brute(edges, seeds, 4)


def test_a_node_is_not_followed_again_from_a_worse_state(spark):
    high = lambda a, b: (a, b, "high", False, False, False, False)
    edges = [high("b", "a"), high("c", "b"), high("c", "a"), high("d", "c"), high("e", "d")]
    got = graph.traced(spark.createDataFrame(edges, EDGES), spark.createDataFrame([("a",)], "seed string"), 9)
    assert [(r.path, r.stop) for r in got.collect()] == [(["a", "c", "d", "e"], "NO_CALLER")]  # the way by b comes to c later and costs more


def test_states_are_kept_only_where_walks_of_different_lengths_meet(spark, monkeypatch):
    kept = []
    keep = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (df.columns == ["seed", "at", "cost", "score"] and kept.append(1), keep(df))[1])
    high = lambda a, b: (a, b, "high", False, False, False, False)
    edges = [high("b", "a"), high("c", "b"), high("b2", "a"), high("c", "b2"), high("d", "c")]
    for more, least in (([], 1), ([high("c", "a")], 2)):
        kept.clear()
        got = graph.traced(spark.createDataFrame(edges + more, EDGES), spark.createDataFrame([("a",)], "seed string"), 9)
        assert {(r.seed, tuple(r.path), r.cost, r.confidence, r["last"], r.stop) for r in got.collect()} == brute(edges + more, {"a": False}, 9)
        assert len(kept) == 1 if least == 1 else len(kept) > 1


def test_topological_levels_equal_brute_force(spark):
    rng = random.Random(2)
    for k in range(3):
        n = 40
        edges = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(50)) if a < b or k and rng.random() < 0.1}
        edges |= {(i, i + 1) for i in range(5, 15)} | {(99, 3), (3, 99)}
        level = {}
        while fixed := [v for v in range(n) if v not in level and all(a in level for a, b in edges if b == v and a < n)]:
            level |= {v: max([level[a] + 1 for a, b in edges if b == v and a < n], default=0) for v in fixed}
        got = graph.topological(spark.createDataFrame([(v,) for v in range(n)] * 2, "node int"), spark.createDataFrame(sorted(edges) * 2, "before int, after int"))
        assert {r.node: r.level for r in got.collect()} == {v: level.get(v) for v in range(n)} and got.count() == n


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "cut", lambda df, f=graph.cut: rounds.append(1) or f(df))
    nodes = spark.range(10_000).withColumnRenamed("id", "node")
    edges = nodes.selectExpr("node AS before", "node + 1 AS after").unionByName(spark.range(20_000, 20_003).selectExpr("id AS before", "20000 + (id - 19999) % 3 AS after"))
    got = graph.topological(nodes.unionByName(spark.range(20_000, 20_003).withColumnRenamed("id", "node")), edges)
    assert got.where("node < 20000 AND level = node").count() == 10_000 and got.where("level IS NULL").count() == 3
    assert len(rounds) < 40


def test_topological_of_empty_tables(spark):
    none = spark.createDataFrame([], "before int, after int")
    assert graph.topological(none.selectExpr("before AS node"), none).count() == 0
    assert [tuple(r) for r in graph.topological(spark.createDataFrame([(4,)], "node int"), none).collect()] == [(4, 0)]


def test_paths_are_held_without_their_ends_and_edges_of_a_level_are_dealt_once(spark, monkeypatch):
    written = []
    keep = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (out := keep(df), written.append((df.columns, out.count())))[0])
    high = lambda a, b: (a, b, "high", False, False, False, False)
    edges = [high("b", "a"), high("b2", "a"), high("c", "b"), high("c", "b2"), high("d", "c"), high("e", "d")]
    got = graph.traced(spark.createDataFrame(edges, EDGES), spark.createDataFrame([("a",), ("lone",)], "seed string"), 9)
    assert {(r.seed, tuple(r.path), r.cost, r.confidence, r["last"], r.stop) for r in got.collect()} == brute(edges, {"a": False, "lone": False}, 9)
    assert all("path" not in names for names, _ in written) and [n for names, n in written if "_here" in names] == [6, 4, 2, 1, 0]
