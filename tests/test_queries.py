import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewright.plans import catalog


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def folder(tmp_path):
    """Writes tables, given as columns by name, and gives their folder."""
    def write(**tables):
        for name, columns in tables.items():
            pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


def test_reachability_of_all_parts_equals_brute_force(spark, folder):
    rng = random.Random(6)
    lines = [(rng.randrange(8), rng.randrange(9), rng.choice("NAR")) for _ in range(25)]
    d = folder(
        lineitem={"l_orderkey": [x[0] for x in lines], "l_partkey": [x[1] for x in lines], "l_returnflag": [x[2] for x in lines]},
        orders={"o_orderkey": list(range(8)), "o_custkey": [k % 3 for k in range(8)]},
        customer={"c_custkey": [0, 1, 2], "c_nationkey": [0, 1, 1]}, nation={"n_nationkey": [0, 1], "n_regionkey": [0, 0]}, part={"p_partkey": list(range(9))},
    )
    edges = [(f"O{o}", f"P{p}", {"N": 1, "A": 2, "R": 5}[f]) for o, p, f in lines] + [(f"C{k % 3}", f"O{k}", 1) for k in range(8)]
    edges += [("N0", "C0", 1), ("N1", "C1", 1), ("N1", "C2", 1), ("R0", "N0", 1), ("R0", "N1", 1)]
    depth, cost, paths = {}, {}, set()

    def walk(path, spent):
        seed, node = path[0], path[-1]
        depth[seed, node] = min(depth.get((seed, node), 99), len(path) - 1)
        if spent <= 5:
            cost[seed, node] = min(cost.get((seed, node), 99), spent)
        if 1 < len(path) <= 6:
            paths.add((seed, " <- ".join(path), len(path) - 1))
        for caller, callee, step in edges:
            if callee == node and len(path) <= 5:
                walk([*path, caller], spent + step)

    for k in range(9):
        walk([f"P{k}"], 0)
    run = catalog.queries()
    assert rows(run["reach_depth"](spark, d)) == sorted((*k, v) for k, v in depth.items())
    assert rows(run["reach_cost"](spark, d)) == sorted((*k, v) for k, v in cost.items())
    assert rows(run["reach_paths"](spark, d)) == sorted(paths)


def test_scopes_reach_every_user(spark, folder):
    events = [(k, k % 7, "error" if k % 2 == 0 else "click") for k in range(1, 220)]
    d = folder(events={"event_id": [e[0] for e in events], "user_id": [e[1] for e in events], "event_type": [e[2] for e in events]})
    want = [(u, e, "global") for u in range(7) for e in (100, 200)] + [(u, e, "exact") for e, u, kind in events if kind == "error" and e % 100]
    assert rows(catalog.queries()["diag_scope_join"](spark, d)) == sorted(want)


def test_references_meet_parts_of_every_size(spark, folder):
    lines = [(1, 1), (1, 2), (1, 2), (2, 0), (3, 0), (3, 1)]
    d = folder(part={"p_partkey": [1, 2, 3, 4], "p_size": [5, 10, 50, 1]}, supplier={"s_suppkey": [0, 1, 2]}, lineitem={"l_partkey": [x[0] for x in lines], "l_suppkey": [x[1] for x in lines]})
    assert rows(catalog.queries()["ref_join_exact_candidate"](spark, d)) == [(1, 1, 1), (2, 0, 1), (3, 1, 1)]


def test_pair_ranking_equals_all_pairs(spark, folder):
    rng = random.Random(8)
    s = [(k, rng.randrange(6), rng.randrange(9 if k < 30 else 4000) / 100) for k in rng.sample(range(100), 60)] + [(100, 7, 1.0)]
    d = folder(supplier={"s_suppkey": [x[0] for x in s], "s_nationkey": [x[1] for x in s], "s_acctbal": [x[2] for x in s]})
    best = {}
    for a, n, p in s:
        for b, m, q in s:
            if n == m and a < b:
                pair = (abs(round(p * 100) - round(q * 100)), a, b)
                best[n] = min(best.get(n, pair), pair)
    assert any((a + b) % 2 for _, a, b in best.values())
    assert rows(catalog.queries()["pair_ranking"](spark, d)) == sorted((n, a, b, -gap) for n, (gap, a, b) in best.items())


def test_words_of_calls_end_at_letters_beyond_ascii_as_in_the_sql(spark, folder):
    texts = ["the \u00e9leve \u00e9leve. the reai \u00e9reai.", "p\u00e8re. the re", "ed. x\u00e9ed.", None, "the\u00e9 the a. \u00e9the of"]
    d = folder(documents={"doc_id": list(range(5)), "text": texts})
    assert rows(catalog.queries()["receiver_proof"](spark, d)) == [(0, 1, 0, 1), (1, 1, 0, 1), (2, 2, 2, 1), (4, 1, 0, 1)]
    assert [r.rule for r in catalog.queries()["rule_scan"](spark, d).collect()] == ["internal"]
