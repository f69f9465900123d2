"""Scope queries, diagnostics by scope and references by all kinds of keys, against brute force."""

import random

from tidewright.operators import scope

EDGES, METHODS = "caller string, callee string, test boolean", "symbol string, owner_type string, test boolean"


def test_scope_queries(spark):
    df = spark.createDataFrame
    targets = df([("p.A.f(int)", "g:a"), ("p.A.g()", "g:a"), ("p.q.B.h()", "g:b"), ("px.C.i()", "h:b")], "api string, coord string")
    queries = df([("g:a", "coord"), ("b", "coord"), ("zz", "coord"), ("p.*", "package"), ("p.q", "package"), ("", "package"), ("p", "package")], "query string, kind string")
    got = {}
    for r in scope.scope_targets(queries, targets).collect():
        got.setdefault((r.query, r["mode"]), set()).add(r.api)
    assert got == {
        ("g:a", "coord_exact"): {"p.A.f(int)", "p.A.g()"}, ("b", "coord_ambiguous"): {None}, ("zz", "coord_not_found"): {None}, ("p.*", "package_prefix"): {"p.A.f(int)", "p.A.g()", "p.q.B.h()"},
        ("p.q", "package_prefix"): {"p.q.B.h()"}, ("", "package_not_found"): {None}, ("p", "package_prefix"): {"p.A.f(int)", "p.A.g()", "p.q.B.h()"},
    }
    edges = df([("l.X.x()", "p.A.f(int)", False), ("b.Y.y()", "l.X.x()", False), ("b.Z.z()", "b.Y.y()", False), ("b.T.t()", "p.A.f(int)", True), ("b.W.w", "p.A.g()", False), ("b.W.w()", "p.A.g()", False), ("b.V.v()", "p.A.g()", False), ("p.A.g()", "b.V.v()", False), ("b.M.m()", "p.q.B.h()", False)], EDGES)
    methods = df([("l.X.x()", "dependency", False), ("b.Y.y()", "business", False), ("b.Z.z()", "business", False), ("b.T.t()", "business", False), ("b.W.w", "business", False), ("b.W.w()", "business", False), ("b.V.v()", "business", False), ("p.A.g()", "dependency", False), ("b.M.m()", "business", True)], METHODS)
    chains, said = scope.scope_chains(queries, targets, edges, methods)
    want = ["b.V.v() → p.A.g()", "b.W.w() → p.A.g()", "b.Z.z() → b.Y.y() → l.X.x() → p.A.f(int)"]  # the longest, and the precise one of two that may be the same
    assert {q: [r.chain for r in sorted(chains.collect(), key=lambda r: r.rank) if r.query == q] for q in ("g:a", "p.*", "b", "p.q")} == {"g:a": want, "p.*": want, "b": [], "p.q": []}
    assert {(r.query, r["mode"], r.apis, r.chains, r.limited) for r in said.collect()} >= {("g:a", "coord_exact", 2, 3, False), ("b", "coord_ambiguous", 0, 0, False), ("p.q", "package_prefix", 1, 0, False)}
    few, said = scope.scope_chains(queries.where("query = 'g:a'"), targets, edges, methods, depth=2, limit=1)
    assert [tuple(r) for r in few.collect()] == [("g:a", 1, want[0])] and [tuple(r) for r in said.collect()] == [("g:a", "coord_exact", 2, 1, True)]
    assert scope.scope_chains(queries.where("query = 'g:a'"), targets, edges, methods, visits=1)[1].first().limited


def test_diagnostics_by_scope(spark, monkeypatch):
    d = [(1, "global", None, None, None), (2, "api", "p.A.f", "(int)", None), (3, "api", "p.A.f", "(q.S)", None), (4, "api", "p.A.f", None, None), (5, "path", None, None, "m/x"), (6, "api", "none", "()", None), (7, "global", "p.A.f", "(int)", "m/x"), (2, "api", "p.A.f", "(int)", None)]
    a = [(10, "p.A.f", "(int)", "m/x"), (11, "p.A.f", "(S)", "m/y"), (12, "p.A.f", "(r.S)", None), (13, "p.B.g", "()", "m/x"), (14, "p.A.f", None, None)]
    want = {(g, i, "global") for g in (1, 7) for i in range(10, 15)} | {(2, 10, "exact"), (2, 14, "signature"), (3, 11, "signature"), (3, 14, "signature"), (4, 14, "exact"), (5, 10, "path"), (5, 13, "path")} | {(4, i, "signature") for i in (10, 11, 12)}
    frames = spark.createDataFrame(d, "diagnostic_id int, scope string, name string, params string, path string"), spark.createDataFrame(a, "api_id int, name string, params string, path string")
    for rows in (10_000, 1):  # broadcast, block by block
        monkeypatch.setattr(scope, "GLOBAL_ROWS", rows)
        got = scope.diagnostics_of(*frames).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_diagnostics_are_counted_as_their_pairs_are(spark):
    rng = random.Random(3)
    params = ["(S)", "(q.S)", "(int)", None]
    for most in (9, 40):
        d = [(rng.randrange(most), rng.choice(["api", "api", "path", "path", "global"][: rng.choice((4, 5))]), rng.choice("fgh"), rng.choice(params), rng.choice(["x", "y", None])) for _ in range(40)]
        a = [(rng.randrange(most), rng.choice("fg"), rng.choice(params), rng.choice(["x", "y", None])) for _ in range(30)]
        frames = spark.createDataFrame(d, "diagnostic_id int, scope string, name string, params string, path string"), spark.createDataFrame(a, "api_id int, name string, params string, path string")
        want = {}
        for r in scope.diagnostics_of(*frames).collect():
            want.setdefault(r.api_id, {"exact": 0, "signature": 0, "path": 0, "global": 0})[r.scope] += 1
        assert {r.api_id: {k: v for k, v in r.asDict().items() if k != "api_id"} for r in scope.diagnostic_counts(*frames).collect()} == want
    assert "diagnostic_id" not in scope.diagnostic_counts(*frames).columns


def test_references_by_all_kinds_of_keys(spark):
    rng = random.Random(1)
    pick = lambda n, kinds: [(k, rng.choice(kinds), rng.choice("AB"), rng.choice("fg"), rng.choice(["(int)", "()", "", None])) for k in range(n)]
    apis, refs = pick(40, ["class", "field", "method", "constructor"]), pick(60, ["field", "method", "constructor", "type"])
    want = set()
    for i, kind, owner, member, params in apis:
        for j, k, o, m, p in refs:
            same = (owner, member) == (o, m)
            exact = kind == "class" and owner == o or kind == "field" and k == "field" and same or kind == k and kind in ("method", "constructor") and same and params and params == p
            if exact or kind == k and kind in ("method", "constructor") and same and (not params or not p):
                want.add((i, j, "exact" if exact else "candidate"))
    a, r = (spark.createDataFrame(x, f"{n} int, kind string, owner string, member string, params string") for x, n in ((apis, "api_id"), (refs, "reference_id")))
    found = scope.changed_references(a, r)
    got = found.collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    counts = {x.owner: x for x in scope.reference_counts(a, found, ["owner"]).collect()}
    for owner in "AB":
        mine = {i for i, _, o, *_ in apis if o == owner}
        exact, weak = ({i for i, _, q in want if q == s and i in mine} for s in ("exact", "candidate"))
        c = counts[owner]
        assert (c.apis, c.apis_exact, c.apis_candidate, c.apis_unreferenced) == (len(mine), len(exact), len(weak - exact), len(mine - exact - weak))
        assert (c.occurrences_exact, c.occurrences_candidate) == tuple(sum(1 for i, _, q in want if q == s and i in mine) for s in ("exact", "candidate"))
