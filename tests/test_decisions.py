"""Decisions on targets against a table of rules worked through one by one, and what must fail."""

import random

import pytest

from tidewright.operators import reports, resolve, rules

PATHS = "target int, path_seq int, scope string, depth int, complete boolean, ambiguous boolean, truncated boolean, activated boolean, semantic boolean, reason string, stop_reason string"


def brute(paths, failures, concerns, coverage, preserved):
    """The rules in their order for one target."""
    paths = sorted(paths, key=lambda p: p["path_seq"])
    for p in paths:
        p["active"] = p["activated"] and (p["semantic"] or p["stop_reason"] not in reports.ENTRY_CLAIMS)
        p["clear"] = p["scope"] == "business" and not p["ambiguous"] and not p["truncated"]
    blocking = sorted(((0 if s == "input-validation" else 2 if s == "coverage" else 1, s, r) for s, r, b in failures if b))
    applicable = [s for s in coverage if s != "not_applicable"]
    if any(s != "complete" for s in applicable) and not paths and not concerns and preserved is None:
        blocking.append((2, "coverage", "INCOMPLETE_EVIDENCE_COVERAGE"))
    sound = [p for p in paths if p["clear"] and p["complete"] and p["active"]]
    physical = [p for p in paths if p["scope"] in ("internal", "external")]
    own = lambda some, usual: next((p["reason"] for p in some if p["reason"]), usual)
    if blocking and blocking[0][0] == 0:
        return "not_analyzed", blocking[0][2]
    if preserved is not None:
        return "not_impacted", preserved or "API_PRESERVED"
    if sound:
        framework = any(p["stop_reason"] == "RUNTIME_FRAMEWORK_ENTRY_REACHED" for p in sound)
        return "reachable", own(sound, "RUNTIME_FRAMEWORK_ENTRY_REACHED" if framework else "BUSINESS_ARTIFACT_BYTECODE_USAGE")
    if blocking and not any(p["clear"] and p["complete"] and p["semantic"] for p in paths):
        return "not_analyzed", blocking[0][2]
    if concerns:
        return "uncertain", min(concerns)[1]
    if any(not p["active"] for p in paths):
        return "uncertain", "FRAMEWORK_ACTIVATION_UNPROVEN"
    if any(p["ambiguous"] for p in paths):
        return "uncertain", "UNQUALIFIED_SIGNATURE_TYPE_AMBIGUOUS"
    if cut := [p for p in paths if p["truncated"]]:
        return "not_analyzed", cut[0]["stop_reason"] or "EVIDENCE_PATH_TRUNCATED"
    if physical:
        return "uncertain", own(physical, "PACKAGED_DEPENDENCY_BYTECODE_USAGE")
    if blocking:
        return "not_analyzed", blocking[0][2]
    if applicable and all(s == "complete" for s in applicable):
        return "not_found_in_static_analysis", "NO_STATIC_PATH"
    return "not_analyzed", "INCOMPLETE_EVIDENCE"


def test_decisions_equal_the_rules(spark):
    rng, n = random.Random(1), 3000
    paths, failures, concerns, coverage, preserved, want = [], [], [], [], [], {}
    flag = lambda p: rng.random() < p
    for t in range(n):
        own = [dict(path_seq=k, scope=rng.choice(["business", "business", "internal", "external", "unknown"]), depth=rng.randrange(4), complete=flag(0.7), ambiguous=flag(0.2), truncated=flag(0.2), activated=flag(0.7), semantic=flag(0.5), reason=rng.choice([None, "", "OWN1", "OWN2"]), stop_reason=rng.choice([None, "STOPPED", *reports.ENTRY_CLAIMS])) for k in range(rng.choice([0, 0, 1, 2]))]
        f = [(rng.choice(["input-validation", "coverage", "scan", "parse"]), rng.choice("AB"), flag(0.6)) for _ in range(rng.choice([0, 0, 1, 2]))]
        c = [(rng.randrange(3), rng.choice("XY")) for _ in range(rng.choice([0, 0, 0, 1, 2]))]
        v = [rng.choice(["complete", "complete", "partial", "failed", "not_applicable"]) for _ in range(rng.choice([0, 1, 2]))]
        k = rng.choice([None] * 6 + ["", "KEPT_ABSTRACT"])
        paths += [(t, p["path_seq"], p["scope"], p["depth"], p["complete"], p["ambiguous"], p["truncated"], p["activated"], p["semantic"], p["reason"], p["stop_reason"]) for p in own]
        failures += [(t, *x) for x in f]
        concerns += [(t, *x) for x in c]
        coverage += [(t, x) for x in v]
        preserved += [(t, k or None)] if k is not None else []
        reach = [max(p["depth"], 1) for p in own if p["scope"] == "business" and not p["ambiguous"] and not p["truncated"]]
        want[t] = (*brute(own, f, c, v, k), reach.count(1), min(reach, default=0))
    df = spark.createDataFrame
    got = reports.decide(df(paths, PATHS), df(failures, "target int, stage string, reason string, blocking boolean"), df(concerns, "target int, rank int, reason string"), df(coverage, "target int, status string"), df(preserved, "target int, reason string"), df([(t,) for t in range(n)] * 2, "target int"))
    assert {r.target: tuple(r)[1:] for r in got.collect()} == want
    assert len({w[:2] for w in want.values()}) > 20


def test_selectors_that_choose_nothing_fail(spark):
    df = spark.createDataFrame([("g:a", "one"), ("g:b", None)], "coord string, name string")
    with pytest.raises(ValueError, match="coord g:x, name two"):
        rules.select_scope(df, "coord", "name", ["g:a", "G:X"], ["two"])
    assert rules.select_scope(df, "coord", "name", ["g:a"], [])[0].count() == 1


def test_alignment_has_one_answer_for_each_source(spark):
    schema = "coord string, version string, sha256 string"
    catalog = spark.createDataFrame([("a", "1", "x"), ("a", "1", "x"), ("b", "1", "x"), ("b", "2", "x"), ("c", "1", "x"), ("c", "1", None)], schema)
    got = resolve.source_alignment(spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("c", "1", "x"), ("d", "1", "x")], schema), catalog)
    assert sorted(map(tuple, got.collect())) == [("a", "aligned"), ("b", "ambiguous"), ("c", "ambiguous"), ("d", "not_packaged")]
