import random

from pyspark.sql import functions as F

from tidewright.functions import text
from tidewright.operators import core, graph


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_snapshot_diff_pairs_exactly_then_by_artifact(spark):
    cols = "key string, artifact string, v string"
    base = spark.createDataFrame([("g:a", "a", "1"), ("g:a", "a", "2"), ("g:b", "b", "1"), ("g:d", "d", "1"), ("", "e", "1")], cols)
    cur = spark.createDataFrame([("g:a", "a", "2"), ("h:b", "b", "2"), ("h:d", "d", "1"), ("i:d", "d", "2"), ("g:n", "n", "1")], cols)
    got = core.snapshot_diff(base, cur, "key", "artifact", ["v"])
    assert rows(got.groupBy("pairing_status").count()) == [("base_only", 2), ("current_only", 1), ("exact_coord", 1), ("unique_artifact_migration", 1), ("unpaired_ambiguous", 3)]


def test_best_row_merge_fills_blanks_from_later_rows(spark):
    df = spark.createDataFrame([(1, 1, 1, "a", "x"), (1, 2, 0, "", "y"), (1, 3, 1, "c", ""), (2, 1, 0, None, "z"), (3, 1, 1, "early", "e"), (3, 2, 0, None, ""), (3, 3, 1, "late", None)], "k int, seq int, rank int, p string, q string")
    assert rows(core.best_row_merge(df, ["k"], ["rank"], "seq", ["p", "q"])) == [(1, 2, "c", "y"), (2, 1, None, "z"), (3, 2, "early", "")]


def test_reconcile_counts_repeats_once_each(spark):
    cols = "a string, b string, kind string, sound boolean, here boolean"
    a = spark.createDataFrame([("m", "n", "x", True, True)] * 2 + [("o", "p", "x", True, True), ("s", "t", "x", True, True), ("u", "v", "x", False, True), ("w", "w", "x", True, False)], cols)
    o = spark.createDataFrame([("m", "n", "x", True, True), ("o", "p", "y", True, True), ("q", "r", "x", True, True), ("s", "t", "x", True, False), ("u", "v", "x", None, True)], cols)
    got = core.reconcile(a, o, ["a", "b", "kind"], ["a", "b"], F.col("sound"), F.col("here"))
    assert rows(got.select("a", "verdict", "n")) == [("m", "analyzer_only", 1), ("m", "matched", 1), ("o", "variant", 1), ("q", "oracle_only", 1), ("s", "oracle_conflict", 2), ("u", "provenance_invalid", 2), ("w", "analyzer_only", 1)]


def test_global_rank_equals_a_sort(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 101).alias("x"), "id").repartition(5)
    got = core.global_rank(df, [F.desc("x"), "id"])
    want = sorted(((k * 7919 % 101, k) for k in range(1000)), key=lambda r: (-r[0], r[1]))
    assert [(r.x, r.id) for r in got.orderBy("rank").collect()] == want and got.agg(F.max("rank")).first()[0] == 1000
    assert core.global_rank(df.limit(0), ["id"]).count() == 0


def test_costs_decay_and_limits(spark):
    c = spark.createDataFrame([("high",), ("medium",), ("low",), ("other",)], "c string")
    assert [tuple(r) for r in c.select(graph.edge_cost(F.col("c")), graph.decay(F.col("c"))).collect()] == [(1, 0.95), (2, 0.8), (5, 0.5), (5, 0.5)]
    assert [graph.adaptive_limit(5, 12, True, True), graph.adaptive_limit(5, 12, False, True), graph.adaptive_limit(5, 12, True, False)] == [13, 5, 5]


def test_reachability_survives_cycles(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c")], "caller string, callee string")
    s = spark.createDataFrame([("a",)], "seed string")
    assert rows(graph.least_costs(e, s, 10)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    assert sorted("".join(r.path) for r in graph.paths(e, s, 10).collect()) == ["ab", "abc", "abcd"]


def test_tracing_stops_for_the_first_reason(spark):
    cols = "callee string, caller string, confidence string, system boolean, boundary boolean, test boolean, entry boolean"
    edge = lambda a, b, c="high", system=False, boundary=False, test=False, entry=False: (a, b, c, system, boundary, test, entry)
    e = spark.createDataFrame([
        edge("t", "a"), edge("a", "main", entry=True), edge("a", "junit", test=True), edge("t", "jdk", system=True), edge("t", "spring", boundary=True), edge("t", "weak", "low"),
        edge("t", "f1", "medium"), edge("f1", "f2", "low"), edge("f2", "f3", "high"), edge("t", "c"), edge("c", "t"), edge("c", "d"), edge("d", "c"), edge("u", "w1", "low"), edge("w1", "w2", "low"),
    ], cols)
    got = {(r.seed, ">".join(r.path)): (r.stop, r.cost) for r in graph.traced(e, spark.createDataFrame([("t",), ("u",), ("lone",)], "seed string"), 10).collect()}
    assert got == {
        ("t", "t>a>main"): ("BUSINESS_ENTRY", 2), ("t", "t>jdk"): ("SYSTEM_CODE_REACHED", 1), ("t", "t>spring"): ("FRAMEWORK_BOUNDARY", 1), ("t", "t>weak"): ("NO_CALLER", 5), ("t", "t>f1>f2>f3"): ("NO_CALLER", 8),
        ("t", "t>c>d"): ("NO_CALLER", 2), ("u", "u>w1>w2"): ("LOW_CONFIDENCE_EDGE", 10), ("lone", "lone"): ("NO_CALLER", 0),
    }
    short = {">".join(r.path): r.stop for r in graph.traced(e, spark.createDataFrame([("t",)], "seed string"), 5).collect()}
    assert short["t>weak"] == "LOW_CONFIDENCE_EDGE" and short["t>f1>f2"] == "LOW_CONFIDENCE_EDGE" and short["t>a>main"] == "BUSINESS_ENTRY"


def test_topological_levels_and_cycles(spark):
    n = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "a")], "before string, after string")
    assert rows(graph.topological(n, e)) == [("a", 0), ("b", 1), ("c", 2), ("d", None), ("e", None), ("f", None)]


def test_frontier_and_suffixes(spark):
    p = spark.createDataFrame([("s", 1, 5, 1), ("s", 2, 7, 2), ("s", 2, 6, 3), ("s", 3, 7, 4)], "k string, cost int, gain int, seq int")
    assert [r.seq for r in graph.pareto(p, ["k"], "cost", "gain", "seq").orderBy("seq").collect()] == [1, 2]
    c = spark.createDataFrame([("k", ["a", "b", "c"]), ("k", ["b", "c"]), ("k", ["c", "b"]), ("l", ["c"])], "k string, path array<string>")
    assert sorted("".join(r.path) for r in graph.longest_only(c, "k", "path").collect()) == ["abc", "c", "cb"]
    r = spark.createDataFrame([("k", list("abc"), 1), ("k", list("bc"), 0), ("k", list("xyz"), 0), ("k", list("yz"), 1), ("k", ["z"], 1)], "k string, path array<string>, rank int")
    assert sorted("".join(x.path) for x in graph.longest_only(r, "k", "path", "rank").collect()) == ["abc", "bc", "xyz", "z"]


def test_versions_and_signatures(spark):
    want = {
        ("1.2", "1.2.1"): ("patch", "low"), ("1.0-RC1", "1.0"): ("qualifier", "low"), ("2.0", "1.9"): ("downgrade", "high"), ("-", "1"): ("added", "pending"), ("1", "-"): ("removed", "pending"), ("1.9.9", "2.0"): ("major", "high"), ("1.2", "1.10"): ("minor", "medium"),
        ("1.0.0.0.2", "1.0.0.0.1"): ("downgrade", "medium"), ("v1.2", "1.2"): ("changed", "confirm"), ("abc", "1.0"): ("irregular", "confirm"), ("1.0.0.RELEASE", "1.0.0"): ("changed", "confirm"), ("1.0", "1.0"): ("unchanged", "verify"), ("1.0-jre", "1.0.1-android"): ("patch", "low"),
        ("2.0-beta-2", "2.0-beta-10"): ("qualifier", "low"), ("1.0+a", "1.0+b"): ("changed", "confirm"), ("", "1"): ("irregular", "confirm"),
    }
    v = spark.createDataFrame(list(want), "a string, b string")
    assert {(r[0], r[1]): (r[2], r[3]) for r in v.select("a", "b", text.version_change(F.col("a"), F.col("b")), text.version_risk(F.col("a"), F.col("b"))).collect()} == want
    s = spark.createDataFrame([("java.util.Map<java.lang.String, java.util.List<a.B>>, int...",), ("A<B<C<D<E<F>>>>>[], x.Y",)], "s string")
    assert [r[0] for r in s.select(text.lookup_signature(F.col("s"))).collect()] == ["Map,int[]", "A[],Y"]
    pairs = spark.createDataFrame([("(java.lang.String,int)", "(String, int)", True), ("(a.S)", "(b.S)", False), ("()", "", True), ("(int)", "(int,int)", False), ("(List<String>)", "(List<Integer>)", True)], "a string, b string, w boolean")
    assert all(r.w == r.g for r in pairs.withColumn("g", text.signatures_agree(F.col("a"), F.col("b"))).collect())


def test_names_reasons_and_chains(spark):
    d = spark.createDataFrame([("jdkInternalAPIUsed", "a.B.m(int) → c.D -> e.F.g()", "  x y/z:1  "), (None, "", None), ("unresolved_dependency_coordinates_after_enrichment", "one", "..")], "r string, c string, n string")
    got = [tuple(r) for r in d.select(text.canonical_reason(F.col("r")), text.chain_precision(F.col("c")), text.chain_skeleton(F.col("c")), text.safe_name(F.col("n"))).collect()]
    assert got == [("JDK_INTERNAL_API_USED", 2, "a.B.m → c.D → e.F.g", "x_y_z_1"), ("UNKNOWN", 0, "", "unnamed"), ("DEPENDENCY_COORDINATES_UNRESOLVED", 0, "one", "unnamed")]
    assert d.select(text.humanise(F.col("r"))).first()[0] == "Jdkinternalapiused"
    import hashlib
    import json

    nodes = ["a.B", 'c"\\d']
    one = spark.createDataFrame([tuple(nodes)], "a string, b string").select(text.path_id(F.col("a"), F.col("b"))).first()[0]
    assert one == "PATH-" + hashlib.sha1(json.dumps(nodes).encode()).hexdigest()[:12]


def test_rows_of_a_hot_key_are_paired_in_equal_shares(spark, monkeypatch):
    monkeypatch.setattr(core, "PACK", 3)
    left = spark.createDataFrame([("a", k) for k in range(200)] + [("b", 1), ("b", 1), ("c", 2), (None, 3)], "k string, x int")
    right = spark.createDataFrame([("a", k) for k in range(20)] + [("b", 7), ("b", None), ("d", 1), (None, 3)], "k string, y int")
    got = core.dealt_join(left, right, ["k"])
    key = lambda r: repr(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(left.join(right, "k").collect(), key=key)
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert max(sizes) < 2000  # of 4,004 pairs, nearly all of one key
    assert core.dealt_join(left, right.limit(0), ["k"]).count() == 0


def test_references_are_counted_as_their_pairs_are(spark):
    rng = random.Random(4)
    refs = spark.createDataFrame([(rng.randrange(12), rng.randrange(4)) for _ in range(60)], "p int, s int").distinct()
    targets = spark.createDataFrame([(p, p % 4, p) for p in range(15)] + [(1, None, 99)], "p int, s int, part int")
    pairs = core.reference_join(targets, refs.withColumn("ref", F.concat_ws("-", "p", "s")), ["p", "s"], ["p"], "part", "ref").collect()
    want = {(t, *(sum(r.part == t and r.quality == q for r in pairs) for q in ("exact", "candidate"))) for t in (*range(15), 99)}
    assert {tuple(r) for r in core.reference_numbers(targets, refs, ["p", "s"], ["p"], "part").collect()} == want


def test_replacements_of_many_like_owners_equal_brute_force(spark):
    rng = random.Random(8)
    for owners in (6, 9, 30):
        sides = [{(rng.randrange(2), rng.randrange(owners), rng.choice("abcde")) for _ in range(n)} for n in (40, 30)]
        held = [{k: {m for g, o, m in side if (g, o) == k} for k in {x[:2] for x in side}} for side in sides]
        met = [(g, o, n, len(ms)) for (g, o), ms in held[0].items() for (h, n), ns in held[1].items() if g == h and o != n and ms <= ns and len(ms) > 1]
        want = {x for x in met if sum(y[:2] == x[:2] for y in met) == 1 and sum((y[0], y[2]) == (x[0], x[2]) for y in met) == 1}
        frames = [spark.createDataFrame(sorted(side), "g int, o int, m string") for side in sides]
        got = core.set_replacements(*frames, "g", "o", "m").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_pairs_of_a_product_take_little_room_where_they_are_written(spark, tmp_path):
    left, right = spark.range(800).selectExpr("0 AS k", "id * 7 AS a"), spark.range(20_000).selectExpr("0 AS k", "id * 3 AS b")
    out = str(tmp_path / "pairs")
    core.dealt_join(left, right, ["k"]).write.parquet(out)
    size = sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet"))
    got = spark.read.parquet(out).selectExpr("count(*) AS n", "sum(a) AS a", "sum(b) AS b").collect()[0]
    assert tuple(got) == (16_000_000, 20_000 * 7 * 799 * 400, 800 * 3 * 19_999 * 10_000)
    assert size < 0.6 * 16_000_000
