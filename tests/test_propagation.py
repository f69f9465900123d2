"""Strings that reach look-ups through calls, against brute force on random programs."""

import random

from pyspark.sql import functions as F

from tidewright.operators import propagation

ARGUMENTS = "caller string, call int, callee string, position int, literal string, passes int, result_of string"
RETURNS = "method string, literal string, passes int, result_of string"


def program(rng, methods=9):
    m = [f"m{k}" for k in range(methods)]

    def source():
        return rng.choice([(rng.choice("abc"), None, None), (None, rng.randrange(2), None), (None, None, rng.choice(m)), (None, None, None)])

    arguments = [(rng.choice(m), k, rng.choice(m), rng.randrange(2), *source()) for k in range(rng.randrange(25))]
    returns = [(x, *source()) for x in m for _ in range(rng.randrange(3))]
    return arguments, returns, [(rng.choice(m), rng.randrange(2)) for _ in range(2)]


def brute(arguments, returns, lookups):
    """Values of all places by sweeping until nothing changes."""
    facts = [((callee, pos), literal, (caller, passes) if passes is not None else (of, -1) if of is not None else None) for caller, _, callee, pos, literal, passes, of in arguments]
    facts += [((m, -1), literal, (m, passes) if passes is not None else (of, -1) if of is not None else None) for m, literal, passes, of in returns]
    sinks, size = set(lookups), -1
    while size != len(sinks):
        size = len(sinks)
        sinks |= {source for to, _, source in facts if to in sinks and source}
    values = {s: set() if any(to == s for to, _, _ in facts) else {None} for s in sinks}
    size = -1
    while size != sum(map(len, values.values())):
        size = sum(map(len, values.values()))
        for to, literal, source in facts:
            if to in values:
                values[to] |= values[source] if source else {literal}
    uses = {(caller, call, callee, literal) for caller, call, callee, pos, literal, *_ in arguments if literal is not None and (callee, pos) in sinks}
    return {(*p, v) for p, vs in values.items() for v in vs}, uses, {(*p, propagation.DYNAMIC) for p in lookups if None in values[p]}


def frames(spark, arguments, returns, lookups):
    return spark.createDataFrame(arguments, ARGUMENTS), spark.createDataFrame(lookups, "callee string, position int"), spark.createDataFrame(returns, RETURNS)


def test_values_and_uses_equal_brute_force(spark):
    rng = random.Random(1)
    for _ in range(4):
        one = program(rng)
        a, l, r = frames(spark, *one)
        values, uses, dynamic = brute(*one)
        assert {tuple(x) for x in propagation.place_values(a, l, r).collect()} == values
        got = propagation.indirect_uses(a, l, r)
        assert {tuple(x) for x in got[0].collect()} == uses and {tuple(x) for x in got[1].collect()} == dynamic


def test_long_chains_cycles_and_empty_tables(spark):
    chain = [(f"c{k}", k, f"c{k + 1}", 0, None, 0, None) for k in range(12)] + [("c5", 90, "c2", 0, None, 0, None), ("main", 91, "c0", 0, "p.Hidden", None, None)]
    a, l, r = frames(spark, chain, [], [("c12", 0)])
    uses, dynamic = propagation.indirect_uses(a, l)
    assert [tuple(x) for x in uses.collect()] == [("main", 91, "c0", "p.Hidden")] and dynamic.count() == 0
    assert propagation.indirect_uses(a.limit(0), l)[1].count() == 1 and propagation.indirect_uses(a, l.limit(0))[0].count() == 0
    # A name that comes from outside is said to be dynamic, and the literal is still listed.
    a = a.unionByName(spark.createDataFrame([("api", 1, "c3", 0, None, None, None)], ARGUMENTS))
    assert [r.position for r in propagation.indirect_uses(a, l)[1].collect()] == [0] and propagation.place_values(a, l).where("method = 'c12' AND value = 'p.Hidden'").count() == 1


def test_overloads_count_only_where_all_agree(spark):
    a = spark.createDataFrame([("top", 1, "load/1", 0, None, 1, None), ("up", 2, "top/2", 0, None, 0, None), ("up", 2, "top/2", 1, None, 1, None)], ARGUMENTS)
    groups = [("load/1", "load1"), ("load/1", "load2"), ("top/2", "top"), ("up/2", "up")]
    over = spark.createDataFrame(groups, "callee string, method string")
    one, both = (spark.createDataFrame(x, "method string, position int") for x in ([("load1", 0)], [("load1", 0), ("load2", 0)]))
    assert {tuple(r) for r in propagation.sink_parameters(a, one, over).collect()} == {("load1", 0)}
    assert {tuple(r) for r in propagation.sink_parameters(a, both, over).collect()} == {("load1", 0), ("load2", 0), ("top", 1), ("up", 1)}


def test_files_of_rounds_are_removed(spark):
    from tidewright.operators.core import cut, forget

    df = cut(spark.range(3).withColumn("x", F.lit(1)))
    path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = lambda: fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    assert there()
    forget(df, spark.range(2))
    assert not there()


def test_values_of_a_place_travel_in_blocks(spark):
    literals = [("main", k, "c0", 0, f"v{k:03}", None, None) for k in range(130)] + [("main", 130, "c0", 0, None, None, None)]
    a, l, _ = frames(spark, [*literals, ("c0", 0, "c1", 0, None, 0, None), ("c1", 0, "c0", 0, None, 0, None)], [], [("c1", 0)])
    sets, names = propagation.value_sets(a, l)
    assert names.count() == 131 and sets.count() <= 2 * (names.select("block").distinct().count()) < 131
    got = [tuple(r) for r in propagation.named(sets, names).collect()]
    assert len(got) == 262 and set(got) == {(m, 0, v) for m in ("c0", "c1") for v in [None, *(f"v{k:03}" for k in range(130))]}
