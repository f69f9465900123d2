"""Strings that reach look-ups by name, through any number of calls: fixpoints over parameters and results of methods.

A place is a parameter of a method (its position, from 0) or its result (position RESULT). Both fixpoints are semi-naive: a round joins only what
the round before found, so cycles end when nothing is new. The way back from the look-ups decides which places matter, and values
are only carried along these. Values travel in blocks of 64, a bit each, so that places which share values have a row for each block, not for each value.

``arguments`` has caller, call (the place of the call in its caller), callee, position and one of literal (a string), passes (the caller's own
parameter that is handed on) and result_of (a method whose result it is); where all three are null the argument isn't known. ``returns`` has method and literal, passes and result_of in the
same sense. ``lookups`` has callee and position: parameters by which a class or member is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .core import cut, forget

#: The position that stands for a method's result, and the reason of a place whose values aren't all known.
RESULT, DYNAMIC = -1, "REFLECTION_TARGET_DYNAMIC"
#: Values up to which their table is broadcast.
NAMES = 100_000


def _grown(start: DataFrame, step, keys: list[str]) -> DataFrame:
    """The least table that holds ``start`` and, with rows, also ``step`` of them; rounds see new rows only. ``keys`` may be null."""
    known = new = cut(start.select(*keys).distinct())
    while not new.isEmpty():
        found = step(new).select(*keys).distinct()
        on = [found[k].eqNullSafe(known[k]) for k in keys]
        more = cut(found.join(known, on, "left_anti"))
        wider = cut(known.unionByName(more))
        forget(*({known, new} - {wider}))
        known, new = wider, more
    forget(new)
    return known


def flows(arguments: DataFrame, returns: DataFrame | None = None) -> DataFrame:
    """``from_method, from_position, to_method, to_position``: from which places strings move to which."""
    def of(df: DataFrame, owner: str, method: str, position: Column) -> DataFrame:
        passed = df.where("passes IS NOT NULL").select(F.col(owner).alias("from_method"), F.col("passes").cast("int").alias("from_position"), F.col(method).alias("to_method"), position.alias("to_position"))
        handed = df.where("passes IS NULL AND result_of IS NOT NULL").select(F.col("result_of").alias("from_method"), F.lit(RESULT).alias("from_position"), F.col(method).alias("to_method"), position.alias("to_position"))
        return passed.unionByName(handed)

    moves = of(arguments, "caller", "callee", F.col("position").cast("int"))
    if returns is not None:
        moves = moves.unionByName(of(returns, "method", "method", F.lit(RESULT)))
    return moves.distinct()


def sink_places(lookups: DataFrame, moves: DataFrame) -> DataFrame:
    """``method, position`` of all places from which a string can reach a look-up, the looked-up parameters themselves among them."""
    start = lookups.select(F.col("callee").alias("method"), F.col("position").cast("int").alias("position"))
    back = cut(moves.repartition("to_method"))

    def step(new: DataFrame) -> DataFrame:
        return new.join(back, (F.col("method") == F.col("to_method")) & (F.col("position") == F.col("to_position"))).select(F.col("from_method").alias("method"), F.col("from_position").alias("position"))

    found = _grown(start, step, ["method", "position"])
    forget(back)
    return found


def sink_parameters(arguments: DataFrame, lookups: DataFrame, overloads: DataFrame) -> DataFrame:
    """``method, position`` of parameters by which something is looked up in the end, where a call names a group of overloads (``callee`` is the group).

    ``overloads``: callee, method; ``lookups``: method, position. What a group's call hands on counts only if every overload of the group looks up by that position.
    """
    size = overloads.select("callee", "method").distinct()
    size = cut(size.join(size.groupBy("callee").agg(F.count("*").alias("many")), "callee"))
    passed = cut(arguments.where("passes IS NOT NULL").select("caller", "callee", F.col("position").cast("int").alias("position"), F.col("passes").cast("int").alias("passes")).distinct().repartition("callee"))
    known = cut(lookups.select("method", F.col("position").cast("int").alias("position")).distinct())
    new = known
    while not new.isEmpty():
        # Groups that a new row may have completed are counted again.
        touched = new.join(size, "method").select("callee", "position").distinct()
        whole = known.join(size, "method").join(touched, ["callee", "position"]).groupBy("callee", "position", "many").agg(F.count("*").alias("have")).where("have = many")
        found = passed.join(whole, ["callee", "position"]).select(F.col("caller").alias("method"), F.col("passes").alias("position")).distinct()
        more = cut(found.join(known, ["method", "position"], "left_anti"))
        wider = cut(known.unionByName(more))
        forget(*({known, new} - {wider}))
        known, new = wider, more
    forget(new, passed, size)
    return known


def _carried(start: DataFrame, moves: DataFrame) -> DataFrame:
    """``method, position, block, bits`` of what ``start`` (same columns) has and of what ``moves`` carry on from there; rounds carry bits that are new only."""
    place = ["method", "position", "block"]
    known = cut(start.groupBy(place).agg(F.bit_or("bits").alias("bits")).withColumn("fresh", F.col("bits")))
    while not (new := known.where("fresh != 0")).isEmpty():
        met = new.join(moves, (F.col("method") == F.col("from_method")) & (F.col("position") == F.col("from_position")))
        found = met.select(F.col("to_method").alias("method"), F.col("to_position").alias("position"), "block", F.lit(0).cast("bigint").alias("bits"), F.col("fresh").alias("got"))
        both = known.select(*place, "bits", F.lit(0).cast("bigint").alias("got")).unionByName(found).groupBy(place).agg(F.bit_or("bits").alias("bits"), F.bit_or("got").alias("got"))
        wider = cut(both.select(*place, F.col("bits").bitwiseOR(F.col("got")).alias("bits"), F.col("got").bitwiseAND(F.bitwise_not("bits")).alias("fresh")))
        forget(known)
        known = wider
    return known.select(*place, "bits")


def value_sets(arguments: DataFrame, lookups: DataFrame, returns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``place_values`` as ``method, position, block, bits`` and the ``block, mask, value`` of every bit: see ``named``."""
    moves = cut(flows(arguments, returns))
    needed = cut(sink_places(lookups, moves))
    carried = cut(moves.join(needed.select(F.col("method").alias("to_method"), F.col("position").alias("to_position")), ["to_method", "to_position"], "left_semi").repartition(_parts(moves), "from_method", "from_position"))
    given = arguments.select(F.col("callee").alias("method"), F.col("position").cast("int").alias("position"), "literal", (F.col("passes").isNull() & F.col("result_of").isNull()).alias("own"))
    if returns is not None:
        given = given.unionByName(returns.select("method", F.lit(RESULT).alias("position"), "literal", (F.col("passes").isNull() & F.col("result_of").isNull()).alias("own")))
    reached = given.select("method", "position").distinct()
    start = given.where("own").select("method", "position", F.col("literal").alias("value")).join(needed, ["method", "position"], "left_semi")
    start = start.unionByName(needed.join(reached, ["method", "position"], "left_anti").withColumn("value", F.lit(None).cast("string")))

    start = cut(start.distinct())
    # Values that many places begin with are numbered together.
    numbers = start.groupBy("value").agg(F.count("*").alias("places")).orderBy(F.desc("places"), "value").select("value", F.monotonically_increasing_id().alias("id"))
    names = cut(numbers.select("value", F.expr("shiftright(id, 6)").alias("block"), F.expr("shiftleft(1L, CAST(id % 64 AS INT))").alias("mask")))
    bits = start.join(names, start["value"].eqNullSafe(names["value"])).select("method", "position", "block", F.col("mask").alias("bits"))
    found = _carried(bits, carried)
    forget(start, moves, needed, carried)
    return found, names


def _parts(df: DataFrame) -> int:
    """Partitions for a table that is joined in every round: they are fixed, so that it is dealt out once."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def named(sets: DataFrame, names: DataFrame) -> DataFrame:
    """``sets`` (with ``block`` and ``bits``) with a row and a ``value`` for each bit."""
    of = names.groupBy("block").agg(F.collect_list(F.struct("mask", "value")).alias("of"))  # 64 at most
    each = sets.join(F.broadcast(of) if names.count() <= NAMES else of, "block")
    return each.withColumn("one", F.explode(F.filter("of", lambda x: x["mask"].bitwiseAND(F.col("bits")) != 0))).select(*[c for c in sets.columns if c not in ("block", "bits")], F.col("one.value").alias("value"))


def place_values(arguments: DataFrame, lookups: DataFrame, returns: DataFrame | None = None) -> DataFrame:
    """``method, position, value`` for every place that leads to a look-up: the strings that can be there, and a null where there can be one that isn't known.

    Not known are arguments that are none of literal, parameter and result, results of methods without ``returns``, and parameters of methods that
    nothing calls. Contexts aren't told apart: a method's result is the same wherever it is called. Literals that can reach a place are listed even
    where a null says that there may be others.
    """
    return named(*value_sets(arguments, lookups, returns))


def indirect_uses(arguments: DataFrame, lookups: DataFrame, returns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Uses by name ``caller, call, callee, value`` and what isn't known, ``callee, position, reason``.

    A use is told of the method that has the literal: its call hands it to a parameter from which it reaches a look-up, through any number of calls.
    The second table has the looked-up parameters that a string which isn't known can reach too.
    """
    moves = cut(flows(arguments, returns))
    sinks = sink_places(lookups, moves)
    told = arguments.where("literal IS NOT NULL").select("caller", "call", "callee", F.col("position").cast("int").alias("position"), F.col("literal").alias("value"))
    uses = told.join(sinks.select(F.col("method").alias("callee"), "position"), ["callee", "position"], "left_semi").select("caller", "call", "callee", "value").distinct()
    open_ends = place_values(arguments, lookups, returns).where("value IS NULL").select(F.col("method").alias("callee"), "position")
    dynamic = lookups.select("callee", F.col("position").cast("int").alias("position")).distinct().join(open_ends, ["callee", "position"], "left_semi")
    return uses, dynamic.withColumn("reason", F.lit(DYNAMIC))
