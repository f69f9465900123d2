"""Reverse reachability over call graphs: bounded loops of equi-joins with pruning before every level.

A level's frontier is reduced before it is joined again, so paths are never enumerated where distances or
frontiers are asked for. Every level is written to the checkpoint folder as Parquet, so that none is computed twice; an edge is dealt only to the level that it belongs to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .core import forget, release, stored as cut

#: A path's confidence below which it isn't followed, and the stop reasons.
FADED = 0.3
STOPS = ("LOW_CONFIDENCE_EDGE", "DEPTH_LIMIT_REACHED", "CONFIDENCE_DECAYED", "SYSTEM_CODE_REACHED", "FRAMEWORK_BOUNDARY")

#: Edges that are sent to every task where a length of walks has no more of them, so that many rows at few nodes stay spread out.
FEW = 50_000


def edge_cost(confidence: Column) -> Column:
    """1, 2 or 5 for high, medium and any other confidence."""
    return F.when(confidence == "high", 1).when(confidence == "medium", 2).otherwise(5)


def decay(confidence: Column) -> Column:
    """What an edge multiplies a path's confidence by."""
    return F.when(confidence == "high", 0.95).when(confidence == "medium", 0.8).otherwise(0.5)


def stop_reason(cost: Column, max_cost: int, score: Column, system_code: Column, boundary: Column, last: Column) -> Column:
    """Why a path isn't followed further: budget, faded confidence, system code or framework boundary, in this order; null to go on."""
    spent = F.when(last == "low", "LOW_CONFIDENCE_EDGE").otherwise("DEPTH_LIMIT_REACHED")
    return F.when(cost >= max_cost, spent).when(score < FADED, "CONFIDENCE_DECAYED").when(system_code, "SYSTEM_CODE_REACHED").when(boundary, "FRAMEWORK_BOUNDARY")


def adaptive_limit(base: int, edges: int, exact: bool, all_high: bool) -> int:
    """The cost limit, raised for exact targets on paths of high confidence only. ``edges``: how many the whole graph has."""
    return max(base, min(20, edges + 1, 3 * base)) if exact and all_high else base


def least_costs(edges: DataFrame, seeds: DataFrame, limit: int, cost: str | None = None) -> DataFrame:
    """``seed, node, cost``: the least cost at which each seed is reached from each node, up to ``limit``.

    ``edges`` has caller and callee, and a positive integer ``cost`` column or else each edge costs 1; repeated edges count by the cheapest,
    null ends lead nowhere. ``seeds`` has seed; repeated ones count once. Without seeds the result is empty.
    """
    # Dealt before it is grouped, so that edges are shuffled once.
    steps = edges.where("caller IS NOT NULL AND callee IS NOT NULL").select("callee", "caller", (F.col(cost) if cost else F.lit(1)).cast("bigint").alias("step"))
    steps = cut(steps.repartition("callee").groupBy("callee", "caller").agg(F.min("step").alias("step")).where(F.col("step") <= limit))
    now = cut(seeds.where("seed IS NOT NULL").select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).cast("bigint").alias("cost")).distinct())
    once, layers, files = _layers(steps, now.select("node"), limit)
    levels = [now]
    for here in layers if once else [steps] * limit:
        met = now.select("seed", F.col("node").alias("callee"), "cost").join(here, "callee")
        met = met.select("seed", F.col("caller").alias("node"), (F.col("cost") + F.col("step")).alias("cost")).where(F.col("cost") <= limit).groupBy("seed", "node").agg(F.min("cost").alias("cost"))
        if not once:
            known = reduce(DataFrame.unionByName, levels).select("seed", "node", F.col("cost").alias("least"))
            met = met.join(known, (met["seed"] == known["seed"]) & (met["node"] == known["node"]) & (F.col("least") <= F.col("cost")), "left_anti")
        now, met = cut(met), None
        release(now.sparkSession)
        if now.isEmpty():
            break
        levels.append(now)
    forget(steps, *files)
    found = reduce(DataFrame.unionByName, levels)
    return found if once else found.groupBy("seed", "node").agg(F.min("cost").alias("cost"))


def _layers(edges: DataFrame, nodes: DataFrame, limit: int) -> tuple[bool, list[DataFrame], list[DataFrame]]:
    """Whether each node is reached by walks of one length alone, of up to ``limit`` edges from any of ``nodes``; if so, the edges of each length, marked for broadcast if they are at most FEW; and what was written for them.

    Only nodes are held, not who reaches them. The edges of a length are taken out before the next one is looked for, as no other length has them. Where walks of different lengths meet, nothing is known of the edges.
    """
    now = cut(nodes.distinct())
    rest, seen, layers, files, once = edges, [now], [], [], True
    while once and len(layers) < limit:
        split = cut(rest.join(now.select(F.col("node").alias("callee"), F.lit(True).alias("_here")), "callee", "left"))
        files.append(split)
        here, rest = split.where("_here").drop("_here"), split.where("_here IS NULL").drop("_here")
        layers.append(F.broadcast(here) if now.count() <= FEW and here.count() <= FEW else here)
        now = cut(here.select(F.col("caller").alias("node")).distinct())
        seen.append(now)
        if now.isEmpty():
            layers.pop()
            break
        once = now.join(reduce(DataFrame.unionByName, seen[:-1]), "node", "left_semi").isEmpty()
        release(edges.sparkSession)
    forget(*seen)
    if not once:
        forget(*files)
        return False, [], []
    return True, layers, files


def paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``seed, path`` (array, seed first) of every path without a repeated node, of 1 to ``depth`` edges: for few seeds."""
    edges = cut(edges.select("caller", "callee"))
    now = seeds.select(F.array("seed").alias("path"))
    once, layers, files = _layers(edges, seeds.select(F.col("seed").alias("node")), depth)
    levels = []
    for here in layers or [edges] if once else [edges] * depth:
        # The seed is the first of its path and isn't written beside it.
        now = now.join(here, F.element_at("path", -1) == F.col("callee")).where(~F.array_contains("path", F.col("caller"))).select(F.concat("path", F.array("caller")).alias("path"))
        now = cut(now)
        release(now.sparkSession)
        levels.append(now)
    forget(edges, *files)
    return reduce(DataFrame.unionByName, levels).select(F.element_at("path", 1).alias("seed"), "path")


def closure(edges: DataFrame, limit: int = 64) -> DataFrame:
    """``child, ancestor`` of the transitive closure of (child, parent), by path doubling, in about log2 of the depth rounds."""
    now = edges.select("child", F.col("parent").alias("ancestor")).distinct()
    size, level = now.count(), 0
    while level < limit:
        level += 1
        further = now.alias("a").join(now.alias("b"), F.col("a.ancestor") == F.col("b.child")).select(F.col("a.child"), F.col("b.ancestor"))
        now = cut(now.unionByName(further).distinct())
        if (n := now.count()) == size:
            break
        size = n
    return now


def pareto(rows: DataFrame, keys: list[str], cost: str, gain: str, seq: str) -> DataFrame:
    """The rows of a key that no row of smaller or equal cost and larger or equal gain dominates, by one window instead of a self join."""
    before = Window.partitionBy(*keys).orderBy(F.col(cost), F.desc(gain), F.col(seq)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_best", F.max(gain).over(before)).where(F.col("_best").isNull() | (F.col("_best") < F.col(gain))).drop("_best")


def longest_only(chains: DataFrame, key: str, path: str, rank: str | None = None) -> DataFrame:
    """Chains (arrays) that no longer chain of the key ends with; with ``rank``, only one of a rank that is not above its own covers a chain.

    A chain of one node is never covered. Only hashes of the ends of longer chains are spread; where one is met, the chain that it is of, known by a
    hash as well, is compared in full. No pair of chains is formed that shares none.
    """
    where = F.col(rank) if rank else F.lit(0)
    longer = chains.where(F.size(path) > 2).select(F.col(key).alias("_key"), F.col(path).alias("_long"), where.alias("_rank"), F.xxhash64(path).alias("_id")).distinct()
    hashes = F.transform(F.sequence(F.lit(2), F.size("_long") - 1), lambda n: F.xxhash64(F.slice("_long", -n, n)))
    ends = longer.select("_key", "_rank", "_id", F.explode(hashes).alias("_hash")).groupBy("_key", "_hash").agg(F.min(F.struct("_rank", "_id")).alias("_m"))
    mine = chains.where(F.size(path) > 1).select(F.col(key).alias("_k"), F.col(path).alias("_path"), where.alias("_w")).distinct()
    hits = mine.join(ends, (F.col("_k") == F.col("_key")) & (F.xxhash64("_path") == F.col("_hash")) & (F.col("_m._rank") <= F.col("_w"))).select("_k", "_path", "_w", F.col("_m._id").alias("_of"))
    n = F.size("_path")
    sure = hits.join(longer.select("_key", "_id", "_long").distinct(), (F.col("_k") == F.col("_key")) & (F.col("_of") == F.col("_id")) & (F.slice("_long", -n, n) == F.col("_path"))).select("_k", "_path", "_w").distinct()
    return chains.join(sure, (F.col(key) == F.col("_k")) & (F.col(path) == F.col("_path")) & (where == F.col("_w")), "left_anti")


def traced(edges: DataFrame, seeds: DataFrame, max_cost: int, max_edges: int = 64) -> DataFrame:
    """Reverse paths under the stop policy: ``seed, path, cost, confidence, last, stop`` of every path that ends, with why it did.

    ``edges``: caller, callee, confidence (high, medium or other), system (the caller is code of the platform), boundary (of a framework), test, entry (of the
    business). ``seeds``: seed and, if wanted, exact: such seeds have a larger budget on paths of high confidence alone. Paths go from callees to callers
    without a repeated node; test code is never entered. For each seed and node the states (cost, confidence) reached so far are kept across levels: a path that
    costs no less and is no surer than one that came there before, or on the same level (ties: the smallest path), isn't followed or given. A path ends where
    ``stop_reason`` says so (``stop``), at a business entry ('BUSINESS_ENTRY'), or where nothing but its own nodes calls its last one ('NO_CALLER').
    """
    # Dealt before repeated ones are taken out, so that edges are shuffled once.
    e = cut(edges.where("NOT test").select(F.col("callee").alias("at"), "caller", "confidence", "system", "boundary", "entry").repartition("at").distinct())
    exact = F.coalesce(F.col("exact"), F.lit(False)) if "exact" in seeds.columns else F.lit(False)
    larger = adaptive_limit(max_cost, e.count() if "exact" in seeds.columns else 0, True, True)
    limit = F.when(F.col("exact") & F.col("all_high"), larger).otherwise(max_cost)
    # A path is held as its seed, what is between, and its last node; null is between where it has no edge yet.
    nodes = f"array<{edges.schema['caller'].dataType.simpleString()}>"
    now = seeds.groupBy("seed").agg(F.max(exact).alias("exact")).select("seed", "exact", F.lit(None).cast(nodes).alias("between"), F.col("seed").alias("at"), F.lit(0).cast("bigint").alias("cost"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("last"), F.lit(True).alias("all_high"))
    now = cut(now)
    once, layers, files = _layers(e.withColumnRenamed("at", "callee"), now.select(F.col("at").alias("node")), max_edges)
    frontier, ended = cut(now.select("seed", "at", "cost", "score")), []
    grows = F.coalesce(F.concat("between", F.array("at")), F.array().cast(nodes))
    new_node = (F.col("caller") != F.col("seed")) & (F.col("caller") != F.col("at")) & ~F.coalesce(F.array_contains("between", F.col("caller")), F.lit(False))
    for k in range(max_edges):
        # One join gives what follows a path and, where nothing does, the path itself.
        here = e if not once else layers[k].withColumnRenamed("callee", "at") if k < len(layers) else e.where("false")
        here = here.withColumnRenamed("at", "_from")
        met = now.join(here, (F.col("at") == F.col("_from")) & new_node, "left")
        grown = met.where("_from IS NOT NULL").select(
            "seed", "exact", grows.alias("between"), F.col("caller").alias("at"), (F.col("cost") + edge_cost(F.col("confidence"))).alias("cost"), (F.col("score") * decay(F.col("confidence"))).alias("score"),
            F.col("confidence").alias("last"), (F.col("all_high") & (F.col("confidence") == "high")).alias("all_high"), "system", "boundary", "entry",
        )
        ends = met.where("_from IS NULL").select(*now.columns).withColumn("stop", F.lit("NO_CALLER"))
        # Paths of a level are of one length, so that what is between orders them as the whole paths do.
        new, f = pareto(grown, ["seed", "at"], "cost", "score", "between"), frontier.select(F.col("seed").alias("_seed"), F.col("at").alias("_at"), F.col("cost").alias("_cost"), F.col("score").alias("_score"))
        beaten = (F.col("seed") == F.col("_seed")) & (F.col("at") == F.col("_at")) & (F.col("_cost") <= F.col("cost")) & (F.col("_score") >= F.col("score"))
        if not once:  # else no path came there on an earlier level
            new = new.join(f, beaten, "left_anti")
        stop = F.when(F.col("entry"), "BUSINESS_ENTRY").otherwise(stop_reason(F.col("cost"), limit, F.col("score"), F.col("system"), F.col("boundary"), F.col("last")))
        level = cut(new.withColumn("stop", stop).drop("system", "boundary", "entry").unionByName(ends))
        ended.append(level.where("stop IS NOT NULL"))
        if not once:
            wider = cut(frontier.unionByName(level.where("stop IS NULL OR stop != 'NO_CALLER'").select("seed", "at", "cost", "score")))
            forget(frontier)
            frontier = wider
        now, met, grown, ends, new, f = level.where("stop IS NULL"), None, None, None, None, None
        release(e.sparkSession)
        if now.isEmpty():
            break
    ended.append(now.withColumn("stop", F.lit("DEPTH_LIMIT_REACHED")))
    forget(frontier, e, *files)
    path = F.coalesce(F.concat(F.array("seed"), "between", F.array("at")), F.array("seed")).alias("path")
    return reduce(DataFrame.unionByName, ended).select("seed", path, "cost", F.round("score", 6).alias("confidence"), "last", "stop")


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, level``: the length of the longest way to each node from those that nothing comes before; null level on and behind a cycle.

    ``nodes`` has node, ``edges`` has before and after; edges to other nodes and repeated ones don't matter. A round takes out the nodes that nothing holds back any more,
    whose levels become a least level of what follows, and all nodes that only one node holds back: their level is the greater of that least one and
    the other's level plus a distance, and such rules are put together by doubling, so that a chain of any length takes rounds by its logarithm.
    """
    size = nodes.schema["node"].dataType.simpleString()
    left = cut(nodes.select("node").distinct().withColumn("base", F.lit(0).cast("bigint")))
    e = edges.select("before", "after").distinct().withColumn("step", F.lit(1).cast("bigint"))
    e = cut(e.join(left.select(F.col("node").alias("before")), "before", "left_semi").join(left.select(F.col("node").alias("after")), "after", "left_semi"))
    known, folded = [], []
    while True:
        free = cut(left.join(e.select(F.col("after").alias("node")).distinct(), "node", "left_anti"))
        some = not free.isEmpty()
        if some:
            known.append(free.select("node", F.col("base").alias("level")))
            left, e = _without(left, e, free.select("node", F.col("base").alias("least"), F.lit(None).cast("bigint").alias("far"), F.lit(None).cast(size).alias("root")))
        one = e.groupBy("after").agg(F.count("*").alias("n"), F.first("before").alias("root"), F.first("step").alias("far")).where("n = 1").select(F.col("after").alias("node"), "root", "far").join(left, "node")
        rules = _composed(one.select("node", "root", F.col("base").alias("least"), "far"))
        if rules.isEmpty():
            if not some:
                break
            continue
        folded.append(rules)
        left, e = _without(left, e, rules)
    forget(e)
    out = reduce(DataFrame.unionByName, [*known, left.select("node", F.lit(None).cast("bigint").alias("level"))])
    for rules in reversed(folded):
        out = cut(out)
        out = out.unionByName(rules.join(out.select(F.col("node").alias("root"), "level"), "root").select("node", F.when(F.col("level").isNotNull(), F.greatest("least", F.col("level") + F.col("far"))).alias("level")))
    return out.select("node", F.col("level").cast("int").alias("level"))


def _without(left: DataFrame, e: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left when nodes are taken out whose level is the greater of ``least`` and, where they have a ``root``, its level plus ``far``."""
    met = e.join(gone.select(F.col("node").alias("before"), "root", "least", "far"), "before", "left").join(gone.select(F.col("node").alias("after")), "after", "left_anti")
    met = cut(met.withColumn("least", F.col("least") + F.col("step")))
    base = met.where("least IS NOT NULL").groupBy(F.col("after").alias("node")).agg(F.max("least").alias("least"))
    nodes = cut(left.join(gone.select("node"), "node", "left_anti").join(base, "node", "left").select("node", F.greatest("base", "least").alias("base")))
    stay = met.where("least IS NULL OR root IS NOT NULL").select(F.coalesce("root", "before").alias("before"), "after", (F.col("step") + F.coalesce("far", F.lit(0))).alias("step"))
    new = cut(stay.groupBy("before", "after").agg(F.max("step").alias("step")))
    forget(met, left, e)
    return nodes, new


def _composed(rules: DataFrame) -> DataFrame:
    """Rules ``node, root, least, far`` put together until no root has a rule itself; those that go round a cycle are left out."""
    named = cut(rules)
    now = cut(named.join(named.select(F.col("node").alias("root"), F.lit(True).alias("open")), "root", "left").select("node", "root", "least", "far", F.coalesce("open", F.lit(False)).alias("open")))
    forget(named)
    still = now.where("open").count()
    while still:
        further = now.select(F.col("node").alias("root"), F.col("root").alias("_root"), F.col("least").alias("_least"), F.col("far").alias("_far"), F.col("open").alias("_open"))
        on = now.where("open").join(further, "root").select("node", F.col("_root").alias("root"), F.greatest(F.col("least"), F.col("_least") + F.col("far")).alias("least"), (F.col("far") + F.col("_far")).alias("far"), F.col("_open").alias("open"))
        new = cut(now.where("NOT open").unionByName(on))
        forget(now)
        now, before, still = new, still, new.where("open").count()
        if still == before:  # all others would have come closer to their roots
            break
    return now.where("NOT open").drop("open")
