"""Queries on graphs built from the tables: region <- nation <- customer <- order <- part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import graph
from ..sources.tables import table


def _edges(spark, d) -> DataFrame:
    """caller, callee, confidence: an order calls the parts in it, a customer its orders, and so on up."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    conf = F.when(F.col("l_returnflag") == "N", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    parts = [
        table(spark, d, "lineitem").select(key("O", "l_orderkey").alias("caller"), key("P", "l_partkey").alias("callee"), conf.alias("confidence")),
        table(spark, d, "orders").select(key("C", "o_custkey").alias("caller"), key("O", "o_orderkey").alias("callee"), F.lit("high").alias("confidence")),
        table(spark, d, "customer").select(key("N", "c_nationkey").alias("caller"), key("C", "c_custkey").alias("callee"), F.lit("high").alias("confidence")),
        table(spark, d, "nation").select(key("R", "n_regionkey").alias("caller"), key("N", "n_nationkey").alias("callee"), F.lit("high").alias("confidence")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _parts(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("seed"))


def reach_depth(spark, d):
    return graph.least_costs(_edges(spark, d), _parts(spark, d), 5).select("seed", "node", F.col("cost").alias("depth"))


def reach_cost(spark, d):
    e = _edges(spark, d).withColumn("step", graph.edge_cost(F.col("confidence")))
    return graph.least_costs(e, _parts(spark, d), 5, "step")


def reach_paths(spark, d):
    p = graph.paths(_edges(spark, d).select("caller", "callee").distinct(), _parts(spark, d), 5)
    return p.select("seed", F.array_join("path", " <- ").alias("path"), (F.size("path") - 1).cast("bigint").alias("depth"))


def business_reaches(spark, d):
    parts = _parts(spark, d)
    hit = graph.least_costs(_edges(spark, d).where("confidence = 'high'"), parts, 2).where("node LIKE 'C%'").select("seed").distinct().withColumn("r", F.lit(True))
    return parts.join(hit, "seed", "left").select("seed", F.coalesce("r", F.lit(False)).alias("reached"))


def _types(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return table(spark, d, "customer").select(key("C", "c_custkey").alias("child"), key("N", "c_nationkey").alias("parent")).unionByName(table(spark, d, "nation").select(key("N", "n_nationkey").alias("child"), key("R", "n_regionkey").alias("parent")))


def type_closure(spark, d):
    return graph.closure(_types(spark, d))


def interface_impls(spark, d):
    c = graph.closure(_types(spark, d)).where("ancestor LIKE 'R%'")
    return c.groupBy("ancestor").agg(F.count("*").alias("n"))


def pareto_frontier(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("s_nationkey"), (F.col("s_suppkey") * 7 % 40).alias("cost"), F.round(F.col("s_acctbal") * 100).cast("bigint").alias("gain"))
    return graph.pareto(s, ["s_nationkey"], "cost", "gain", "s_suppkey")


QUERIES = {f.__name__: f for f in (reach_depth, reach_cost, reach_paths, business_reaches, type_closure, interface_impls, pareto_frontier)}

_E = """e AS (SELECT 'O' || l_orderkey AS caller, 'P' || l_partkey AS callee, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 5 END AS step FROM lineitem
    UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, 1 FROM orders UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 1 FROM customer UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey, 1 FROM nation)"""
SQL = {
    "reach_depth": f"""WITH RECURSIVE {_E}, r AS (SELECT 'P' || p_partkey AS seed, 'P' || p_partkey AS node, CAST(0 AS BIGINT) AS depth FROM part
        UNION ALL SELECT seed, caller, depth + 1 FROM r JOIN e ON node = callee WHERE depth < 5) SELECT seed, node, min(depth) AS depth FROM r GROUP BY 1, 2""",
    "reach_cost": f"""WITH RECURSIVE {_E}, r AS (SELECT 'P' || p_partkey AS seed, 'P' || p_partkey AS node, CAST(0 AS BIGINT) AS cost FROM part
        UNION ALL SELECT seed, caller, cost + step FROM r JOIN e ON node = callee WHERE cost + step <= 5) SELECT seed, node, min(cost) AS cost FROM r GROUP BY 1, 2""",
    "reach_paths": f"""WITH RECURSIVE {_E}, u AS (SELECT DISTINCT caller, callee FROM e), r AS (SELECT 'P' || p_partkey AS seed, 'P' || p_partkey AS node, 'P' || p_partkey AS path, CAST(0 AS BIGINT) AS depth FROM part
        UNION ALL SELECT seed, caller, path || ' <- ' || caller, depth + 1 FROM r JOIN u ON node = callee WHERE depth < 5) SELECT seed, path, depth FROM r WHERE depth > 0""",
    "business_reaches": "SELECT 'P' || p_partkey AS seed, EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = p_partkey AND l_returnflag = 'N') AS reached FROM part",
    "type_closure": """SELECT 'C' || c_custkey AS child, 'N' || c_nationkey AS ancestor FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
        UNION ALL SELECT 'C' || c_custkey, 'R' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "interface_impls": """SELECT 'R' || n_regionkey AS ancestor, CAST(count(DISTINCT n_nationkey) + count(c_custkey) AS BIGINT) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""",
    "pareto_frontier": """WITH s AS (SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_suppkey * 7 % 40 AS cost, CAST(round(s_acctbal * 100) AS BIGINT) AS gain FROM supplier)
        SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.s_nationkey = s.s_nationkey AND o.s_suppkey <> s.s_suppkey AND o.cost <= s.cost AND o.gain >= s.gain AND (o.cost < s.cost OR o.gain > s.gain OR o.s_suppkey < s.s_suppkey))""",
}
