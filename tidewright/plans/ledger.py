"""Queries on ledgers, verdicts and rollups."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.text import short_id
from ..operators import core, evidence, graph
from ..sources.tables import table

STATUS = ["complete", "partial", "failed"]


def _days(spark, d):
    """The event types of each user and day, in order, as arrays."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.struct("ts", "event_id", "event_type").alias("e"))
    return e.groupBy("user_id", "day").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x.event_type).alias("path"))


def suffix_suppress(spark, d):
    paths = _days(spark, d).select("user_id", "path").distinct()
    return graph.longest_only(paths, "user_id", "path").select("user_id", F.array_join("path", ">").alias("path"))


def path_dedup(spark, d):
    return _days(spark, d).groupBy("user_id", F.array_join("path", ">").alias("path")).agg(F.count("*").alias("occurrences"))


def ledger_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", short_id("API-", F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")).alias("api_id"))


def five_state(spark, d):
    l = table(spark, d, "lineitem")
    g = l.groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_discount") > 0.09).alias("invalid_input"), F.bool_and(F.col("l_returnflag") == "N").alias("preserved"), F.bool_or((F.col("l_quantity") > 45) & (F.col("l_linestatus") == "F")).alias("business_path"),
        F.bool_or(F.col("l_tax") > 0.07).alias("blocking"), F.bool_or(F.col("l_quantity") < 3).alias("independent_semantic"), F.bool_or(F.col("l_suppkey") % 11 == 0).alias("concern"), F.bool_or(F.col("l_suppkey") % 13 == 0).alias("unactivated"),
        F.bool_or(F.col("l_partkey") % 17 == 0).alias("ambiguous"), F.bool_or(F.col("l_partkey") % 7 == 0).alias("truncated"), F.bool_or(F.col("l_partkey") % 5 == 0).alias("physical_path"), F.bool_or(F.col("l_quantity") > 20).alias("any_path"),
        F.bool_or(F.col("l_linenumber") <= 6).alias("applicable"), F.bool_and(F.col("l_returnflag") != "R").alias("all_complete"))
    flags = {c: F.col(c) for c in g.columns if c != "l_orderkey"}
    return g.select("l_orderkey", evidence.five_state(flags).alias("state"))


def coverage_rollup(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "partial").otherwise("failed")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("c_mktsegment", F.year("o_orderdate").cast("bigint").alias("year"), "o_orderpriority").agg(evidence.worst(s, STATUS).alias("coverage"))


def priority_score(spark, d):
    severity = F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    g = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 20).alias("dep")).agg(F.countDistinct("user_id").alias("callers"), F.bool_or(F.col("value") > 99).alias("runtime"))
    g = g.withColumn("score", (severity * F.greatest("callers", F.lit(1)) * F.when(F.col("runtime"), 2).otherwise(1)).cast("bigint"))
    dep = g.groupBy("dep").agg(F.max("score").alias("top"), F.sum("score").alias("total"), F.count("*").alias("n"))
    return dep.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("top"), F.desc("total"), F.desc("n"), "dep")).cast("bigint"))


def occurrence_two_level(spark, d):
    l = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("bigint").alias("q"))
    return l.groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.max("q").alias("q")).groupBy("l_partkey").agg(F.sum("q").alias("occurrences"))


def reason_histogram(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).cast("bigint"))


def sample_topk(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return core.top_k(o, ["o_orderpriority"], [F.desc("cents"), "o_orderkey"], 20).withColumn("rank", F.col("rank").cast("bigint"))


def module_rollup(spark, d):
    x = table(spark, d, "documents").select("source", "lang", F.sha2("text", 256).alias("api")).distinct()
    return x.groupBy("source", "lang").agg(F.count("*").alias("n_apis"))


def scale_ratio(spark, d):
    m = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    w = Window.orderBy("month")
    # One row for each month: the window's one task sees a few hundred rows at most.
    median = m.agg(F.median("n").alias("median"))
    return m.withColumn("previous", F.lag("n").over(w)).withColumn("steep", F.col("n") * 2 > F.col("previous") * 5).crossJoin(F.broadcast(median))


def topology_flags(spark, d):
    l = table(spark, d, "lineitem")
    return l.groupBy("l_suppkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.bool_or((F.col("l_linestatus") == "O") & (F.col("l_quantity") >= 50)).alias("large_open"), F.bool_and(F.col("l_discount") < 0.1).alias("all_below"), F.countDistinct("l_returnflag").alias("kinds"))


def status_pivot(spark, d):
    p = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.select("o_orderpriority", *[F.coalesce(F.col(s), F.lit(0)).alias(f"n_{s.lower()}") for s in ("F", "O", "P")])


def fail_closed(spark, d):
    """Certain verdicts whose identity isn't verified by both other tables are downgraded."""
    certain = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 1500, "reachable").otherwise("uncertain").alias("state"))
    verified = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct().withColumn("ok", F.lit(True))
    j = certain.join(verified, "doc_id", "left")
    lost = (F.col("state") == "reachable") & F.col("ok").isNull()
    return j.select("doc_id", F.when(lost, "not_analyzed").otherwise(F.col("state")).alias("state"), F.when(lost, "EVIDENCE_IDENTITY_MISMATCH").alias("reason"))


QUERIES = {f.__name__: f for f in (suffix_suppress, path_dedup, ledger_ids, five_state, coverage_rollup, priority_score, occurrence_two_level, reason_histogram, sample_topk, module_rollup, scale_ratio, topology_flags, status_pivot, fail_closed)}

_DAYS = "p AS (SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM events GROUP BY user_id, CAST(ts AS DATE))"
SQL = {
    "suffix_suppress": f"WITH {_DAYS}, u AS (SELECT DISTINCT * FROM p) SELECT * FROM u WHERE NOT contains(path, '>') OR NOT EXISTS (SELECT 1 FROM u o WHERE o.user_id = u.user_id AND suffix(o.path, '>' || u.path))",
    "path_dedup": f"WITH {_DAYS} SELECT user_id, path, count(*) AS occurrences FROM p GROUP BY 1, 2",
    "ledger_ids": "SELECT p_partkey, 'API-' || left(sha1(concat_ws('|', p_name, p_brand, p_type, CAST(p_size AS VARCHAR))), 12) AS api_id FROM part",
    "five_state": """
        WITH g AS (SELECT l_orderkey, bool_or(l_discount > 0.09) inv, bool_and(l_returnflag = 'N') pres, bool_or(l_quantity > 45 AND l_linestatus = 'F') biz, bool_or(l_tax > 0.07) blk, bool_or(l_quantity < 3) ind,
          bool_or(l_suppkey % 11 = 0) con, bool_or(l_suppkey % 13 = 0) una, bool_or(l_partkey % 17 = 0) amb, bool_or(l_partkey % 7 = 0) trunc, bool_or(l_partkey % 5 = 0) phys, bool_or(l_quantity > 20) anyp, bool_or(l_linenumber <= 6) app, bool_and(l_returnflag <> 'R') compl FROM lineitem GROUP BY 1),
        b AS (SELECT *, blk OR (app AND NOT compl AND NOT anyp AND NOT con AND NOT pres) AS blocking FROM g)
        SELECT l_orderkey, CASE WHEN inv THEN 'not_analyzed' WHEN pres THEN 'not_impacted' WHEN biz THEN 'reachable' WHEN blocking AND NOT ind THEN 'not_analyzed' WHEN con OR una OR amb THEN 'uncertain' WHEN trunc THEN 'not_analyzed'
          WHEN phys THEN 'uncertain' WHEN blocking THEN 'not_analyzed' WHEN app AND compl THEN 'not_found_in_static_analysis' ELSE 'not_analyzed' END AS state FROM b""",
    "coverage_rollup": """
        SELECT c_mktsegment, year(o_orderdate) AS year, o_orderpriority, CASE max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) WHEN 1 THEN 'complete' WHEN 2 THEN 'partial' ELSE 'failed' END AS coverage
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "priority_score": """
        WITH g AS (SELECT event_type, user_id % 20 dep, count(DISTINCT user_id) callers, bool_or(value > 99) runtime FROM events GROUP BY 1, 2),
        s AS (SELECT dep, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END * greatest(callers, 1) * CASE WHEN runtime THEN 2 ELSE 1 END AS score FROM g),
        t AS (SELECT dep, CAST(max(score) AS BIGINT) AS top, CAST(sum(score) AS BIGINT) AS total, count(*) AS n FROM s GROUP BY 1)
        SELECT *, row_number() OVER (ORDER BY top DESC, total DESC, n DESC, dep) AS rank FROM t""",
    "occurrence_two_level": "WITH m AS (SELECT l_partkey, max(CAST(l_quantity AS BIGINT)) q FROM lineitem GROUP BY l_partkey, l_suppkey, l_returnflag) SELECT l_partkey, CAST(sum(q) AS BIGINT) AS occurrences FROM m GROUP BY 1",
    "reason_histogram": "WITH g AS (SELECT event_type, count(*) n FROM events GROUP BY 1) SELECT *, row_number() OVER (ORDER BY n DESC, event_type) AS rank FROM g",
    "sample_topk": "WITH o AS (SELECT o_orderpriority, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY cents DESC, o_orderkey) AS rank FROM o QUALIFY rank <= 20",
    "module_rollup": "SELECT source, lang, count(DISTINCT text) AS n_apis FROM documents GROUP BY 1, 2",
    "scale_ratio": "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) n FROM orders GROUP BY 1), p AS (SELECT *, lag(n) OVER (ORDER BY month) AS previous FROM m) SELECT *, n * 2 > previous * 5 AS steep, (SELECT CAST(median(n) AS DOUBLE) FROM m) AS median FROM p",
    "topology_flags": "SELECT l_suppkey, bool_or(l_returnflag = 'R') AS returned, bool_or(l_linestatus = 'O' AND l_quantity >= 50) AS large_open, bool_and(l_discount < 0.1) AS all_below, count(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY 1",
    "status_pivot": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
    "fail_closed": """
        WITH j AS (SELECT doc_id, n_chars > 1500 AS r, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS ok FROM documents)
        SELECT doc_id, CASE WHEN r AND NOT ok THEN 'not_analyzed' WHEN r THEN 'reachable' ELSE 'uncertain' END AS state, CASE WHEN r AND NOT ok THEN 'EVIDENCE_IDENTITY_MISMATCH' END AS reason FROM j""",
}
