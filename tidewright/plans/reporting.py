"""Queries on decisions, rollups and traces: orders stand for targets, order lines for paths and findings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import core, graph, reports
from ..sources.tables import table
from .dependencies import LINE

_SEV = ("P0", "P1", "P2", "P3")


def _state():
    k = F.col("l_partkey") % 5
    return F.element_at(F.array(*map(F.lit, reports.STATUS_ORDER)), (k + 1).cast("int"))


def five_state_reason(spark, d):
    l = table(spark, d, "lineitem").withColumn("target", F.col("l_orderkey")).withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE)))
    paths = l.where("l_linenumber <= 3 AND l_quantity > 12").select(
        "target", F.col("seq").alias("path_seq"), F.when(F.col("l_suppkey") % 3 == 0, "business").when(F.col("l_suppkey") % 3 == 1, "internal").otherwise("external").alias("scope"), (F.col("l_partkey") % 3).alias("depth"),
        (F.col("l_tax") > 0.01).alias("complete"), (F.col("l_discount") > 0.07).alias("ambiguous"), (F.col("l_linestatus") == "O").alias("truncated"), (F.col("l_returnflag") != "R").alias("activated"), (F.col("l_partkey") % 2 == 0).alias("semantic"),
        F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("R"), (F.col("l_partkey") % 4).cast("string"))).alias("reason"), 
        F.when(F.col("l_suppkey") % 7 < 2, F.element_at(F.array(*map(F.lit, reports.ENTRY_CLAIMS)), (F.col("l_suppkey") % 7 + 1).cast("int"))).when(F.col("l_suppkey") % 7 < 6, F.concat(F.lit("STOP"), F.col("seq").cast("string"))).alias("stop_reason"),
    )
    failures = l.where("l_linenumber = 4").select("target", F.when(F.col("l_quantity") < 5, "input-validation").when(F.col("l_quantity") < 20, "coverage").otherwise("scan").alias("stage"), F.concat(F.lit("F"), (F.col("l_suppkey") % 5).cast("string")).alias("reason"), (F.col("l_quantity") < 30).alias("blocking"))
    concerns = l.where("l_linenumber = 5 AND l_quantity > 25").select("target", (F.col("l_partkey") % 7).alias("rank"), F.concat(F.lit("C"), (F.col("l_suppkey") % 3).cast("string")).alias("reason"))
    coverage = l.where("l_linenumber <> 6").select("target", F.when(F.col("l_discount") < 0.02, "partial").when(F.col("l_discount") < 0.04, "not_applicable").otherwise("complete").alias("status"))
    return reports.decide(paths, failures, concerns, coverage, l.where("l_linenumber = 7 AND l_quantity > 30").select("target"), l.select("target"))


def trace_policy(spark, d):
    """Paths from parts up to customers and nations, with the stop policy: customers whose key ends in 7 are code of the platform, some orders tests."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    conf = F.when(F.col("l_returnflag") == "N", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    no = F.lit(False)
    lines = table(spark, d, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.min("l_returnflag").alias("l_returnflag"))
    edges = lines.select(key("P", "l_partkey").alias("callee"), key("O", "l_orderkey").alias("caller"), conf.alias("confidence"), no.alias("system"), (F.col("l_orderkey") % 10 == 0).alias("boundary"), (F.col("l_orderkey") % 8 == 0).alias("test"), no.alias("entry"))
    o = table(spark, d, "orders")
    edges = edges.unionByName(o.select(key("O", "o_orderkey").alias("callee"), key("C", "o_custkey").alias("caller"), F.when(F.col("o_orderstatus") == "P", "low").otherwise("high").alias("confidence"), (F.col("o_custkey") % 10 == 7).alias("system"), no.alias("boundary"), no.alias("test"), no.alias("entry")))
    c = table(spark, d, "customer")
    edges = edges.unionByName(c.select(key("C", "c_custkey").alias("callee"), key("N", "c_nationkey").alias("caller"), F.lit("medium").alias("confidence"), no.alias("system"), no.alias("boundary"), no.alias("test"), (F.col("c_nationkey") < 12).alias("entry")))
    seeds = table(spark, d, "part").select(key("P", "p_partkey").alias("seed"))
    got = graph.traced(edges, seeds, 6)
    return got.groupBy("stop", F.size("path").cast("bigint").alias("nodes"), "cost").agg(F.count("*").alias("n"), F.countDistinct("seed").alias("seeds"))


def scope_chains(spark, d):
    """Chains of all parts of a scope (a brand), traced at once, as text."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = table(spark, d, "lineitem").select(key("O", "l_orderkey").alias("caller"), key("P", "l_partkey").alias("callee")).unionByName(table(spark, d, "orders").select(key("C", "o_custkey").alias("caller"), key("O", "o_orderkey").alias("callee"))).distinct()
    seeds = table(spark, d, "part").where("p_brand = 'Brand#3'").select(key("P", "p_partkey").alias("seed"))
    return graph.paths(e, seeds, 2).select(F.array_join(F.reverse("path"), " → ").alias("chain")).distinct()


def topo_levels(spark, d):
    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    e = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("before"), (F.col("l_suppkey") % 40 + F.col("l_linenumber") * 9).alias("after"))
    return graph.topological(n, e).select("node", F.col("level").cast("bigint").alias("level"))


def analysis_statuses(spark, d):
    o = table(spark, d, "orders")
    deps = table(spark, d, "customer").select(F.col("c_custkey").alias("coord"))
    binary = o.where("o_orderstatus <> 'P' AND o_custkey % 4 <> 0").select(F.col("o_custkey").alias("coord"), F.when(F.col("o_orderkey") % 6 == 0, "ok").otherwise(F.concat(F.lit("ERR_"), F.col("o_orderstatus"))).alias("outcome"), (F.col("o_orderkey") % 9).alias("apis"))
    diff = o.where("o_orderpriority < '3' AND o_custkey % 3 = 0").select(F.col("o_custkey").alias("coord"), F.when(F.col("o_orderkey") % 40 == 0, F.col("o_orderkey") % 5).otherwise(0).alias("rows"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("NO_REF")).alias("skipped"))
    return reports.analysis_status(deps, binary, diff)


def dep_representatives(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_suppkey") % 25).alias("coord"), _state().alias("status"), F.concat(F.lit("P"), (F.col("l_linenumber") % 5).cast("string")).alias("severity"), (F.col("l_quantity") % 4).cast("int").alias("depth"), F.concat(F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string"), F.lit("/"), F.col("l_extendedprice").cast("string")).alias("name"))
    got = reports.representatives(l.distinct(), "coord", "status", "severity", "depth", "name")
    return got.select("coord", "name", "status", F.col("rank").cast("bigint").alias("rank"))


def module_paths(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 5 != 0, F.concat(F.lit("w\\mod"), (k % 7).cast("string"), F.lit("\\"))).otherwise(""), F.lit("src/main/"), F.when(k % 3 == 0, "kotlin").when(k % 3 == 1, "java").otherwise("resources"), F.lit("/a/B.x"))
    m = table(spark, d, "part").select("p_brand", reports.module_of(path).alias("module"))
    return m.where("module <> ''").groupBy("module").agg(F.countDistinct("p_brand").alias("apis"))


def result_merge(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("api"), _state().alias("status"), F.when(F.col("l_suppkey") % 5 < 4, F.concat(F.lit("v"), (F.col("l_partkey") % 500 % 3 + (F.col("l_orderkey") % 40 == 0).cast("int")).cast("string"))).otherwise(" ").alias("version"))
    return reports.merge_results(l, ["api"], "status", "version")


def dep_conclusion(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("coord"), F.when(F.col("o_orderkey") % 29 == 0, "reachable").when(F.col("o_orderkey") % 13 == 0, "uncertain").otherwise("not_impacted").alias("status"), (F.col("o_orderkey") % 31 != 0).alias("whole"))
    return reports.dependency_conclusion(o, "coord", "status", F.col("whole"))


def coverage_na(spark, d):
    s = F.when(F.col("o_orderkey") % 3 != 0, "not_applicable").when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "partial").otherwise("failed")
    return table(spark, d, "orders").groupBy("o_custkey").agg(reports.worst_coverage(s).alias("coverage"))


def api_coverages(spark, d):
    apis = table(spark, d, "part").select(F.col("p_partkey").alias("api"))
    failures = table(spark, d, "lineitem").where("l_quantity > 46").select(F.col("l_partkey").alias("api"), F.concat(F.lit("E"), F.col("l_linenumber").cast("string")).alias("reason"), (F.col("l_returnflag") == "R").alias("blocking"))
    return reports.api_coverage(apis, failures)


def reason_guidance(spark, d):
    return reports.guidance(table(spark, d, "events"), "event_type", "user_id")


def data_contract_diff(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("owner"), (F.col("l_partkey") % 60).alias("field"), F.col("l_returnflag"), F.year("l_shipdate").alias("y"))
    side = lambda y: l.where(F.col("y") == y).groupBy("owner", "field").agg(F.max("l_returnflag").alias("type"))
    got = reports.contract_diff(side(1999), side(2000), l.where("owner % 3 = 0").select("owner"))
    return got.groupBy("owner", "change").agg(F.count("*").alias("n"))


def class_versions(spark, d):
    p = table(spark, d, "part").withColumn("major", (F.col("p_size") + 40).cast("bigint"))
    return reports.max_class_versions(p, "p_brand", "major", F.col("p_type") == "PROMO")


def needles(spark, d):
    docs = table(spark, d, "documents")
    return reports.first_needles(docs, "source", "doc_id", {"address": F.col("text").contains("@"), "licence": F.col("text").contains("licensed"), "never": F.col("text").contains("\u0001"), "digits": F.col("text").rlike("[0-9]{6}")})


def topology_cover(spark, d):
    return reports.topology_coverage(table(spark, d, "events"), "event_type", ["click", "error", "proxy"], ["click", "view"], "discovery")


def step_summaries(spark, d):
    return reports.step_summary(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def signal_rollups(spark, d):
    s = table(spark, d, "events").select("event_type", F.concat(F.lit("P"), (F.col("user_id") % 3 + F.length("event_type") % 2).cast("string")).alias("severity"))
    return reports.signal_rollup(s, "event_type", "severity", _SEV)


def ledger_rank(spark, d):
    l = table(spark, d, "lineitem")
    seq = F.struct(*[F.col(c) for c in l.columns])
    rows = l.select(_state().alias("status"), F.concat(F.lit("P"), (F.col("l_linenumber") % 6).cast("string")).alias("severity"), F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey")).alias("coord"), F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("path_id"), seq.alias("seq"))
    got = core.global_rank(rows, reports.ledger_order())
    return got.select(F.col("path_id").alias("l_orderkey"), "symbol", F.col("seq.l_linenumber").cast("bigint").alias("l_linenumber"), "rank")


def _chains(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("target"), "event_type", F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 2).cast("string")).otherwise("").alias("a"), F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 3).cast("string")).otherwise("").alias("b"), "event_id")
    return e.select("target", F.col("event_type").alias("skeleton"), F.array("a", "b").alias("signatures"), F.col("event_id").alias("seq"))


def path_variant_colouring(spark, d):
    return reports.logical_paths(_chains(spark, d), "target", "skeleton", "signatures")


def chain_merge(spark, d):
    got = reports.merged_chains(_chains(spark, d), "target", "skeleton", "signatures", "seq")
    return got.select("target", "skeleton", F.array_join("signatures", ",").alias("signatures"), "seq")


QUERIES = {f.__name__: f for f in (five_state_reason, trace_policy, scope_chains, topo_levels, analysis_statuses, dep_representatives, module_paths, result_merge, dep_conclusion, coverage_na, api_coverages, reason_guidance, data_contract_diff, class_versions, needles, topology_cover, step_summaries, signal_rollups, ledger_rank, path_variant_colouring, chain_merge)}

_STATE = "CASE l_partkey % 5 WHEN 0 THEN 'reachable' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'not_analyzed' WHEN 3 THEN 'not_impacted' ELSE 'not_found_in_static_analysis' END"
SQL = {
    "five_state_reason": f"""
        WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE)}) seq FROM lineitem), p AS (SELECT l_orderkey t, seq, l_suppkey % 3 = 0 biz, greatest(l_partkey % 3, 1) depth, l_tax > 0.01 complete, l_discount > 0.07 amb, l_linestatus = 'O' trunc, l_returnflag <> 'R' AND (l_partkey % 2 = 0 OR l_suppkey % 7 > 1) act, l_partkey % 2 = 0 sem, CASE l_suppkey % 7 WHEN 0 THEN 'RUNTIME_FRAMEWORK_ENTRY_REACHED' WHEN 1 THEN 'RUNTIME_DEPENDENCY_ENTRY_REACHED' WHEN 6 THEN 'EVIDENCE_PATH_TRUNCATED' ELSE 'STOP' || seq END st,
          CASE WHEN l_partkey % 4 <> 0 THEN 'R' || (l_partkey % 4) END reason FROM n WHERE l_linenumber <= 3 AND l_quantity > 12),
        q AS (SELECT t, count(*) FILTER (WHERE biz AND NOT amb AND NOT trunc AND depth = 1) dc, min(depth) FILTER (WHERE biz AND NOT amb AND NOT trunc) reach, bool_or(biz AND NOT amb AND NOT trunc AND complete AND act) sound,
          min_by(reason, seq) FILTER (WHERE biz AND NOT amb AND NOT trunc AND complete AND act AND reason IS NOT NULL) sr, bool_or(biz AND NOT amb AND NOT trunc AND complete AND sem) indep, bool_or(NOT act) unact, bool_or(amb) amb, bool_or(trunc) trunc, min_by(st, seq) FILTER (WHERE trunc) stop, bool_or(NOT biz) phys, min_by(reason, seq) FILTER (WHERE NOT biz AND reason IS NOT NULL) pr, bool_or(biz AND NOT amb AND NOT trunc AND complete AND act AND st = 'RUNTIME_FRAMEWORK_ENTRY_REACHED') fw FROM p GROUP BY 1),
        f AS (SELECT l_orderkey t, min(struct_pack(b := CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 20 THEN 2 ELSE 1 END, s := CASE WHEN l_quantity < 5 THEN 'input-validation' WHEN l_quantity < 20 THEN 'coverage' ELSE 'scan' END, r := 'F' || (l_suppkey % 5))) f FROM lineitem WHERE l_linenumber = 4 AND l_quantity < 30 GROUP BY 1),
        c AS (SELECT l_orderkey t, min(struct_pack(k := l_partkey % 7, r := 'C' || (l_suppkey % 3))) c FROM lineitem WHERE l_linenumber = 5 AND l_quantity > 25 GROUP BY 1),
        v AS (SELECT l_orderkey t, count(*) FILTER (WHERE NOT (l_discount >= 0.02 AND l_discount < 0.04)) app, count(*) FILTER (WHERE l_discount < 0.02) op FROM lineitem WHERE l_linenumber <> 6 GROUP BY 1),
        k AS (SELECT DISTINCT l_orderkey t FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 30),
        a AS (SELECT u.t, q.* EXCLUDE (t), f.f, c.c, coalesce(app, 0) app, coalesce(op, 0) op, k.t IS NOT NULL kept FROM (SELECT DISTINCT l_orderkey t FROM lineitem) u LEFT JOIN q ON q.t = u.t LEFT JOIN f ON f.t = u.t LEFT JOIN c ON c.t = u.t LEFT JOIN v ON v.t = u.t LEFT JOIN k ON k.t = u.t),
        b AS (SELECT *, f IS NOT NULL OR (op > 0 AND dc IS NULL AND c IS NULL AND NOT kept) blocked, coalesce(f.r, 'INCOMPLETE_EVIDENCE_COVERAGE') br FROM a),
        r AS (SELECT t, dc, reach, CASE WHEN f.b = 0 THEN 'not_analyzed|' || f.r WHEN kept THEN 'not_impacted|API_PRESERVED' WHEN sound THEN 'reachable|' || coalesce(sr, CASE WHEN fw THEN 'RUNTIME_FRAMEWORK_ENTRY_REACHED' ELSE 'BUSINESS_ARTIFACT_BYTECODE_USAGE' END) WHEN blocked AND NOT coalesce(indep, false) THEN 'not_analyzed|' || br WHEN c IS NOT NULL THEN 'uncertain|' || c.r
          WHEN unact THEN 'uncertain|FRAMEWORK_ACTIVATION_UNPROVEN' WHEN amb THEN 'uncertain|UNQUALIFIED_SIGNATURE_TYPE_AMBIGUOUS' WHEN trunc THEN 'not_analyzed|' || stop WHEN phys THEN 'uncertain|' || coalesce(pr, 'PACKAGED_DEPENDENCY_BYTECODE_USAGE') WHEN blocked THEN 'not_analyzed|' || br
          WHEN app > 0 AND op = 0 THEN 'not_found_in_static_analysis|NO_STATIC_PATH' ELSE 'not_analyzed|INCOMPLETE_EVIDENCE' END x FROM b)
        SELECT t AS target, string_split(x, '|')[1] AS status, string_split(x, '|')[2] AS reason, coalesce(dc, 0) AS direct_callers, CAST(coalesce(reach, 0) AS BIGINT) AS business_reach_depth FROM r""",
    "scope_chains": """
        WITH e AS (SELECT DISTINCT 'O' || l_orderkey a, 'P' || l_partkey b FROM lineitem), s AS (SELECT 'P' || p_partkey p FROM part WHERE p_brand = 'Brand#3')
        SELECT DISTINCT a || ' → ' || p AS chain FROM s JOIN e ON b = p UNION SELECT 'C' || o_custkey || ' → ' || a || ' → ' || p FROM s JOIN e ON b = p JOIN orders ON a = 'O' || o_orderkey""",
    "analysis_statuses": """
        WITH b AS (SELECT o_custkey c, count(*) n, count(*) FILTER (WHERE o_orderkey % 6 <> 0) bad, CAST(sum(CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 9 ELSE 0 END) AS BIGINT) apis, list(DISTINCT 'ERR_' || o_orderstatus) FILTER (WHERE o_orderkey % 6 <> 0) why FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 4 <> 0 GROUP BY 1),
        g AS (SELECT o_custkey c, CAST(sum(CASE WHEN o_orderkey % 40 = 0 THEN o_orderkey % 5 ELSE 0 END) AS BIGINT) r, list(DISTINCT 'NO_REF') FILTER (WHERE o_orderkey % 5 = 0) sk FROM orders WHERE o_orderpriority < '3' AND o_custkey % 3 = 0 GROUP BY 1)
        SELECT c_custkey AS coord, CASE WHEN coalesce(n, 0) > coalesce(bad, 0) THEN 'analyzed' WHEN coalesce(r, 0) > 0 THEN 'partial' WHEN coalesce(n, 0) > 0 THEN 'failed' WHEN len(coalesce(sk, [])) > 0 THEN 'skipped' ELSE 'not_started' END AS status,
          coalesce(apis, 0) AS apis, coalesce(n, 0) AS binary_runs, coalesce(bad, 0) AS failed_runs, coalesce(r, 0) AS diff_rows, array_to_string(list_sort(list_distinct(list_concat(coalesce(why, []), coalesce(sk, [])))), '|') AS reasons
        FROM customer LEFT JOIN b ON b.c = c_custkey LEFT JOIN g ON g.c = c_custkey""",
    "dep_representatives": f"""
        WITH l AS (SELECT DISTINCT l_suppkey % 25 AS coord, {_STATE} AS status, l_linenumber % 5 sev, CAST(l_quantity % 4 AS INT) depth, lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || l_extendedprice AS name, l_partkey % 5 st FROM lineitem)
        SELECT coord, name, status, row_number() OVER (PARTITION BY coord ORDER BY st, CASE WHEN sev < 4 THEN sev ELSE 4 END, depth DESC, name) AS rank FROM l QUALIFY rank <= 20""",
    "module_paths": "SELECT 'mod' || (p_partkey % 7) AS module, count(DISTINCT p_brand) AS apis FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 2 GROUP BY 1",
    "result_merge": f"""
        WITH l AS (SELECT l_partkey % 500 AS api, {_STATE} AS status, CASE WHEN l_suppkey % 5 < 4 THEN 'v' || (l_partkey % 500 % 3 + CASE WHEN l_orderkey % 40 = 0 THEN 1 ELSE 0 END) END v FROM lineitem)
        SELECT api, status, count(*) AS n, CASE WHEN count(DISTINCT v) = 1 THEN max(v) ELSE '' END AS version FROM l GROUP BY 1, 2""",
    "dep_conclusion": """
        SELECT o_custkey AS coord, CASE WHEN bool_or(o_orderkey % 29 = 0) THEN 'affected' WHEN bool_or(o_orderkey % 13 = 0 OR o_orderkey % 31 = 0) THEN 'open' ELSE 'unaffected' END AS conclusion, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 29 = 0) AS n_reachable,
          count(*) FILTER (WHERE o_orderkey % 29 <> 0 AND o_orderkey % 13 = 0) AS n_open FROM orders GROUP BY 1""",
    "coverage_na": """
        SELECT o_custkey, CASE max(CASE WHEN o_orderkey % 3 <> 0 THEN 0 WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 3 END) WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'complete' WHEN 2 THEN 'partial' ELSE 'failed' END AS coverage FROM orders GROUP BY 1""",
    "api_coverages": """
        WITH f AS (SELECT l_partkey, bool_or(l_returnflag = 'R') b, string_agg(DISTINCT 'E' || l_linenumber, '|' ORDER BY 'E' || l_linenumber) r FROM lineitem WHERE l_quantity > 46 GROUP BY 1)
        SELECT p_partkey AS api, CASE WHEN b THEN 'failed' WHEN b IS NOT NULL THEN 'partial' ELSE 'complete' END AS coverage, coalesce(r, '') AS reasons FROM part LEFT JOIN f ON p_partkey = l_partkey""",
    "reason_guidance": """
        WITH e AS (SELECT event_type, user_id, count(*) n, row_number() OVER (PARTITION BY event_type ORDER BY user_id) k FROM events GROUP BY 1, 2)
        SELECT event_type AS reason, CAST(sum(n) AS BIGINT) AS n, count(*) AS targets, string_agg(CAST(user_id AS VARCHAR), '|' ORDER BY CAST(user_id AS VARCHAR)) FILTER (WHERE k <= 5) AS samples FROM e GROUP BY 1""",
    "data_contract_diff": """
        WITH s AS (SELECT l_suppkey % 50 AS owner, l_partkey % 60 field, year(l_shipdate) y, max(l_returnflag) ty FROM lineitem WHERE l_suppkey % 50 % 3 = 0 GROUP BY ALL), o AS (SELECT * FROM s WHERE y = 1999), n AS (SELECT * FROM s WHERE y = 2000),
        c AS (SELECT owner, CASE WHEN o.ty IS NULL THEN 'field_added' WHEN n.ty IS NULL THEN 'field_removed' WHEN o.ty <> n.ty THEN 'field_type_changed' END change FROM o FULL JOIN n USING (owner, field)) SELECT owner, change, count(*) AS n FROM c WHERE change IS NOT NULL GROUP BY 1, 2""",
    "class_versions": "SELECT p_brand, CAST(max(p_size + 40) FILTER (WHERE p_type <> 'PROMO') AS BIGINT) AS base_major, CAST(max(p_size + 40) FILTER (WHERE p_type = 'PROMO') AS BIGINT) AS versioned_major FROM part GROUP BY 1",
    "needles": """
        WITH g AS (SELECT source, min(doc_id) FILTER (WHERE contains(text, '@')) a, min(doc_id) FILTER (WHERE contains(text, 'licensed')) b, min(doc_id) FILTER (WHERE contains(text, chr(1))) c, min(doc_id) FILTER (WHERE regexp_matches(text, '[0-9]{6}')) d FROM documents GROUP BY 1)
        SELECT * FROM (SELECT source, 'address' AS risk, a AS entry FROM g UNION ALL SELECT source, 'licence', b FROM g UNION ALL SELECT source, 'never', c FROM g UNION ALL SELECT source, 'digits', d FROM g) WHERE entry IS NOT NULL""",
    "topology_cover": """
        WITH s AS (SELECT list_sort(list(DISTINCT event_type)) s FROM events) SELECT array_to_string(list_filter(['click', 'error', 'proxy'], lambda x: NOT list_contains(s, x)), '|') AS missing, array_to_string(list_filter(s, lambda x: x NOT IN ('click', 'view')), '|') AS newly_observed,
          len(list_filter(['click', 'error', 'proxy'], lambda x: NOT list_contains(s, x))) = 0 AS complete, len(list_filter(s, lambda x: x NOT IN ('click', 'view'))) > 0 AS target, len(list_filter(s, lambda x: x NOT IN ('click', 'view'))) = 0 AS rotate FROM s""",
    "step_summaries": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) AS total FROM orders GROUP BY 1",
    "signal_rollups": """
        WITH g AS (SELECT event_type, 'P' || (user_id % 3 + length(event_type) % 2) AS severity, count(*) AS n FROM events GROUP BY 1, 2) SELECT *, severity = min(severity) OVER (PARTITION BY event_type) AS worst FROM g""",
    "ledger_rank": f"""
        SELECT l_orderkey, l_partkey AS symbol, CAST(l_linenumber AS BIGINT) AS l_linenumber, row_number() OVER (ORDER BY l_partkey % 5, CASE WHEN l_linenumber % 6 < 4 THEN l_linenumber % 6 ELSE 4 END, CASE WHEN l_suppkey % 9 <> 0 THEN l_suppkey END NULLS LAST, l_partkey, l_orderkey, {', '.join(LINE)}) AS rank FROM lineitem""",
    "topo_levels": """
        WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey % 40 b, l_suppkey % 40 + l_linenumber * 9 a FROM lineitem), n AS (SELECT s_suppkey k FROM supplier), x AS (SELECT b, a FROM e WHERE b IN (SELECT k FROM n) AND a IN (SELECT k FROM n)),
        r AS (SELECT k, CAST(0 AS BIGINT) lvl FROM n UNION SELECT a, lvl + 1 FROM r JOIN x ON k = b WHERE lvl < 100) SELECT k AS node, max(lvl) AS level FROM r GROUP BY 1""",
}
