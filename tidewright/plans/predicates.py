"""Queries on row rules: each rule applied to columns of the driver tables that stand for its inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import canonical_reason
from ..operators import rules
from ..sources.tables import table

_STATES = ["reachable", "uncertain", "not_analyzed", "not_found_in_static_analysis", "not_impacted"]
_TECH = {"plain": ("ECONOMY", "STANDARD"), "promo": ("PROMO",), "xl": ("XL", "LARGER")}
_RULES = [("internal", "warn", r"\bthe\s+of\b"), ("reflect", "info", r"@[a-z0-9]+\."), ("flags", "warn", r"[0-9]{5}"), ("serial", "info", r"licen[cs]e")]


def change_enrich(spark, d):
    severity, confirmed = F.concat(F.lit("P"), (F.col("o_orderkey") % 4).cast("string")), F.when(F.col("o_orderstatus") == "F", "false")
    source, reason, flags = F.when(F.col("o_orderpriority") == "5-LOW", "Changelog"), F.when(F.col("o_orderkey") % 7 == 0, "LATE"), F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", rules.conclusion(severity, confirmed, source).alias("conclusion"), rules.review_reason(severity, confirmed, source, reason, flags).alias("review_reason"))


def change_rows(spark, d):
    k = F.col("p_partkey")
    v = lambda a, b: F.concat((k % a).cast("string"), F.lit("."), (k % b).cast("string"))
    scope = F.when(k % 5 == 0, "test").when(k % 5 == 1, "compile")
    row = rules.change_row(F.when(k % 13 != 0, v(3, 4)), F.when(k % 17 != 0, v(3, 8)), F.col("p_brand"), F.col("p_type"), scope, k % 19 != 0, F.when(k % 23 == 0, "ambiguous"))
    return table(spark, d, "part").select("p_partkey", row.alias("r")).select("p_partkey", "r.*")


def rule_scan(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    hit = rules.rule_hits(lines, spark.createDataFrame(_RULES, "rule string, level string, pattern string"))
    return hit.groupBy("rule", "level").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def receiver_proof(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    return rules.proved_calls(files, r"\bthe ([a-z]+)", r"\b([a-z]+)\.", ("ed",)).groupBy("path").agg(F.count("*").alias("calls"), F.count_if(F.col("proof") == "always").alias("always"), F.countDistinct("receiver").alias("receivers"))


def scope_filter(spark, d):
    scope = F.when(F.col("event_type") == "click", "Test ").when(F.col("event_type") != "view", F.col("event_type"))
    return table(spark, d, "events").where(rules.in_scope(scope)).groupBy("event_type").agg(F.count("*").alias("n"))


def scope_selection(spark, d):
    chosen, missed = rules.select_scope(table(spark, d, "part"), "p_brand", "p_type", ["brand#11", "Brand#99"], ["promo ", "nothing"], strict=False)
    chosen = chosen.select(F.col("p_partkey").cast("string").alias("found"), F.lit("selected").alias("kind"))
    return chosen.unionByName(missed.select(F.col("selector").alias("found"), F.lit("unmatched").alias("kind")))


def high_risk_rows(spark, d):
    severity, change = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" p"), (F.col("o_orderkey") % 4).cast("string"))), F.when(F.col("o_orderstatus") == "F", "Removed").otherwise("added")
    return table(spark, d, "orders").select("o_orderkey", rules.high_risk(severity, change).alias("high_risk"))


def edge_admission(spark, d):
    owner = F.when(F.col("l_linenumber") % 3 == 0, "Simple").otherwise("a.B")
    why = rules.admission(owner, F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.col("l_linestatus") == "F")
    return table(spark, d, "lineitem").groupBy(F.coalesce(why, F.lit("ADMITTED")).alias("verdict")).agg(F.count("*").alias("n"))


def _keys():
    k = F.col("p_partkey")
    name = F.concat(F.translate(F.col("p_type"), " ", "."), F.lit("$"), F.translate(F.col("p_brand"), "#", "."))
    return F.when(k % 4 == 0, F.concat(F.lit("method:"), name)).when(k % 4 == 1, F.concat(F.lit("class:"), F.split(name, r"\.")[0])).when(k % 4 == 2, F.concat(F.lit("class:"), name)).otherwise(name)


def precise_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", rules.precise_key(_keys()).alias("precise"))


def package_members(spark, d):
    name = F.concat("p_type", F.lit("."), F.translate("p_brand", "#", "."), F.lit("$m(int)"))
    return table(spark, d, "part").select("p_partkey", rules.in_package(name, F.lit("PROMO.Brand.*")).alias("promo"), rules.in_package(name, F.lit("PROMO.Brand.1")).alias("first"), rules.in_package(name, F.col("p_type")).alias("own"), rules.in_package(name, F.lit(" ")).alias("blank"))


def module_scopes(spark, d):
    k = F.col("p_partkey")
    coord = F.when(k % 6 == 0, "__business__").when(k % 6 < 4, F.concat(F.lit("g:"), F.col("p_brand")))
    scope = rules.module_scope(coord, k % 4 == 1, F.when(k % 8 == 1, "reactor_coordinate_and_final_artifact_entry"), F.concat(F.lit("g:"), F.col("p_brand")), F.lit("lib/x.jar"), F.sha2(F.col("p_type"), 256))
    return table(spark, d, "part").select("p_partkey", scope.alias("scope"))


def _state(k):
    return F.element_at(F.array(*map(F.lit, _STATES)), (k % 5 + 1).cast("int"))


def user_outcome(spark, d):
    k = F.col("event_id")
    reason = F.when(k % 7 == 0, "behaviorChanged runtime-verification").when(k % 7 == 1, "unresolved_dependency_coordinates_after_enrichment").when(k % 7 == 2, F.col("event_type"))
    e = table(spark, d, "events").select("event_id", rules.outcome(_state(k), reason).alias("bucket"), canonical_reason(reason).alias("reason"))
    return e.groupBy("bucket", "reason").agg(F.count("*").alias("n"))


def uncertainty_kind(spark, d):
    k = F.col("event_id")
    kind = rules.uncertainty(_state(k), F.when(k % 3 == 0, F.array(F.lit(" "), F.col("event_type"))), F.when(k % 4 == 0, F.array(F.lit(""))))
    return table(spark, d, "events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def constant_impacts(spark, d):
    l = table(spark, d, "lineitem")
    change = F.when(F.col("l_returnflag") == "N", "constant_value_changed").when(F.col("l_returnflag") == "A", "removed")
    r = rules.constant_impact(change, F.col("l_linenumber") % 2 == 0, F.col("l_linestatus") == "F", F.col("l_quantity") > 40, F.col("l_discount") < 0.08)
    return l.select(r.alias("r")).groupBy(F.col("r.compile").alias("compile"), F.col("r.runtime").alias("runtime")).agg(F.count("*").alias("n"))


def tech_detect(spark, d):
    return rules.tech_flags(table(spark, d, "part"), ["p_brand"], "p_type", _TECH)


def jdk_precedence(spark, d):
    k = F.col("o_orderkey")
    r = rules.jdk_evidence(F.when(k % 5 == 0, "21"), F.when(k % 3 == 0, (k % 4 + 8).cast("string")), F.when(k % 2 == 0, (k % 3 + 8).cast("string")))
    return table(spark, d, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", "r.*")


def class_releases(spark, d):
    magic = F.when(F.col("p_partkey") % 9 != 0, "CAFEBABE").otherwise("CAFEBABF")
    content = F.unhex(F.concat(magic, F.lit("0000"), F.lpad(F.hex(F.col("p_size") + 30), 4, "0")))
    return table(spark, d, "part").select("p_partkey", rules.class_major(content).cast("bigint").alias("major"), rules.java_release(rules.class_major(content)).cast("bigint").alias("release"))


def impact_buckets(spark, d):
    l = table(spark, d, "lineitem")
    status = F.when(F.col("l_linenumber") == 7, "odd").otherwise(_state(F.col("l_partkey")))
    return l.groupBy("l_orderkey").agg(rules.best_bucket(status).alias("bucket"))


def contract_checks(spark, d):
    o = table(spark, d, "orders")
    checks = {"STATUS": F.col("o_orderstatus").isin("F", "O"), "PRICE": F.col("o_totalprice") < 300000, "OWNER": F.col("o_custkey") % 10 != 0}
    return rules.diagnostics(o, "o_orderkey", "orders", checks)


QUERIES = {f.__name__: f for f in (change_enrich, change_rows, rule_scan, receiver_proof, scope_filter, scope_selection, high_risk_rows, edge_admission, precise_keys, package_members, module_scopes, user_outcome, uncertainty_kind, constant_impacts, tech_detect, jdk_precedence, class_releases, impact_buckets, contract_checks)}

_S = "CASE {0} % 5 WHEN 0 THEN 'reachable' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'not_analyzed' WHEN 3 THEN 'not_found_in_static_analysis' ELSE 'not_impacted' END"
SQL = {
    "change_enrich": """
        WITH o AS (SELECT o_orderkey, 'P' || (o_orderkey % 4) sev, o_orderstatus = 'F' unsure, o_orderpriority = '5-LOW' log, o_orderkey % 7 = 0 late, CASE WHEN o_orderkey % 11 = 0 THEN o_orderstatus END fl FROM orders)
        SELECT o_orderkey, CASE WHEN sev = 'P0' THEN 'high_risk' WHEN sev = 'P1' THEN 'watch' WHEN unsure OR log THEN 'review' ELSE 'fact' END AS conclusion,
          coalesce(nullif(concat_ws('; ', CASE WHEN sev IN ('P0', 'P1') THEN 'severity ' || sev END, CASE WHEN unsure THEN 'not confirmed by binary comparison' END, CASE WHEN log THEN 'from a changelog' END, CASE WHEN late THEN 'reason LATE' END, 'flags ' || fl), ''), 'recorded as a fact') AS review_reason FROM o""",
    "change_rows": """
        WITH p AS (SELECT p_partkey k, p_brand <> p_type differs, k % 3 ma, k % 4 a, k % 8 b, k % 13 = 0 noold, k % 17 = 0 nonew, k % 19 <> 0 AND k % 23 <> 0 settled FROM part),
        c AS (SELECT *, settled AND NOT noold AND NOT nonew AND a = b AND differs AS bytes FROM p),
        v AS (SELECT *, CASE WHEN NOT settled THEN 'unresolved' WHEN bytes THEN 'changed' WHEN noold THEN 'added' WHEN nonew THEN 'removed' WHEN a = b THEN 'unchanged' WHEN b < a THEN 'downgrade' ELSE 'minor' END change FROM c),
        r AS (SELECT *, CASE change WHEN 'unresolved' THEN 'confirm' WHEN 'changed' THEN 'confirm' WHEN 'added' THEN 'pending' WHEN 'removed' THEN 'pending' WHEN 'unchanged' THEN 'verify' WHEN 'downgrade' THEN 'high' ELSE 'medium' END risk FROM v)
        SELECT k AS p_partkey, change, CASE WHEN risk = 'high' AND k % 5 = 0 THEN 'low' ELSE risk END AS risk, concat_ws(';', CASE WHEN bytes THEN 'same_version_artifact_content_changed' END, CASE WHEN k % 23 = 0 THEN 'pairing:ambiguous' END) AS remark,
          CASE WHEN settled THEN 'resolved' ELSE 'unresolved' END AS status FROM r""",
    "rule_scan": r"""
        WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), r(rule, level, pattern) AS (VALUES ('internal', 'warn', '\bthe\s+of\b'), ('reflect', 'info', '@[a-z0-9]+\.'), ('flags', 'warn', '[0-9]{5}'), ('serial', 'info', 'licen[cs]e'))
        SELECT rule, level, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM s JOIN r ON regexp_matches(line, '(?i)' || pattern) GROUP BY 1, 2""",
    "receiver_proof": r"""
        WITH f AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\bthe ([a-z]+)', 1)) names, unnest(string_split(text, chr(10))) line FROM documents),
        c AS (SELECT doc_id, names, unnest(regexp_extract_all(line, '\b([a-z]+)\.', 1)) receiver FROM f)
        SELECT doc_id AS path, count(*) AS calls, count(*) FILTER (WHERE receiver = 'ed') AS always, count(DISTINCT receiver) AS receivers FROM c WHERE receiver = 'ed' OR list_contains(names, receiver) GROUP BY 1""",
    "scope_filter": "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1",
    "scope_selection": """
        SELECT CAST(p_partkey AS VARCHAR) AS found, 'selected' AS kind FROM part WHERE lower(p_brand) IN ('brand#11', 'brand#99') OR lower(p_type) IN ('promo', 'nothing')
        UNION ALL SELECT s, 'unmatched' FROM (VALUES ('brand#11', 1), ('brand#99', 1), ('promo', 2), ('nothing', 2)) v(s, k) WHERE NOT EXISTS (SELECT 1 FROM part WHERE (k = 1 AND lower(p_brand) = s) OR (k = 2 AND lower(p_type) = s))""",
    "high_risk_rows": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 < 2 ELSE o_orderstatus = 'F' END AS high_risk FROM orders",
    "edge_admission": "SELECT CASE WHEN l_linestatus <> 'F' THEN 'ADMITTED' WHEN l_linenumber % 3 = 0 THEN 'OWNER_UNQUALIFIED' WHEN l_returnflag = 'N' THEN 'SIGNATURE_MISSING' ELSE 'ADMITTED' END AS verdict, count(*) AS n FROM lineitem GROUP BY 1",
    "precise_keys": "SELECT p_partkey, p_partkey % 4 >= 2 AS precise FROM part",
    "package_members": "SELECT p_partkey, p_type = 'PROMO' AS promo, p_type = 'PROMO' AND p_brand = 'Brand#1' AS first, true AS own, false AS blank FROM part",
    "module_scopes": """
        SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'business_classes' WHEN p_partkey % 4 = 1 THEN CASE WHEN p_partkey % 8 = 1 AND p_partkey % 6 < 4 THEN 'internal_module' ELSE 'unknown' END WHEN p_partkey % 6 < 4 THEN 'external_dependency' ELSE 'unknown' END AS scope FROM part""",
    "user_outcome": f"""
        WITH e AS (SELECT {_S.format('event_id')} st, CASE event_id % 7 WHEN 0 THEN 'BEHAVIOR_CHANGED_RUNTIME_VERIFICATION' WHEN 1 THEN 'DEPENDENCY_COORDINATES_UNRESOLVED' WHEN 2 THEN upper(event_type) ELSE 'UNKNOWN' END reason FROM events)
        SELECT CASE WHEN st = 'reachable' THEN 'confirmed_impact' WHEN st = 'not_impacted' THEN 'confirmed_no_impact' WHEN reason = 'DEPENDENCY_COORDINATES_UNRESOLVED' THEN 'input_required' WHEN reason = 'BEHAVIOR_CHANGED_RUNTIME_VERIFICATION' THEN 'probable_impact' ELSE 'inconclusive' END AS bucket,
          reason, count(*) AS n FROM e GROUP BY 1, 2""",
    "uncertainty_kind": "SELECT CASE WHEN event_id % 5 <> 1 THEN '' WHEN event_id % 3 = 0 THEN 'candidate_evidence' ELSE 'analysis_limitation' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "constant_impacts": """
        WITH l AS (SELECT l_returnflag f, l_linenumber % 2 = 0 had, l_linestatus = 'F' ref, l_quantity > 40 link, l_discount < 0.08 ok FROM lineitem)
        SELECT CASE WHEN NOT ok THEN 'unverified' WHEN NOT ref THEN 'source_reference_absent' WHEN f = 'N' THEN 'recompile_value_change' WHEN f = 'A' THEN 'recompile_break' ELSE 'recompile_review_required' END AS compile,
          CASE WHEN link THEN 'runtime_link_present' WHEN NOT ok THEN 'unverified' WHEN had AND ref THEN CASE WHEN f = 'N' THEN 'inlined_old_value' ELSE 'inlined_no_link' END ELSE 'runtime_link_absent' END AS runtime, count(*) AS n FROM l GROUP BY 1, 2""",
    "tech_detect": "SELECT p_brand, bool_or(starts_with(p_type, 'ECONOMY') OR starts_with(p_type, 'STANDARD')) AS plain, bool_or(starts_with(p_type, 'PROMO')) AS promo, false AS xl FROM part GROUP BY 1",
    "jdk_precedence": """
        WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '21' END c, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 4 + 8 AS VARCHAR) END a, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 3 + 8 AS VARCHAR) END b FROM orders)
        SELECT o_orderkey, coalesce(c, a, b) AS version, CASE WHEN c IS NOT NULL THEN 'user_confirmed' WHEN a IS NOT NULL THEN 'final_artifact_bytecode' WHEN b IS NOT NULL THEN 'build_model' ELSE 'not_found' END AS source,
          CASE WHEN c IS NOT NULL THEN 'confirmed' WHEN a IS NOT NULL THEN 'high' WHEN b IS NOT NULL THEN 'medium' ELSE 'none' END AS confidence, coalesce(a <> b, false) AS conflict FROM o""",
    "class_releases": "SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size + 30 AS BIGINT) END AS major, CASE WHEN p_partkey % 9 <> 0 AND p_size + 30 BETWEEN 45 AND 65 THEN CAST(p_size - 14 AS BIGINT) END AS release FROM part",
    "impact_buckets": """
        SELECT l_orderkey, CASE min(CASE WHEN l_linenumber = 7 THEN 4 WHEN l_partkey % 5 = 0 THEN 0 WHEN l_partkey % 5 IN (1, 2) THEN 1 WHEN l_partkey % 5 = 4 THEN 2 ELSE 3 END) WHEN 0 THEN 'confirmed' WHEN 1 THEN 'review' WHEN 2 THEN 'not_impacted' WHEN 3 THEN 'not_found' ELSE 'unknown' END AS bucket FROM lineitem GROUP BY 1""",
    "contract_checks": """
        SELECT 'orders' AS artifact, CAST(o_orderkey AS VARCHAR) AS key, 'STATUS' AS code FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'PRICE' FROM orders WHERE o_totalprice >= 300000
        UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'OWNER' FROM orders WHERE o_custkey % 10 = 0""",
}
