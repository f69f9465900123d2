"""Queries on resolution: the driver tables stand for artifacts (suppliers, parts), calls (order lines) and methods (orders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolve
from ..sources.tables import table


def _s(c):
    return F.col(c).cast("string")


def packaged_enrich(spark, d):
    p = table(spark, d, "part")
    file = F.concat(F.lit("a"), (F.col("p_partkey") % 300).cast("string"), F.lit("-"), F.col("p_size").cast("string"), F.lit(".jar"))
    resolved = table(spark, d, "supplier").select(F.concat(F.lit("g:"), _s("s_suppkey")).alias("coord"), F.concat(F.lit("a"), (F.col("s_suppkey") * 3 % 300).cast("string")).alias("artifact"), (F.col("s_nationkey") + 1).cast("string").alias("version"), F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("a"), (F.col("s_suppkey") % 30).cast("string"), F.lit("-7.jar"))).alias("file"))
    overrides = p.where("p_partkey % 100 = 0").select(file.alias("file"), F.lit("manual").alias("coord"))
    return resolve.enrich_packaged(p.select(file.alias("file")), resolved, overrides).withColumn("match_rank", F.col("match_rank").cast("bigint"))


def gap_fill(spark, d):
    have = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey").distinct()
    got = resolve.fill_gaps(have, table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), ["o_custkey"])
    return got.groupBy("gap").agg(F.count("*").alias("n"), F.sum("c_nationkey").cast("bigint").alias("nations"))


def provider_set(spark, d):
    l = table(spark, d, "lineitem")
    added = l.where("l_returnflag = 'R'").select((F.col("l_suppkey") % 60).alias("provider"), F.col("l_partkey").alias("member")).distinct()
    owners = l.where("l_returnflag = 'A' AND l_linenumber = 1").select((F.col("l_orderkey") % 20).alias("owner"), F.col("l_partkey").alias("member")).distinct()
    got = resolve.provider_sets(added, owners, 24)
    return got.select("owner", F.array_join("providers", ",").alias("providers"), "shared")


def overload_expand(spark, d):
    keys = table(spark, d, "part").select(F.concat(F.translate("p_brand", "#", "."), F.lit(".m"), (F.col("p_size") % 5).cast("string"), F.lit("("), (F.col("p_partkey") % 7).cast("string"), F.lit(")")).alias("key"))
    targets = table(spark, d, "part").select(F.concat(F.translate("p_brand", "#", "."), F.lit(".m"), (F.col("p_size") % 6).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("(3)")).alias("target"))
    return resolve.overload_keys(targets, keys)


def coord_resolve(spark, d):
    coords = table(spark, d, "supplier").select(F.concat(F.lit("g"), _s("s_nationkey"), F.lit(":a"), (F.col("s_suppkey") % 40).cast("string"), F.when(F.col("s_suppkey") % 3 == 0, ":x").otherwise("")).alias("coord"))
    k = F.col("c_custkey")
    query = F.when(k % 3 == 0, F.concat(F.lit("a"), (k % 60).cast("string"))).otherwise(F.concat(F.lit("g"), _s("c_nationkey"), F.lit(":a"), (k % 50).cast("string"), F.when(k % 3 == 1, ":x").otherwise("")))
    return resolve.resolve_coords(table(spark, d, "customer").select(query.alias("query")), coords)


def indirect_match(spark, d):
    p = table(spark, d, "part")
    targets = p.select(F.col("p_partkey").alias("target_id"), F.col("p_brand").alias("owner"), F.concat(F.lit("m"), (F.col("p_size") % 3).cast("string")).alias("member"), F.when(F.col("p_size") % 2 == 0, "(int)").otherwise("(a.S, long)").alias("params"), F.when(F.col("p_partkey") % 5 == 0, "class").otherwise("method").alias("kind"))
    uses = table(spark, d, "supplier").select(F.col("s_suppkey").alias("use_id"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 5 + 1).cast("string"), (F.col("s_nationkey") % 5 + 1).cast("string")).alias("owner"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("m"), (F.col("s_suppkey") % 3).cast("string"))).alias("member"), F.when(F.col("s_suppkey") % 4 == 0, "(S,long)").alias("params"), F.lit("method").alias("kind"))
    return resolve.member_matches(targets, uses)


def declared_contract(spark, d):
    methods = table(spark, d, "part").select(F.col("p_partkey").alias("method_id"), F.array("p_type", F.concat(F.lit("T"), (F.col("p_size") % 7).cast("string")), "p_type").alias("types"))
    owners = spark.createDataFrame([("SMALL",), ("T3",), ("T3",), ("none",)], "owner string")
    return resolve.contract_methods(owners, methods)


def string_propagation(spark, d):
    calls = table(spark, d, "lineitem").select((F.col("l_suppkey") % 30).alias("caller"), (F.col("l_partkey") % 30).alias("callee"), (F.col("l_linenumber") % 3).alias("position"), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("c."), (F.col("l_quantity") % 5).cast("int").cast("string"))).alias("literal"), F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") % 2).alias("passes"))
    lookups = spark.createDataFrame([(3, 0), (7, 1), (7, 2)], "callee bigint, position int")
    got = resolve.propagated_strings(calls, lookups)
    return got.groupBy("callee").agg(F.count("*").alias("n"), F.countDistinct("caller").alias("callers"))


def caller_resolve(spark, d):
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("n"), (F.col("l_partkey") % 90).cast("string")).alias("caller"), (F.col("l_suppkey") % 25).alias("callee"))
    methods = table(spark, d, "supplier").select(F.col("s_suppkey").alias("method_id"), F.concat(F.lit("n"), (F.col("s_suppkey") % 70).cast("string")).alias("name"))
    good, failures = resolve.resolve_callers(edges, methods)
    done = good.groupBy("callee").agg(F.lit("RESOLVED").alias("reason"), F.count("*").alias("occurrences"))
    return done.unionByName(failures)


def activation_proof(spark, d):
    records = table(spark, d, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("path"), F.col("p_type").alias("sha256"), (F.col("p_size") % 3).alias("entry"))
    proofs = table(spark, d, "part").where("p_partkey % 40 = 0").select(F.col("p_brand").alias("path"), F.col("p_type").alias("sha256"), (F.col("p_size") % 2).alias("entry"))
    return resolve.activated(records, proofs).groupBy("proof").agg(F.count("*").alias("n"), F.sum("record_id").alias("ids"))


def proxy_edges(spark, d):
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("c"), (F.col("l_suppkey") % 50).cast("string")).alias("caller"), F.concat(F.lit("i"), (F.col("l_partkey") % 50).cast("string")).alias("callee"), F.lit("call").alias("kind")).distinct()
    proxies = spark.createDataFrame([("i1", "mapper", "sql1", "mybatis"), ("i2", "tx", "impl2", "transaction"), ("i1", "tx", "impl1", "transaction")], "interface string, proxy string, target string, kind string")
    return resolve.project_proxies(edges, proxies).groupBy("kind", "callee").agg(F.count("*").alias("n"))


def catalog_retract(spark, d):
    manifest = table(spark, d, "documents").select(F.concat("source", F.lit(":"), (F.col("doc_id") % 200).cast("string")).alias("coord"), F.sha2("text", 256).alias("sha256"))
    inventory = table(spark, d, "documents").where("doc_id % 10 != 3").select(F.sha2("text", 256).alias("sha256"), F.col("lang").alias("entry"))
    good, failed = resolve.runtime_catalog(manifest, inventory)
    return good.select("coord", F.lit("KEPT").alias("reason"), "entries").unionByName(failed.withColumn("entries", F.lit(None).cast("bigint")))


def source_align(spark, d):
    source = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("coord")).agg(F.max("o_orderpriority").alias("version"), F.max("o_orderstatus").alias("sha256"))
    catalog = table(spark, d, "orders").where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("coord")).agg(F.max("o_orderpriority").alias("version"), F.max("o_orderstatus").alias("sha256"))
    return resolve.source_alignment(source, catalog)


def alignment_proof(spark, d):
    o = table(spark, d, "orders")
    errors = resolve.alignment_errors({"revision": (F.col("o_orderkey") % 5, F.col("o_custkey") % 5), "hash": (F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")), F.lit("O")), "command": (F.col("o_orderpriority"), F.lit("1-URGENT"))})
    return o.groupBy(F.array_join(errors, "|").alias("errors")).agg(F.count("*").alias("n"))


def bridge_needed(spark, d):
    apis = table(spark, d, "part").select(F.col("p_brand").alias("owner"), "p_partkey")
    direct = table(spark, d, "part").where("p_size > 49 AND p_partkey % 2 = 0").select(F.col("p_brand").alias("owner"))
    return resolve.needs_bridge(apis, direct)


def source_admission(spark, d):
    sources = table(spark, d, "orders").select(F.col("o_custkey").alias("coord"), F.col("o_orderpriority").alias("class")).distinct()
    packaged = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("coord"), F.col("o_orderpriority").alias("class"))
    return resolve.admitted_sources(sources, packaged).groupBy("coord").agg(F.count("*").alias("n"))


def simple_names(spark, d):
    return resolve.unique_simple_names(table(spark, d, "part").select(F.concat(F.translate("p_type", " ", "."), F.lit("$N"), (F.col("p_partkey") % 900).cast("string")).alias("class")))


def type_resolution(spark, d):
    p = table(spark, d, "part")
    uses = p.select((F.col("p_partkey") % 50).alias("file"), F.concat(F.lit("k"), (F.col("p_partkey") % 50 % 4).cast("string")).alias("package"), F.concat(F.lit("T"), F.col("p_size").cast("string")).alias("simple"))
    imports = p.where("p_partkey % 3 = 0").select((F.col("p_partkey") % 50).alias("file"), F.concat(F.lit("i"), (F.col("p_partkey") % 2).cast("string"), F.lit(".T"), F.col("p_size").cast("string")).alias("class"))
    known = p.where("p_size < 40").select(F.concat(F.lit("k"), (F.col("p_size") % 5).cast("string"), F.lit(".T"), F.col("p_size").cast("string")).alias("class")).unionByName(p.where("p_size % 9 = 0").select(F.concat(F.lit("z.T"), F.col("p_size").cast("string")).alias("class")))
    got = resolve.resolved_types(uses, imports, known)
    return got.groupBy("status", "match_rank").agg(F.count("*").alias("n"), F.min("class").alias("first")).withColumn("match_rank", F.col("match_rank").cast("bigint"))


def edge_overlay(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("caller"), (F.col("l_partkey") % 40).alias("callee"), "l_returnflag")
    side = lambda f: l.where(F.col("l_returnflag") == f).select("caller", "callee")
    return resolve.overlay(side("A"), side("R"), side("N").where("caller % 2 = 0")).groupBy("caller").agg(F.count("*").alias("n"))


def collector_union(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("identity"), F.col("o_orderpriority").alias("collector"), F.col("o_orderkey").alias("seq"), "o_orderstatus")
    part = lambda s: o.where(F.col("o_orderstatus") == s).drop("o_orderstatus")
    got = resolve.ingested([("bytecode", part("F")), ("framework", part("O").where("collector < '3'")), ("rest", part("P"))], ["identity"], replacing=("framework",))
    return got.groupBy("phase", "collector").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs")).withColumn("phase", F.col("phase").cast("bigint"))


QUERIES = {f.__name__: f for f in (packaged_enrich, gap_fill, provider_set, overload_expand, coord_resolve, indirect_match, declared_contract, string_propagation, caller_resolve, activation_proof, proxy_edges, catalog_retract, source_align, alignment_proof, bridge_needed, source_admission, simple_names, type_resolution, edge_overlay, collector_union)}

_RANKED = """r AS (SELECT {k}, match_rank, min({v}) v, count(DISTINCT {v}) n FROM c GROUP BY {k}, match_rank QUALIFY match_rank = min(match_rank) OVER (PARTITION BY {k})),
        g AS (SELECT u.*, match_rank, CASE WHEN n = 1 THEN v END AS value, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM u LEFT JOIN r USING ({k}))"""
SQL = {
    "packaged_enrich": f"""
        WITH p AS (SELECT 'a' || (p_partkey % 300) || '-' || p_size || '.jar' AS file, p_partkey FROM part), u AS (SELECT DISTINCT file FROM p),
        s AS (SELECT 'g:' || s_suppkey coord, 'a' || (s_suppkey * 3 % 300) || '-' || (s_nationkey + 1) || '.jar' usual, CASE WHEN s_suppkey % 4 = 0 THEN 'a' || (s_suppkey % 30) || '-7.jar' END file FROM supplier),
        c AS (SELECT file, 'manual' coord, 0 match_rank FROM p WHERE p_partkey % 100 = 0 UNION ALL SELECT file, coord, 1 FROM s WHERE file IS NOT NULL UNION ALL SELECT usual, coord, 2 FROM s),
        {_RANKED.format(k='file', v='coord')} SELECT file, value AS coord, CAST(match_rank AS BIGINT) AS match_rank, status FROM g""",
    "gap_fill": """
        SELECT c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS gap, count(*) AS n, CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN CAST(sum(c_nationkey) AS BIGINT) END AS nations FROM customer GROUP BY 1""",
    "provider_set": """
        WITH a AS (SELECT DISTINCT l_suppkey % 60 provider, l_partkey m FROM lineitem WHERE l_returnflag = 'R'), o AS (SELECT DISTINCT l_orderkey % 20 AS owner, l_partkey m FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1),
        x AS (SELECT provider, owner, count(*) shared FROM a JOIN o USING (m) GROUP BY 1, 2 HAVING count(*) >= 24), y AS (SELECT *, count(*) OVER (PARTITION BY provider) n FROM x)
        SELECT owner, string_agg(CAST(provider AS VARCHAR), ',' ORDER BY provider) AS providers, CAST(sum(shared) AS BIGINT) AS shared FROM y WHERE n = 1 GROUP BY 1""",
    "overload_expand": """
        WITH k AS (SELECT DISTINCT replace(p_brand, '#', '.') || '.m' || (p_size % 5) AS name, replace(p_brand, '#', '.') || '.m' || (p_size % 5) || '(' || (p_partkey % 7) || ')' AS key FROM part),
        t AS (SELECT DISTINCT replace(p_brand, '#', '.') || '.m' || (p_size % 6) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '(3)' END AS target FROM part)
        SELECT target, key FROM t JOIN k ON target = key OR target = name""",
    "coord_resolve": f"""
        WITH s AS (SELECT DISTINCT 'g' || s_nationkey || ':a' || (s_suppkey % 40) AS ga, 'a' || (s_suppkey % 40) AS artifact, 'g' || s_nationkey || ':a' || (s_suppkey % 40) || CASE WHEN s_suppkey % 3 = 0 THEN ':x' ELSE '' END AS coord FROM supplier),
        u AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'a' || (c_custkey % 60) ELSE 'g' || c_nationkey || ':a' || (c_custkey % 50) || CASE WHEN c_custkey % 3 = 1 THEN ':x' ELSE '' END END AS query FROM customer),
        c AS (SELECT query, coord, 0 match_rank FROM u JOIN s ON query = coord UNION ALL SELECT query, coord, 1 FROM u JOIN s ON query = ga UNION ALL SELECT query, coord, 2 FROM u JOIN s ON query = artifact),
        {_RANKED.format(k='query', v='coord')}
        SELECT query, value AS coord, CASE status WHEN 'unresolved' THEN 'coord_not_found' WHEN 'ambiguous' THEN 'coord_ambiguous' ELSE CASE match_rank WHEN 0 THEN 'coord_exact' WHEN 1 THEN 'coord_ga_unique' ELSE 'coord_artifact_unique' END END AS mode FROM g""",
    "indirect_match": """
        WITH u AS (SELECT s_suppkey use_id, 'Brand#' || (s_suppkey % 5 + 1) || (s_nationkey % 5 + 1) AS owner, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 3 END m, s_suppkey % 4 = 0 AS has FROM supplier)
        SELECT p_partkey AS target_id, use_id FROM part JOIN u ON p_brand = owner WHERE p_partkey % 5 = 0 OR m IS NULL OR (m = p_size % 3 AND (NOT has OR p_size % 2 = 1))""",
    "declared_contract": "SELECT DISTINCT o AS owner, p_partkey AS method_id FROM part JOIN (VALUES ('SMALL'), ('T3'), ('none')) v(o) ON o = p_type OR o = 'T' || (p_size % 7)",
    "string_propagation": """
        WITH c AS (SELECT l_suppkey % 30 caller, l_partkey % 30 callee, l_linenumber % 3 pos, CASE WHEN l_returnflag = 'A' THEN 'c.' || CAST(CAST(l_quantity AS BIGINT) % 5 AS VARCHAR) END lit, CASE WHEN l_returnflag = 'R' THEN l_linenumber % 2 END pass FROM lineitem),
        k(callee, pos) AS (VALUES (3, 0), (7, 1), (7, 2)), o AS (SELECT callee, pos FROM k UNION SELECT caller, pass FROM c JOIN k USING (callee, pos) WHERE pass IS NOT NULL),
        r AS (SELECT DISTINCT caller, callee, lit FROM c JOIN o USING (callee, pos) WHERE lit IS NOT NULL) SELECT callee, count(*) AS n, count(DISTINCT caller) AS callers FROM r GROUP BY 1""",
    "caller_resolve": """
        WITH m AS (SELECT s_suppkey % 70 AS name, count(*) n FROM supplier GROUP BY 1), e AS (SELECT l_partkey % 90 AS name, l_suppkey % 25 AS callee FROM lineitem)
        SELECT callee, CASE WHEN n IS NULL THEN 'CALLER_UNRESOLVED' WHEN n > 1 THEN 'CALLER_AMBIGUOUS' ELSE 'RESOLVED' END AS reason, count(*) AS occurrences FROM e LEFT JOIN m USING (name) GROUP BY 1, 2""",
    "activation_proof": """
        WITH q AS (SELECT p_brand b, p_type t, p_size % 2 e FROM part WHERE p_partkey % 40 = 0)
        SELECT CASE WHEN EXISTS (SELECT 1 FROM q WHERE b = p_brand AND t = p_type AND e = p_size % 3) THEN 'verified' WHEN NOT EXISTS (SELECT 1 FROM q WHERE b = p_brand) THEN 'path_unproven' WHEN NOT EXISTS (SELECT 1 FROM q WHERE b = p_brand AND t = p_type) THEN 'content_differs' ELSE 'entry_differs' END AS proof,
          count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS ids FROM part GROUP BY 1""",
    "proxy_edges": """
        WITH e AS (SELECT DISTINCT 'c' || (l_suppkey % 50) caller, 'i' || (l_partkey % 50) callee, 'call' AS kind FROM lineitem), p(i, proxy, target, k) AS (VALUES ('i1', 'mapper', 'sql1', 'mybatis'), ('i2', 'tx', 'impl2', 'transaction'), ('i1', 'tx', 'impl1', 'transaction')),
        a AS (SELECT * FROM e UNION SELECT caller, proxy, k FROM e JOIN p ON callee = i UNION SELECT proxy, target, k FROM e JOIN p ON callee = i) SELECT kind, callee, count(*) AS n FROM a GROUP BY 1, 2""",
    "catalog_retract": """
        WITH m AS (SELECT DISTINCT source || ':' || (doc_id % 200) AS coord, text FROM documents), i AS (SELECT text, count(*) entries FROM documents WHERE doc_id % 10 <> 3 GROUP BY 1),
        g AS (SELECT coord, count(DISTINCT text) n, min(entries) e FROM m LEFT JOIN i USING (text) GROUP BY 1)
        SELECT coord, CASE WHEN n > 1 THEN 'RUNTIME_IDENTITY_CONFLICT' WHEN e IS NULL THEN 'RUNTIME_CONTENT_MISSING' ELSE 'KEPT' END AS reason, CASE WHEN n = 1 THEN e END AS entries FROM g""",
    "source_align": """
        WITH s AS (SELECT o_custkey coord, max(o_orderpriority) v, max(o_orderstatus) h FROM orders GROUP BY 1), c AS (SELECT o_custkey coord, max(o_orderpriority) cv, max(o_orderstatus) ch FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
        SELECT coord, CASE WHEN cv IS NULL THEN 'not_packaged' WHEN v <> cv THEN 'version_differs' WHEN h = ch THEN 'aligned' ELSE 'content_differs' END AS alignment FROM s LEFT JOIN c USING (coord)""",
    "alignment_proof": """
        SELECT concat_ws('|', CASE WHEN o_orderkey % 5 <> o_custkey % 5 THEN 'revision_differs' END, CASE WHEN o_orderkey % 7 = 0 THEN 'hash_missing' WHEN o_orderstatus <> 'O' THEN 'hash_differs' END, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'command_differs' END) AS errors, count(*) AS n FROM orders GROUP BY 1""",
    "bridge_needed": "SELECT p_brand AS owner, p_partkey FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49 AND p_partkey % 2 = 0)",
    "source_admission": "SELECT o_custkey AS coord, count(DISTINCT o_orderpriority) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "simple_names": """
        WITH c AS (SELECT DISTINCT replace(p_type, ' ', '.') || '$N' || (p_partkey % 900) AS class, 'N' || (p_partkey % 900) AS simple FROM part) SELECT simple, min(class) AS class FROM c GROUP BY 1 HAVING count(*) = 1""",
    "type_resolution": f"""
        WITH u AS (SELECT DISTINCT p_partkey % 50 AS file, 'k' || (p_partkey % 50 % 4) AS package, 'T' || p_size AS simple FROM part), i AS (SELECT p_partkey % 50 AS file, 'i' || (p_partkey % 2) || '.T' || p_size AS class, 'T' || p_size AS simple FROM part WHERE p_partkey % 3 = 0),
        k AS (SELECT DISTINCT 'k' || (p_size % 5) || '.T' || p_size AS class, 'T' || p_size AS simple FROM part WHERE p_size < 40 UNION SELECT 'z.T' || p_size, 'T' || p_size FROM part WHERE p_size % 9 = 0),
        c AS (SELECT file, simple, class, 0 match_rank FROM u JOIN i USING (file, simple) UNION ALL SELECT file, u.simple, class, 1 FROM u JOIN k ON package || '.' || u.simple = class UNION ALL SELECT file, simple, class, 2 FROM u JOIN k USING (simple)),
        {_RANKED.format(k='file, simple', v='class')} SELECT status, CAST(match_rank AS BIGINT) AS match_rank, count(*) AS n, min(value) AS first FROM g GROUP BY 1, 2""",
    "edge_overlay": """
        WITH l AS (SELECT DISTINCT l_suppkey % 40 caller, l_partkey % 40 callee, l_returnflag f FROM lineitem), b AS (SELECT DISTINCT caller, callee FROM l WHERE f <> 'N')
        SELECT caller, count(*) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM l WHERE f = 'N' AND l.caller % 2 = 0 AND l.caller = b.caller AND l.callee = b.callee) GROUP BY 1""",
    "collector_union": """
        WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority < '3'), a AS (SELECT o_custkey, 0 phase, o_orderpriority collector, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT IN (SELECT o_orderpriority FROM f)
        UNION ALL SELECT o_custkey, 1, o_orderpriority, o_orderkey FROM f UNION ALL SELECT o_custkey, 2, o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus = 'P'),
        g AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY phase, collector, o_orderkey) = 1) SELECT CAST(phase AS BIGINT) AS phase, collector, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS seqs FROM g GROUP BY 1, 2""",
}
