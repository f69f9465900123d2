"""Queries on texts: rule scans, configuration, names and signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import lookup_signature, version_change, version_key
from ..operators import core
from ..sources.tables import table


def _lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return docs.select("doc_id", (F.col("k") + 1).cast("bigint").alias("line_no"), "line")


def rule_interval(spark, d):
    rules = spark.createDataFrame([("r1", 5), ("r2", 20), ("r3", 60), ("r4", None)], "rule string, affected int")
    v = table(spark, d, "events").select("event_id", F.floor("value").cast("int").alias("base"), (F.floor("value") + 15).cast("int").alias("target"))
    # Four rules: a constant table, so a broadcast nested loop is bounded.
    hit = v.join(F.broadcast(rules), F.col("affected").isNull() | ((F.col("base") < F.col("affected")) & (F.col("affected") <= F.col("target"))))
    return hit.groupBy("rule").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def first_rule(spark, d):
    lines = _lines(spark, d)
    rule = core.first_rule(lines, [("licence", F.col("line").contains("licensed under")), ("address", F.col("line").contains("@")), ("digits", F.col("line").rlike("[0-9]{4}")), ("shout", F.col("line").contains("!!"))])
    return lines.groupBy(rule.alias("rule")).agg(F.count("*").alias("n"), F.sum("line_no").alias("line_sum"))


def line_scan(spark, d):
    hit = _lines(spark, d).where(F.col("line").rlike("(?i)[a-z0-9]+@[a-z0-9]+"))
    return hit.select("doc_id", "line_no", F.char_length("line").cast("bigint").alias("chars"))


def class_usage_kind(spark, d):
    p = table(spark, d, "pages").select("page_id", F.lower("html").alias("h"))
    kind = core.first_rule(p, [("script", F.col("h").rlike("<script[^>]*src=")), ("link", F.col("h").contains("<a href=")), ("inline", F.col("h").contains("<script>")), ("style", F.col("h").contains("<style"))])
    return p.select("page_id", kind.alias("kind"))


def config_flatten(spark, d):
    m = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return m.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def _versions(spark, d):
    k = F.col("p_partkey")
    s = lambda x: x.cast("string")
    suffix = F.when(k % 5 == 0, "-RC1").when(k % 5 == 1, "-SNAPSHOT").when(k % 5 == 2, ".SP2").otherwise("")
    return table(spark, d, "part").select("p_partkey", F.concat(s(k % 3), F.lit("."), s(F.floor(k / 3) % 12), F.lit("."), s(k % 7), suffix).alias("version"), F.concat(s(k % 3), F.lit("."), s(F.floor(k / 4) % 12), F.lit("."), s(k % 4)).alias("target"))


def version_compare(spark, d):
    v = _versions(spark, d).withColumn("key", version_key(F.col("version")))
    return v.select("p_partkey", "version", *[F.coalesce(F.get("key.numbers", F.lit(i)), F.lit(0)).alias(n) for i, n in enumerate(("major", "minor", "patch"))], F.col("key.qualifier").alias("qualifier"), F.col("key.number").alias("number"))


def version_classify(spark, d):
    v = _versions(spark, d).select(version_change(F.col("version"), F.col("target")).alias("change"))
    return v.groupBy("change").agg(F.count("*").alias("n"))


def signature_norm(spark, d):
    s = F.concat(F.lit("java.util.Map<java.lang.String, java.util.List<"), F.regexp_replace("p_type", " ", "."), F.lit(">>, "), F.regexp_replace("p_brand", "#", "."), F.lit("..."))
    return table(spark, d, "part").select("p_partkey", lookup_signature(s).alias("signature"))


def longest_prefix(spark, d):
    rules = [("https://", "secure"), ("http://", "plain"), ("https://example", "example"), ("https://site1", "site1"), ("https://site12", "site12"), ("http://site", "site")]
    p = table(spark, d, "pages").select("page_id", "url")
    r = spark.createDataFrame(rules, "prefix string, role string")
    # Six rules: a constant table, so a broadcast nested loop is bounded.
    hit = p.join(F.broadcast(r), F.col("url").startswith(F.col("prefix")), "left")
    return hit.groupBy("page_id").agg(F.max_by("role", F.length("prefix")).alias("role"))


QUERIES = {f.__name__: f for f in (rule_interval, first_rule, line_scan, class_usage_kind, config_flatten, version_compare, version_classify, signature_norm, longest_prefix)}

_LINES = "s AS (SELECT doc_id, string_split(text, chr(10)) ls FROM documents), l AS (SELECT doc_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM s)"
_V = """v AS (SELECT p_partkey, (p_partkey % 3) || '.' || (p_partkey // 3 % 12) || '.' || (p_partkey % 7) || CASE p_partkey % 5 WHEN 0 THEN '-RC1' WHEN 1 THEN '-SNAPSHOT' WHEN 2 THEN '.SP2' ELSE '' END AS version,
    p_partkey % 3 AS major, p_partkey // 3 % 12 AS minor, p_partkey % 7 AS patch, CASE p_partkey % 5 WHEN 0 THEN -1 WHEN 1 THEN -5 WHEN 2 THEN 1 ELSE 0 END AS qualifier, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS number,
    p_partkey // 4 % 12 AS minor2, p_partkey % 4 AS patch2 FROM part)"""
SQL = {
    "rule_interval": """
        WITH r(rule, affected) AS (VALUES ('r1', 5), ('r2', 20), ('r3', 60), ('r4', NULL)), v AS (SELECT event_id, floor(value) b FROM events)
        SELECT rule, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM v, r WHERE affected IS NULL OR (b < affected AND affected <= b + 15) GROUP BY 1""",
    "first_rule": f"""
        WITH {_LINES} SELECT CASE WHEN contains(line, 'licensed under') THEN 'licence' WHEN contains(line, '@') THEN 'address' WHEN regexp_matches(line, '[0-9]{{4}}') THEN 'digits' WHEN contains(line, '!!') THEN 'shout' ELSE 'none' END AS rule,
        count(*) AS n, CAST(sum(line_no) AS BIGINT) AS line_sum FROM l GROUP BY 1""",
    "line_scan": f"WITH {_LINES} SELECT doc_id, line_no, length(line) AS chars FROM l WHERE regexp_matches(line, '(?i)[a-z0-9]+@[a-z0-9]+')",
    "class_usage_kind": """
        SELECT page_id, CASE WHEN regexp_matches(lower(html), '<script[^>]*src=') THEN 'script' WHEN contains(lower(html), '<a href=') THEN 'link' WHEN contains(lower(html), '<script>') THEN 'inline' WHEN contains(lower(html), '<style') THEN 'style' ELSE 'none' END AS kind FROM pages""",
    "config_flatten": """
        WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) SELECT key, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || key)) AS n_values FROM k GROUP BY 1""",
    "version_compare": f"WITH {_V} SELECT p_partkey, version, major, minor, patch, CAST(qualifier AS BIGINT) AS qualifier, CAST(number AS BIGINT) AS number FROM v",
    "version_classify": f"""
        WITH {_V}, c AS (SELECT CASE WHEN qualifier = 0 AND minor = minor2 AND patch = patch2 THEN 'unchanged' WHEN minor2 < minor OR (minor2 = minor AND (patch2 < patch OR (patch2 = patch AND qualifier > 0))) THEN 'downgrade'
          WHEN minor <> minor2 THEN 'minor' WHEN patch <> patch2 THEN 'patch' ELSE 'qualifier' END AS change FROM v) SELECT change, count(*) AS n FROM c GROUP BY 1""",
    "signature_norm": """
        SELECT p_partkey, 'Map,' || regexp_extract(replace(p_brand, '#', '.'), '([^.]*)$', 1) || '[]' AS signature FROM part""",
    "longest_prefix": """
        WITH r(prefix, role) AS (VALUES ('https://', 'secure'), ('http://', 'plain'), ('https://example', 'example'), ('https://site1', 'site1'), ('https://site12', 'site12'), ('http://site', 'site'))
        SELECT page_id, (SELECT max_by(role, length(prefix)) FROM r WHERE starts_with(url, prefix)) AS role FROM pages""",
}
