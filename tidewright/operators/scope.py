"""Questions about a scope: which changed APIs a coordinate or package has, who calls them and by which chains, and which diagnostics concern them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import signatures_agree
from .core import cut, forget, top_k
from .reports import merged_chains
from .resolve import resolve_coords

#: Rows of global diagnostics that are broadcast; more are dealt to blocks of so many.
GLOBAL_ROWS = 10_000


def scope_targets(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """``query, mode, api`` of what each query asks for: a null ``api`` where there is nothing, or where a coordinate is ambiguous.

    ``queries``: query, kind (coord or package); ``targets``: api, coord. Modes are those of resolve.resolve_coords, and package_prefix or package_not_found. A package prefix, with or without
    '.' or '.*' at its end, stands for its members of any depth; one of no characters for none.
    """
    coords = resolve_coords(queries.where("kind = 'coord'").select("query"), targets.select("coord").where("coord IS NOT NULL"))
    by_coord = coords.join(targets.select("coord", "api").distinct(), "coord", "left").select("query", "mode", "api")
    prefix = F.regexp_replace(F.trim("query"), r"\.?\*?$", "")
    wanted = queries.where("kind = 'package'").select("query", prefix.alias("prefix")).distinct()
    parts = F.split(F.regexp_replace("api", r"\(.*$", ""), r"\.")
    above = targets.select("api").distinct().select("api", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("prefix"))
    by_package = wanted.join(above, "prefix", "left").select("query", F.when(F.col("api").isNull(), "package_not_found").otherwise("package_prefix").alias("mode"), "api")
    return by_coord.unionByName(by_package)


def scope_chains(queries: DataFrame, targets: DataFrame, edges: DataFrame, methods: DataFrame, depth: int = 5, limit: int = 20, visits: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """The chains of each query, ``query, rank, chain`` (caller first, joined by arrows), and what is said of it, ``query, mode, apis, chains, limited``.

    ``edges``: caller, callee, test; ``methods``: symbol, owner_type, test. Chains go back from the APIs over at most ``depth`` edges, without a repeated caller or test code, and one is given
    for each caller of the business on the way. All queries are traced at once, an API once however many ask for it. Of chains that end alike the longest stays, and those that may be the same, as
    their signatures agree, are one, the most precise. ``limit`` chains of a query are given, the shortest first; ``visits`` ways from an API are followed on each level, in the order of
    their nodes. ``limited`` says whether either limit has left something out.
    """
    asked = cut(scope_targets(queries, targets))
    good = methods.where("NOT test").select(F.col("symbol").alias("caller"), (F.col("owner_type") == "business").alias("business"))
    e = cut(edges.where("NOT test").select("caller", F.col("callee").alias("at")).distinct().join(good, "caller").repartition("at"))
    now = cut(asked.where("api IS NOT NULL").select("api").distinct().select("api", F.array("api").alias("path"), F.col("api").alias("at")))
    levels, crowded = [], []
    for _ in range(depth):
        grown = now.join(e, "at").where("NOT array_contains(path, caller)").select("api", F.concat("path", F.array("caller")).alias("path"), F.col("caller").alias("at"), "business")
        place = F.row_number().over(Window.partitionBy("api").orderBy("path"))
        level = cut(grown.withColumn("place", place).where(F.col("place") <= visits + 1))
        crowded.append(level.where(F.col("place") > visits).select("api").distinct())
        levels.append(level.where((F.col("place") <= visits) & F.col("business")).select("api", "path"))
        now = level.where(F.col("place") <= visits).select("api", "path", "at")
        if now.isEmpty():
            break
    forget(e)
    none = asked.select("api").limit(0)
    found = reduce(DataFrame.unionByName, levels) if levels else none.select("api", F.array("api").alias("path"))
    chains = cut(_without_beginnings(found))
    name = lambda x: F.regexp_replace(x, r"\(.*$", "")
    each = asked.where("api IS NOT NULL").select("query", "api").distinct().join(chains, "api").select("query", "path")
    shaped = each.select("query", F.array_join(F.transform("path", name), " ").alias("skeleton"), F.transform("path", lambda x: F.regexp_extract(x, r"(\(.*)$", 1)).alias("signatures"), F.array_join(F.reverse("path"), " → ").alias("chain"), F.size("path").alias("nodes"))
    shaped = shaped.withColumn("seq", F.row_number().over(Window.partitionBy("query", "skeleton").orderBy("chain"))).distinct()
    merged = cut(merged_chains(shaped, "query", "skeleton", "signatures", "seq"))
    ranked = top_k(merged, ["query"], [F.col("nodes"), F.col("chain")], limit).select("query", "rank", "chain")
    many = merged.groupBy("query").agg(F.count("*").alias("_n"))
    over = (reduce(DataFrame.unionByName, crowded) if crowded else none).distinct().withColumn("_over", F.lit(True))
    said = asked.join(over, "api", "left").groupBy("query", "mode").agg(F.countDistinct("api").alias("apis"), F.coalesce(F.bool_or("_over"), F.lit(False)).alias("_over")).join(many, "query", "left")
    n = F.coalesce("_n", F.lit(0))
    return ranked, said.select("query", "mode", "apis", F.least(n, F.lit(limit)).alias("chains"), (F.col("_over") | (n > limit)).alias("limited"))


def _without_beginnings(found: DataFrame) -> DataFrame:
    """Paths (from the API on) that no longer path of the API begins with; only their hashes are spread, and compared in full where they meet."""
    longer = found.where(F.size("path") > 2).select(F.col("api").alias("_api"), F.col("path").alias("_long"))
    begins = longer.select("_api", F.explode(F.transform(F.sequence(F.lit(2), F.size("_long") - 1), lambda n: F.xxhash64(F.slice("_long", F.lit(1), n)))).alias("_hash")).distinct()
    maybe = found.withColumn("_hash", F.xxhash64("path"))
    hit = maybe.join(begins, (F.col("api") == F.col("_api")) & (maybe["_hash"] == begins["_hash"]), "left_semi").select("api", "path")
    sure = hit.join(longer, (F.col("api") == F.col("_api")) & (F.size("_long") > F.size("path")) & (F.slice("_long", F.lit(1), F.size("path")) == F.col("path")), "left_semi").distinct()
    return found.join(sure, ["api", "path"], "left_anti")


def diagnostics_of(diagnostics: DataFrame, apis: DataFrame) -> DataFrame:
    """``diagnostic_id, api_id, scope``: which diagnostics concern which APIs, each pair once, by the first scope that tells: exact, signature, path or global.

    ``diagnostics``: diagnostic_id, scope (global, api or path), name, params (null if not told), path; ``apis``: api_id, name, params, path. An api diagnostic concerns the API of its name with equal
    parameters, or with parameters that may be the same where one side lacks packages or all of them; a path diagnostic all APIs of its path. Global ones concern every API: that product is the result, made by a broadcast
    of up to GLOBAL_ROWS counted rows or block by block.
    """
    d = diagnostics.select("diagnostic_id", "scope", "name", "params", "path")
    a = apis.select("api_id", F.col("name"), F.col("params").alias("_params"), F.col("path").alias("_path"))
    named = d.where("scope = 'api'").join(a, "name")
    equal = F.col("params").eqNullSafe(F.col("_params"))
    may = F.col("params").isNull() | F.col("_params").isNull() | signatures_agree(F.col("params"), F.col("_params"))
    by_name = named.where(equal | may).select("diagnostic_id", "api_id", F.when(equal, 0).otherwise(1).alias("_s"))
    by_path = d.where("scope = 'path'").join(a, F.col("path") == F.col("_path")).select("diagnostic_id", "api_id", F.lit(2).alias("_s"))
    general = cut(d.where("scope = 'global'").select("diagnostic_id").distinct())
    ids = a.select("api_id").distinct()
    n = general.count()
    if n <= GLOBAL_ROWS:
        everywhere = ids.crossJoin(F.broadcast(general))
    else:
        blocks = -(-n // GLOBAL_ROWS)
        dealt = general.withColumn("_block", F.pmod(F.xxhash64("diagnostic_id"), F.lit(blocks)).cast("int"))
        everywhere = ids.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "_block").drop("_block")
    told = by_name.unionByName(by_path).groupBy("diagnostic_id", "api_id").agg(F.min("_s").alias("_s")).unionByName(everywhere.select("diagnostic_id", "api_id", F.lit(3).alias("_s")))
    return told.select("diagnostic_id", "api_id", F.get(F.array(*map(F.lit, ("exact", "signature", "path", "global"))), F.col("_s")).alias("scope"))


def diagnostic_counts(diagnostics: DataFrame, apis: DataFrame) -> DataFrame:
    """``api_id, exact, signature, path, global``: how many diagnostics concern each API by each scope, of APIs that any concerns; what diagnostics_of gives, counted without its pairs.

    Only diagnostics by name are paired with their APIs. Those of a path are counted once for all its APIs, global ones once for all; what a name tells already is taken off again.
    """
    d, a = diagnostics.select("diagnostic_id", "scope", "name", "params", "path"), apis.select("api_id", F.col("name"), F.col("params").alias("_params"), F.col("path").alias("_path"))
    equal = F.col("params").eqNullSafe(F.col("_params"))
    may = F.col("params").isNull() | F.col("_params").isNull() | signatures_agree(F.col("params"), F.col("_params"))
    named = d.where("scope = 'api'").join(a, "name").where(equal | may).groupBy("diagnostic_id", "api_id").agg(F.min(F.when(equal, 0).otherwise(1)).alias("_s"))
    named = cut(named)
    on = d.where("scope = 'path' AND path IS NOT NULL").select("diagnostic_id", "path").distinct()
    places = a.where("_path IS NOT NULL").groupBy("api_id").agg(F.collect_set("_path").alias("_paths"))
    one = places.where("size(_paths) = 1").select("api_id", F.col("_paths")[0].alias("path")).join(on.groupBy("path").agg(F.count("*").alias("_n")), "path").select("api_id", "_n")
    # Of an API with several paths a diagnostic may have more than one.
    some = places.where("size(_paths) > 1").select("api_id", F.explode("_paths").alias("path")).join(on, "path").select("api_id", "diagnostic_id").distinct().select("api_id", F.lit(1).cast("bigint").alias("_n"))
    both = named.join(on, "diagnostic_id").join(places.select(F.col("api_id").alias("_api"), F.explode("_paths").alias("path")), "path").where(F.col("api_id").eqNullSafe(F.col("_api")))
    both = both.select("diagnostic_id", "api_id").distinct().select("api_id", F.lit(-1).cast("bigint").alias("_n"))
    n = d.where("scope = 'global'").select("diagnostic_id").distinct().agg(F.count("*").alias("_n"))
    everywhere = a.select("api_id").distinct().crossJoin(F.broadcast(n)).where("_n > 0")  # a single row
    zero, total = F.lit(0).cast("bigint"), F.col("_n")
    by_name = named.select("api_id", *[(F.col("_s") == k).cast("bigint").alias(s) for k, s in enumerate(("exact", "signature"))], zero.alias("path"), zero.alias("global"))
    by_path = [x.select("api_id", zero.alias("exact"), zero.alias("signature"), total.alias("path"), zero.alias("global")) for x in (one, some, both)]
    general = everywhere.select("api_id", zero.alias("exact"), zero.alias("signature"), zero.alias("path"), total.alias("global"))
    return reduce(DataFrame.unionByName, [by_name, *by_path, general]).groupBy("api_id").agg(*[F.sum(s).alias(s) for s in ("exact", "signature", "path", "global")])


def changed_references(apis: DataFrame, references: DataFrame) -> DataFrame:
    """``api_id, reference_id, quality`` of references to changed APIs: exact or candidate; what is exact for an API is no candidate for it.

    ``apis``: api_id, kind (class, field, method or constructor), owner, member, params; ``references``: reference_id, kind, owner, member, params (erased, in brackets, '' or null if not told). A class is met by any
    reference to its owner, a field by owner and member, a method or constructor by owner, member and parameters; if either side lacks the parameters, owner and member make a candidate.
    """
    told = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    a = apis.select("api_id", F.col("kind").alias("_kind"), "owner", "member", told("params").alias("params"))
    r = references.select("reference_id", "kind", "owner", "member", told("params").alias("params"))
    code = ["method", "constructor"]
    hit = [
        a.where("_kind = 'class'").select("api_id", "owner").join(r.select("reference_id", "owner"), "owner"),
        a.where("_kind = 'field'").select("api_id", "owner", "member").join(r.where("kind = 'field'").select("reference_id", "owner", "member"), ["owner", "member"]),
        a.where(F.col("_kind").isin(code) & F.col("params").isNotNull()).select("api_id", F.col("_kind").alias("kind"), "owner", "member", "params").join(r.where(F.col("kind").isin(code) & F.col("params").isNotNull()), ["kind", "owner", "member", "params"]),
    ]
    exact = reduce(DataFrame.unionByName, [h.select("api_id", "reference_id") for h in hit]).distinct()
    loose = a.where(F.col("_kind").isin(code)).select("api_id", F.col("_kind").alias("kind"), "owner", "member", F.col("params").alias("_params")).join(r.where(F.col("kind").isin(code)), ["kind", "owner", "member"])
    candidate = loose.where("params IS NULL OR _params IS NULL").select("api_id", "reference_id").distinct().join(exact, ["api_id", "reference_id"], "left_anti")
    return exact.withColumn("quality", F.lit("exact")).unionByName(candidate.withColumn("quality", F.lit("candidate")))


def reference_counts(apis: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Of each group of APIs (columns ``by``): how many there are, how many are referred to exactly, only as candidates or not at all, and occurrences of either kind. ``found`` as of changed_references."""
    count = lambda q: F.count_if(F.col("quality") == q)
    each = found.groupBy("api_id").agg(count("exact").alias("_e"), count("candidate").alias("_c"))
    j = apis.select("api_id", *by).distinct().join(each, "api_id", "left")
    e, c = F.coalesce("_e", F.lit(0)), F.coalesce("_c", F.lit(0))
    total = lambda v: F.sum(v).cast("bigint")
    return j.groupBy(*by).agg(F.count("*").alias("apis"), F.count_if(e > 0).alias("apis_exact"), F.count_if((e == 0) & (c > 0)).alias("apis_candidate"), F.count_if((e == 0) & (c == 0)).alias("apis_unreferenced"), total(e).alias("occurrences_exact"), total(c).alias("occurrences_candidate"))

