"""Joins that resolve names, callers and artifacts, each of which says what it couldn't resolve.

Candidates are joined on equality and ranked; where several are left at the best rank, nothing is guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import signatures_agree
from .core import dealt_join


def ranked_match(rows: DataFrame, key: list[str], candidates: DataFrame, value: str) -> DataFrame:
    """``key, value, match_rank, status`` for each row of ``rows`` (distinct keys): the value of the best rank, if it is the only one there.

    ``candidates`` has the key, the value and ``match_rank`` (0 is best). status: resolved, ambiguous (value null) or unresolved.
    """
    best = candidates.groupBy(*key, "match_rank").agg(F.min(value).alias(value), F.countDistinct(value).alias("_n"))
    best = best.groupBy(*key).agg(F.min_by(F.struct(value, "_n"), "match_rank").alias("_b"), F.min("match_rank").alias("match_rank"))
    status = F.when(F.col("_b").isNull(), "unresolved").when(F.col("_b._n") > 1, "ambiguous").otherwise("resolved")
    return rows.select(*key).distinct().join(best, key, "left").select(*key, F.when(F.col("_b._n") == 1, F.col(f"_b.{value}")).alias(value), "match_rank", status.alias("status"))


def enrich_packaged(packaged: DataFrame, resolved: DataFrame, overrides: DataFrame) -> DataFrame:
    """``file, coord, match_rank, status`` of packaged files: a manual override, else the inventory's exact file name, else artifact-version.jar.

    ``packaged``: file; ``resolved``: coord, artifact, version and file (null if the inventory has none); ``overrides``: file, coord. A file to
    which two coordinates lay claim at the best rank is ambiguous.
    """
    by_name = resolved.where("file IS NOT NULL").select("file", "coord", F.lit(1).alias("match_rank"))
    usual = resolved.select(F.concat("artifact", F.lit("-"), "version", F.lit(".jar")).alias("file"), "coord", F.lit(2).alias("match_rank"))
    claims = overrides.select("file", "coord", F.lit(0).alias("match_rank")).unionByName(by_name).unionByName(usual)
    return ranked_match(packaged, ["file"], claims.join(packaged.select("file").distinct(), "file", "left_semi"), "coord")


def fill_gaps(have: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``have`` and those rows of ``more`` whose keys it lacks; ``gap`` tells which. Columns that only one has are null in the other."""
    extra = more.join(have.select(*keys).distinct(), keys, "left_anti")
    return have.withColumn("gap", F.lit(False)).unionByName(extra.withColumn("gap", F.lit(True)), allowMissingColumns=True)


def provider_sets(added: DataFrame, owners: DataFrame, least: int = 2) -> DataFrame:
    """``owner, providers, shared``: added artifacts that share ``least`` or more members with one upgraded owner and with no other.

    ``added``: provider, member; ``owners``: owner, member; both distinct.
    """
    met = added.join(owners, "member").groupBy("provider", "owner").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    alone = met.withColumn("n", F.count("*").over(Window.partitionBy("provider"))).where("n = 1")
    return alone.groupBy("owner").agg(F.array_sort(F.collect_list("provider")).alias("providers"), F.sum("shared").alias("shared"))


def overload_keys(targets: DataFrame, keys: DataFrame) -> DataFrame:
    """``target, key``: a signed target meets its own key alone, one without a signature every key of that name.

    ``targets``: target; ``keys``: key, written owner.method(types). Equi-joins on the whole key and on the name before the bracket.
    """
    k = keys.select("key", F.regexp_replace("key", r"\(.*$", "").alias("name")).distinct()
    t = targets.select("target").distinct()
    signed = t.where(F.col("target").contains("(")).join(k, F.col("target") == F.col("key")).select("target", "key")
    return signed.unionByName(t.where(~F.col("target").contains("(")).join(k, F.col("target") == F.col("name")).select("target", "key"))


def resolve_coords(queries: DataFrame, coords: DataFrame) -> DataFrame:
    """``query, coord, mode`` of coordinates asked for: coord_exact, coord_ga_unique, coord_artifact_unique, coord_ambiguous or coord_not_found.

    ``coords``: coord, written group:artifact or group:artifact:classifier. Only a query without classifier falls back to group and
    artifact, only one without a colon to the artifact.
    """
    q = queries.select(F.trim("query").alias("query")).distinct()
    parts = F.split("coord", ":")
    c = coords.where("coord != ''").select("coord", F.concat_ws(":", parts[0], parts[1]).alias("ga"), parts[1].alias("artifact")).distinct()
    colons = F.size(F.split("query", ":"))
    claims = q.join(c, F.col("query") == F.col("coord")).select("query", "coord", F.lit(0).alias("match_rank"))
    claims = claims.unionByName(q.where(colons == 2).join(c, F.col("query") == F.col("ga")).select("query", "coord", F.lit(1).alias("match_rank")))
    claims = claims.unionByName(q.where(colons == 1).join(c, F.col("query") == F.col("artifact")).select("query", "coord", F.lit(2).alias("match_rank")))
    got = ranked_match(q, ["query"], claims, "coord")
    mode = F.when(F.col("status") == "unresolved", "coord_not_found").when(F.col("status") == "ambiguous", "coord_ambiguous")
    return got.select("query", "coord", mode.when(F.col("match_rank") == 0, "coord_exact").when(F.col("match_rank") == 1, "coord_ga_unique").otherwise("coord_artifact_unique").alias("mode"))


def member_matches(targets: DataFrame, uses: DataFrame) -> DataFrame:
    """``target_id, use_id`` of uses (reflection, handles) that may mean a target: equal owner, then equal member and agreeing parameters where the use tells them.

    ``targets``: target_id, owner, member, params, kind; ``uses``: use_id, owner, member, params, kind. A class target is met by any use of the owner; a use
    without member or params may mean any. Targets, and uses, that are alike in all but their ids are matched once; only then are the pairs made, in equal shares for all tasks.
    """
    look = F.struct("owner", "member", "params", "kind")
    targets, uses = (df.where("owner IS NOT NULL").select(n, look.alias(of)) for df, n, of in ((targets, "target_id", "_t"), (uses, "use_id", "_u")))
    t, u = targets.select("_t", F.col("_t.owner").alias("owner"), *[F.col(f"_t.{c}").alias(f"t_{c}") for c in ("member", "params", "kind")]).distinct(), uses.select("_u", "_u.*").distinct()
    same = (F.col("t_kind") == "class") | ((F.col("kind") == F.col("t_kind")) & (F.col("member").isNull() | ((F.col("member") == F.col("t_member")) & (F.col("params").isNull() | signatures_agree(F.col("params"), F.col("t_params"))))))
    met = t.join(u, "owner").where(same).select("_t", "_u")
    return dealt_join(targets, met.join(uses, "_u").select("_t", "use_id"), ["_t"]).select("target_id", "use_id")


def contract_methods(owners: DataFrame, methods: DataFrame) -> DataFrame:
    """``owner, method_id`` of methods that declare a data class: an equi-join on the exploded types, each pair once. ``methods``: method_id, types (array)."""
    return methods.select("method_id", F.explode(F.array_distinct("types")).alias("owner")).join(owners.select("owner").distinct(), "owner").select("owner", "method_id").distinct()


def propagated_strings(calls: DataFrame, lookups: DataFrame) -> DataFrame:
    """``caller, callee, value``: literals that a caller passes to the parameter which a callee looks a class up by; through pass-on calls, one step.

    ``calls``: caller, callee, position, literal (null if not one), passes (the caller's own parameter that is handed on, null if none); ``lookups``:
    callee, position.
    """
    direct = calls.join(lookups, ["callee", "position"])
    through = direct.where("passes IS NOT NULL").select(F.col("caller").alias("callee"), F.col("passes").alias("position")).distinct()
    on = lookups.select("callee", "position").unionByName(through).distinct()
    return calls.where("literal IS NOT NULL").join(on, ["callee", "position"]).select("caller", "callee", F.col("literal").alias("value")).distinct()


def resolve_callers(edges: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose caller is a known method (with its ``method_id``), and failures by callee: ``callee, reason, occurrences``.

    ``edges``: caller, callee; ``methods``: method_id, name. A name that several methods have resolves to none of them.
    """
    known = methods.groupBy("name").agg(F.min("method_id").alias("method_id"), F.count("*").alias("_n"))
    met = edges.join(known, F.col("caller") == F.col("name"), "left")
    why = F.when(F.col("_n").isNull(), "CALLER_UNRESOLVED").when(F.col("_n") > 1, "CALLER_AMBIGUOUS")
    failures = met.where(why.isNotNull()).groupBy("callee", why.alias("reason")).agg(F.count("*").alias("occurrences"))
    return met.where(why.isNull()).select("caller", "callee", "method_id"), failures


def activated(records: DataFrame, proofs: DataFrame) -> DataFrame:
    """Framework records with ``activated`` and ``proof``: verified only if path, digest and entry all equal those of a proof; else what differs.

    ``records``: record_id, path, sha256, entry; ``proofs``: path, sha256, entry.
    """
    p = proofs.groupBy("path").agg(F.collect_set(F.struct("sha256", "entry")).alias("_p"))
    exact = F.coalesce(F.array_contains("_p", F.struct("sha256", "entry")), F.lit(False))
    sha = F.coalesce(F.exists("_p", lambda x: x["sha256"] == F.col("sha256")), F.lit(False))
    return records.join(p, "path", "left").withColumn("activated", exact).withColumn("proof", F.when(exact, "verified").when(F.col("_p").isNull(), "path_unproven").when(~sha, "content_differs").otherwise("entry_differs")).drop("_p")


def project_proxies(edges: DataFrame, proxies: DataFrame) -> DataFrame:
    """``edges`` (caller, callee, kind) with two edges for each call of an interface method that a proxy serves: caller to proxy and proxy to target.

    ``proxies``: interface, proxy, target, kind. The call itself stays; repeated edges are given once.
    """
    met = edges.join(proxies.select(F.col("interface").alias("callee"), "proxy", "target", F.col("kind").alias("_kind")), "callee")
    made = met.select("caller", F.col("proxy").alias("callee"), F.col("_kind").alias("kind")).unionByName(met.select(F.col("proxy").alias("caller"), F.col("target").alias("callee"), F.col("_kind").alias("kind")))
    return edges.select("caller", "callee", "kind").unionByName(made).distinct()


def runtime_catalog(manifest: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runtime catalog ``coord, sha256, entries``, and failures ``coord, reason``: a coordinate with several contents is retracted as a whole.

    ``manifest``: coord, sha256; ``inventory``: sha256, entry. A coordinate whose content the inventory lacks fails too.
    """
    held = manifest.select("coord", "sha256").distinct().join(inventory.groupBy("sha256").agg(F.count("*").alias("entries")), "sha256", "left")
    g = held.groupBy("coord").agg(F.countDistinct("sha256").alias("n"), F.min("sha256").alias("sha256"), F.min("entries").alias("entries"))
    why = F.when(F.col("n") > 1, "RUNTIME_IDENTITY_CONFLICT").when(F.col("entries").isNull(), "RUNTIME_CONTENT_MISSING")
    return g.where(why.isNull()).select("coord", "sha256", "entries"), g.where(why.isNotNull()).select("coord", why.alias("reason"))


def source_alignment(sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """``coord, alignment`` of dependency sources: aligned, version_differs, content_differs, not_packaged, or ambiguous where the catalog has a coordinate with several versions or contents.

    ``sources``: coord, version, sha256; ``catalog`` likewise. The catalog is folded first, so each source has one answer; a source that comes twice with different facts has one for each.
    """
    one = F.struct(F.col("version"), F.col("sha256"))
    c = catalog.groupBy("coord").agg(F.min(one).alias("_c"), (F.min(one) != F.max(one)).alias("_many"))
    state = F.when(F.col("_c").isNull(), "not_packaged").when(F.col("_many"), "ambiguous").when(F.col("version") != F.col("_c.version"), "version_differs").when(F.col("sha256").eqNullSafe(F.col("_c.sha256")), "aligned").otherwise("content_differs")
    return sources.join(c, "coord", "left").select("coord", state.alias("alignment"))


def alignment_errors(proof: dict[str, tuple[Column, Column]]) -> Column:
    """The names of the facts (revision, hashes, build command) that are missing on a side or differ, as an array in the given order."""
    wrong = [F.when(a.isNull() | b.isNull(), F.lit(f"{name}_missing")).when(a != b, F.lit(f"{name}_differs")) for name, (a, b) in proof.items()]
    return F.array_compact(F.array(*wrong))


def needs_bridge(apis: DataFrame, direct: DataFrame) -> DataFrame:
    """``apis`` that the business doesn't use directly, by owner: what only an analysis across dependencies can reach."""
    return apis.join(direct.select("owner").distinct(), "owner", "left_anti")


def admitted_sources(sources: DataFrame, packaged: DataFrame) -> DataFrame:
    """Source classes that the artifact of the same coordinate really holds (``coord, class``)."""
    return sources.join(packaged.select("coord", "class").distinct(), ["coord", "class"], "left_semi")


def unique_simple_names(classes: DataFrame) -> DataFrame:
    """``simple, class`` for simple names that stand for one class only; ``classes``: class (qualified, nested by $)."""
    c = classes.select("class", F.element_at(F.split("class", r"[.$]"), -1).alias("simple")).distinct()
    return c.groupBy("simple").agg(F.min("class").alias("class"), F.count("*").alias("n")).where("n = 1").select("simple", "class")


def resolved_types(uses: DataFrame, imports: DataFrame, known: DataFrame) -> DataFrame:
    """``file, simple, class, match_rank, status`` of simple type names: by import, else the file's package, else the only known class of that name.

    ``uses``: file, package, simple; ``imports``: file, class; ``known``: class. Several candidates at the best rank are ambiguous.
    """
    u = uses.select("file", "package", "simple").distinct()
    name = lambda c: F.element_at(F.split(c, r"\."), -1)
    by_import = u.join(imports.select("file", "class", name("class").alias("simple")), ["file", "simple"]).select("file", "simple", "class", F.lit(0).alias("match_rank"))
    k = known.select("class").distinct()
    near = u.join(k, F.concat_ws(".", "package", "simple") == F.col("class")).select("file", "simple", "class", F.lit(1).alias("match_rank"))
    anywhere = u.join(k.withColumn("simple", name("class")), "simple").select("file", "simple", "class", F.lit(2).alias("match_rank"))
    return ranked_match(u, ["file", "simple"], by_import.unionByName(near).unionByName(anywhere), "class")


def overlay(base: DataFrame, pending: DataFrame, removed: DataFrame | None = None, keys: tuple[str, ...] = ("caller", "callee")) -> DataFrame:
    """A view of ``base`` with ``pending`` edges and without ``removed`` ones, each edge once; neither table is changed."""
    both = base.unionByName(pending).distinct()
    return both if removed is None else both.join(removed.select(*keys).distinct(), list(keys), "left_anti")


def ingested(phases: list[tuple[str, DataFrame]], identity: list[str], collector: str = "collector", replacing: tuple[str, ...] = ()) -> DataFrame:
    """Records of all collectors in the order of ``phases`` (name, rows), each identity once: that of the earliest phase.

    Rows of a collector that a phase in ``replacing`` has are left out of all phases before it.
    """
    out = None
    for k, (name, rows) in enumerate(phases):
        rows = rows.withColumn("phase", F.lit(k))
        if out is not None and name in replacing:
            out = out.join(rows.select(collector).distinct(), collector, "left_anti")
        out = rows if out is None else out.unionByName(rows)
    columns = [c for c in out.columns if c not in identity and c != "phase"]
    first = out.groupBy(*identity).agg(F.min(F.struct("phase", *columns)).alias("_r"))
    return first.select(*identity, *[f"_r.{c}" for c in [*columns, "phase"]])
