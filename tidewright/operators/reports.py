"""Rollups of verdicts, paths and dependencies for reports, and the decision on a target from its evidence."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..workers import ship
from .core import top_k

# Verdicts and severities in the order of a ledger, coverage from best to worst, stages of failures in the order they count.
STATUS_ORDER = ("reachable", "uncertain", "not_analyzed", "not_impacted", "not_found_in_static_analysis")
SEVERITIES = ("P0", "P1", "P2", "P3")
COVERAGE = ("complete", "partial", "failed")
NOT_APPLICABLE = "not_applicable"
# Stops at an entry of a framework or dependency, which only a semantic edge makes good.
ENTRY_CLAIMS = ("RUNTIME_FRAMEWORK_ENTRY_REACHED", "RUNTIME_DEPENDENCY_ENTRY_REACHED")


def order_of(value: Column, order: tuple[str, ...]) -> Column:
    """The place of a value in a fixed order; anything else comes last."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(len(order) + 1)


def decide(paths: DataFrame, failures: DataFrame, concerns: DataFrame, coverage: DataFrame, preserved: DataFrame, targets: DataFrame) -> DataFrame:
    """``target, status, reason, direct_callers, business_reach_depth`` of every target.

    ``paths``: target, path_seq, scope (business, internal, external or another word), depth, complete, ambiguous, truncated, activated (true unless a semantic edge is unproven),
    semantic (a semantic edge is in it), reason (null if none), stop_reason; ``failures``: target, stage, reason, blocking; ``concerns``: target, rank, reason; ``coverage``: target, status;
    ``preserved``: target and, if it has one, reason. The first that holds decides: invalid input, preservation, a sound business path, a blocking failure without an independent
    semantic business path, a concern, an unactivated, an ambiguous, a truncated path, a path inside dependencies, a blocking failure, a complete scan.
    A path that claims to reach a framework's entry without a semantic edge is unactivated too. A path's own reason, of the first that has one, goes before the usual one.
    Coverage that isn't complete on all applicable parts is a blocking failure of its own if nothing else is known of the target.
    """
    first = lambda cond, v: F.min_by(F.when(cond, F.col(v)), F.when(cond, F.col("path_seq")))
    claim = F.coalesce(F.col("stop_reason").isin(*ENTRY_CLAIMS), F.lit(False))
    paths = paths.withColumn("activated", F.col("activated") & (F.col("semantic") | ~claim))
    business = (F.col("scope") == "business") & ~F.col("ambiguous") & ~F.col("truncated")
    sound = business & F.col("complete") & F.col("activated")
    physical = F.col("scope").isin("internal", "external")
    depth = F.greatest("depth", F.lit(1))
    named = F.coalesce(F.col("reason"), F.lit("")) != ""
    p = paths.groupBy("target").agg(
        F.count("*").alias("n_paths"), F.count_if(business & (depth == 1)).alias("direct_callers"), F.min(F.when(business, depth)).alias("reach"), F.bool_or(sound).alias("sound"), first(sound & named, "reason").alias("sound_reason"),
        F.bool_or(sound & (F.col("stop_reason") == ENTRY_CLAIMS[0])).alias("entry"), F.bool_or(business & F.col("complete") & F.col("semantic")).alias("independent"), F.bool_or(~F.col("activated")).alias("unactivated"),
        F.bool_or("ambiguous").alias("ambiguous"), F.bool_or("truncated").alias("truncated"), first(F.col("truncated"), "stop_reason").alias("stop_reason"), F.bool_or(physical).alias("physical"), first(physical & named, "reason").alias("physical_reason"),
    )
    stage = F.when(F.col("stage") == "input-validation", 0).when(F.col("stage") == "coverage", 2).otherwise(1)
    f = failures.where("blocking").groupBy("target").agg(F.min(F.struct(stage.alias("bucket"), "stage", "reason")).alias("failure"))
    c = concerns.groupBy("target").agg(F.min(F.struct("rank", "reason")).alias("concern"))
    applicable = F.col("status") != NOT_APPLICABLE
    v = coverage.groupBy("target").agg(F.count_if(applicable).alias("applicable"), F.count_if(applicable & (F.col("status") != "complete")).alias("open"))
    k = preserved.groupBy("target").agg(F.lit(True).alias("kept"), (F.min("reason") if "reason" in preserved.columns else F.lit(None).cast("string")).alias("kept_reason"))
    all_of = reduce(lambda a, b: a.join(b, "target", "left"), [p, f, c, v, k], targets.select("target").distinct())
    yes = lambda x: F.coalesce(F.col(x), F.lit(False))
    gap = (F.coalesce("open", F.lit(0)) > 0) & F.col("n_paths").isNull() & F.col("concern").isNull() & ~yes("kept")
    # The coverage failure is last among the blocking ones.
    blocked, blocking_reason = F.col("failure").isNotNull() | gap, F.coalesce("failure.reason", F.lit("INCOMPLETE_EVIDENCE_COVERAGE"))
    complete = (F.coalesce("applicable", F.lit(0)) > 0) & (F.col("open") == 0)
    usual = F.when(yes("entry"), ENTRY_CLAIMS[0]).otherwise("BUSINESS_ARTIFACT_BYTECODE_USAGE")
    rules = [
        (F.coalesce(F.col("failure.bucket") == 0, F.lit(False)), "not_analyzed", F.col("failure.reason")), (yes("kept"), "not_impacted", F.coalesce("kept_reason", F.lit("API_PRESERVED"))),
        (yes("sound"), "reachable", F.coalesce("sound_reason", usual)), (blocked & ~yes("independent"), "not_analyzed", blocking_reason),
        (F.col("concern").isNotNull(), "uncertain", F.col("concern.reason")), (yes("unactivated"), "uncertain", F.lit("FRAMEWORK_ACTIVATION_UNPROVEN")), (yes("ambiguous"), "uncertain", F.lit("UNQUALIFIED_SIGNATURE_TYPE_AMBIGUOUS")),
        (yes("truncated"), "not_analyzed", F.coalesce(F.nullif("stop_reason", F.lit("")), F.lit("EVIDENCE_PATH_TRUNCATED"))), (yes("physical"), "uncertain", F.coalesce("physical_reason", F.lit("PACKAGED_DEPENDENCY_BYTECODE_USAGE"))), (blocked, "not_analyzed", blocking_reason),
        (complete, "not_found_in_static_analysis", F.lit("NO_STATIC_PATH")),
    ]
    status = reduce(lambda a, r: a.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1])).otherwise("not_analyzed")
    reason = reduce(lambda a, r: a.when(r[0], r[2]), rules[1:], F.when(rules[0][0], rules[0][2])).otherwise("INCOMPLETE_EVIDENCE")
    return all_of.select("target", status.alias("status"), reason.alias("reason"), F.coalesce("direct_callers", F.lit(0)).alias("direct_callers"), F.coalesce("reach", F.lit(0)).cast("bigint").alias("business_reach_depth"))


def worst_coverage(status: Column) -> Column:
    """An aggregate: the worst coverage of a group; not_applicable if nothing in it applies. Unknown words are passed over."""
    order = F.array(*map(F.lit, COVERAGE))
    return F.coalesce(F.get(order, (F.max(F.array_position(order, status)) - 1).cast("int")), F.lit(NOT_APPLICABLE))


def analysis_status(dependencies: DataFrame, binary: DataFrame, diff: DataFrame) -> DataFrame:
    """``coord, status, apis, binary_runs, failed_runs, diff_rows, reasons`` of every dependency.

    ``dependencies``: coord; ``binary``: coord, outcome (ok or a reason), apis; ``diff``: coord, rows, skipped (reason or null). A dependency is analyzed if a
    binary run worked, partial if only a diff did, failed if all runs failed, skipped if a diff was passed over, else not_started.
    """
    ok = F.col("outcome") == "ok"
    b = binary.groupBy("coord").agg(F.count("*").alias("binary_runs"), F.count_if(~ok).alias("failed_runs"), F.sum(F.when(ok, F.col("apis")).otherwise(0)).alias("apis"), F.array_sort(F.collect_set(F.when(~ok, F.col("outcome")))).alias("why"))
    g = diff.groupBy("coord").agg(F.sum("rows").alias("diff_rows"), F.array_sort(F.collect_set("skipped")).alias("skipped"))
    j = dependencies.select("coord").distinct().join(b, "coord", "left").join(g, "coord", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = F.when(n("binary_runs") > n("failed_runs"), "analyzed").when(n("diff_rows") > 0, "partial").when(n("binary_runs") > 0, "failed").when(F.coalesce(F.size("skipped"), F.lit(0)) > 0, "skipped").otherwise("not_started")
    reasons = F.array_join(F.array_sort(F.array_union(F.coalesce("why", F.array().cast("array<string>")), F.coalesce("skipped", F.array().cast("array<string>")))), "|")
    return j.select("coord", status.alias("status"), *[n(c).alias(c) for c in ("apis", "binary_runs", "failed_runs", "diff_rows")], reasons.alias("reasons"))


def representatives(rows: DataFrame, key: str, status: str, severity: str, depth: str, name: str, samples: int = 20) -> DataFrame:
    """The first ``samples`` rows of each key with their ``rank``: by verdict, severity, falling depth and name; rank 1 is the representative."""
    order = [order_of(F.col(status), STATUS_ORDER), order_of(F.col(severity), SEVERITIES), F.desc(F.coalesce(F.col(depth), F.lit(0))), F.coalesce(F.col(name), F.lit(""))]
    return top_k(rows, [key], order, samples)


def module_of(path: Column) -> Column:
    """The folder before src/main/java or src/main/kotlin in a file's path; '' if there is none."""
    return F.regexp_extract(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), r"(?:^|/)([^/]+)/+src/+main/+(?:java|kotlin)(?:/|$)", 1)


def merge_results(rows: DataFrame, identity: list[str], status: str, version: str) -> DataFrame:
    """One row for each identity and verdict: ``n`` and the version, blank if the rows don't agree on one (blank ones aside)."""
    seen = F.collect_set(F.nullif(F.trim(F.coalesce(F.col(version), F.lit(""))), F.lit("")))
    return rows.groupBy(*identity, status).agg(F.count("*").alias("n"), seen.alias("_v")).withColumn(version, F.when(F.size("_v") == 1, F.get("_v", F.lit(0))).otherwise("")).drop("_v")


def dependency_conclusion(rows: DataFrame, key: str, status: str, complete: Column) -> DataFrame:
    """``key, conclusion, n`` and counts by verdict: affected if any row is reachable, else open if any row or the analysis is, else unaffected.

    ``complete`` says of each row whether its analysis saw everything; a dependency without such proof is never unaffected. If the table has exactly one key, rows without a key count as its own.
    """
    keys = rows.where(F.col(key).isNotNull()).agg(F.min(key).alias("_one"), F.countDistinct(key).alias("_n"))
    # One row.
    given = rows.crossJoin(F.broadcast(keys)).withColumn(key, F.coalesce(F.col(key), F.when(F.col("_n") == 1, F.col("_one"))))
    count = lambda *s: F.count_if(F.col(status).isin(*s))
    g = given.groupBy(key).agg(F.count("*").alias("n"), count("reachable").alias("n_reachable"), count("uncertain", "not_analyzed").alias("n_open"), F.bool_and(F.coalesce(complete, F.lit(False))).alias("_complete"))
    conclusion = F.when(F.col("n_reachable") > 0, "affected").when((F.col("n_open") > 0) | ~F.col("_complete"), "open").otherwise("unaffected")
    return g.select(key, conclusion.alias("conclusion"), "n", "n_reachable", "n_open")


def api_coverage(apis: DataFrame, failures: DataFrame) -> DataFrame:
    """``api, coverage, reasons``: failed if a blocking failure concerns the api, partial if another does, else complete. ``failures``: api, reason, blocking."""
    f = failures.groupBy("api").agg(F.bool_or("blocking").alias("_b"), F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reasons"))
    return apis.select("api").distinct().join(f, "api", "left").select("api", F.when(F.col("_b"), "failed").when(F.col("_b").isNotNull(), "partial").otherwise("complete").alias("coverage"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def guidance(findings: DataFrame, reason: str, target: str, samples: int = 5) -> DataFrame:
    """``reason, n, targets, samples``: how often each reason occurs, for how many targets, and the first ``samples`` of them in order."""
    each = findings.groupBy(reason, target).agg(F.count("*").alias("_n"))
    counts = each.groupBy(F.col(reason).alias("reason")).agg(F.sum("_n").alias("n"), F.count("*").alias("targets"))
    # Spark keeps the first rows of each reason in every task before it sorts them together, so that a hot reason is no large sort.
    place = F.row_number().over(Window.partitionBy(reason).orderBy(target))
    first = each.select(reason, target).withColumn("_k", place).where(F.col("_k") <= samples)
    first = first.groupBy(F.col(reason).alias("_reason")).agg(F.array_join(F.array_sort(F.collect_list(F.col(target).cast("string"))), "|").alias("samples"))
    return counts.join(first, F.col("reason").eqNullSafe(F.col("_reason"))).select("reason", "n", "targets", "samples")


def contract_diff(old: DataFrame, new: DataFrame, carriers: DataFrame) -> DataFrame:
    """``owner, field, change`` (field_added, field_removed, field_type_changed) of owners that carry data; each side: owner, field, type."""
    c = carriers.select("owner").distinct()
    o, n = old.join(c, "owner", "left_semi").select("owner", "field", F.col("type").alias("o")), new.join(c, "owner", "left_semi").select("owner", "field", F.col("type").alias("n"))
    change = F.when(F.col("o").isNull(), "field_added").when(F.col("n").isNull(), "field_removed").when(F.col("o") != F.col("n"), "field_type_changed")
    return o.join(n, ["owner", "field"], "full").select("owner", "field", change.alias("change")).where("change IS NOT NULL")


def max_class_versions(classes: DataFrame, dependency: str, major: str, versioned: Column) -> DataFrame:
    """``dependency, base_major, versioned_major``: the largest class version among plain classes, and among those of multi-release folders."""
    return classes.groupBy(dependency).agg(F.max(F.when(~versioned, F.col(major))).alias("base_major"), F.max(F.when(versioned, F.col(major))).alias("versioned_major"))


def first_needles(entries: DataFrame, jar: str, order: str, needles: dict[str, Column]) -> DataFrame:
    """``jar, risk, entry``: for each risk the first entry, in ``order``, in which its needle is found."""
    g = entries.groupBy(jar).agg(*[F.min(F.when(found, F.col(order))).alias(f"_{k}") for k, found in enumerate(needles.values())])
    each = F.explode(F.array(*[F.struct(F.lit(risk).alias("risk"), F.col(f"_{k}").alias("entry")) for k, risk in enumerate(needles)])).alias("_r")
    return g.select(jar, each).select(jar, "_r.risk", "_r.entry").where("entry IS NOT NULL")


def uniqueness_gate(rows: DataFrame, keys: list[str], content: str) -> DataFrame:
    """``rows``, unless a key has several contents: then ValueError with up to five of them. The check runs when this is called."""
    wrong = rows.groupBy(*keys).agg(F.countDistinct(content).alias("n")).where("n > 1").orderBy(*keys).limit(5).collect()
    if wrong:
        raise ValueError("several contents under one identity: " + "; ".join(":".join(str(r[k]) for k in keys) for r in wrong))
    return rows


def topology_coverage(observed: DataFrame, name: str, required: list[str], covered: list[str], mode: str = "guard", evidence: bool = True) -> DataFrame:
    """One row: the required kinds that are ``missing``, those ``newly_observed``, whether coverage is ``complete``, the case may be a ``target``, or must ``rotate``."""
    seen = observed.agg(F.array_sort(F.collect_set(name)).alias("seen"))  # kinds, not rows
    need, had, eligible = F.array(*map(F.lit, required)).cast("array<string>"), F.array(*map(F.lit, covered)).cast("array<string>"), mode in ("discovery", "convergence")
    missing, fresh = F.array_sort(F.array_except(need, F.col("seen"))), F.array_sort(F.array_except(F.col("seen"), had))
    return seen.select(
        F.array_join(missing, "|").alias("missing"), F.array_join(fresh, "|").alias("newly_observed"), (F.lit(evidence) & (F.size(missing) == 0)).alias("complete"), (F.lit(eligible) & (F.size(fresh) > 0)).alias("target"),
        (F.lit(eligible) & (F.size(fresh) == 0)).alias("rotate"),
    )


def step_summary(rows: DataFrame, by: str, across: str, values: list[str]) -> DataFrame:
    """Counts of rows by two columns: one row for each ``by``, a column for each of the ``values`` and their total."""
    p = rows.groupBy(by).agg(*[F.count_if(F.col(across) == v).alias(v.lower()) for v in values], F.count("*").alias("total"))
    return p


def signal_rollup(signals: DataFrame, kind: str, severity: str, order: tuple[str, ...]) -> DataFrame:
    """``kind, severity, n, worst`` by kind and severity; ``worst`` tells whether no graver severity of the kind occurs."""
    g = signals.groupBy(kind, severity).agg(F.count("*").alias("n")).withColumn("_o", order_of(F.col(severity), order))
    return g.withColumn("worst", F.col("_o") == F.min("_o").over(Window.partitionBy(kind))).drop("_o")


def ledger_order() -> list[Column]:
    """The order of a ledger: verdict, severity, coordinate, symbol, path, sequence; never the order in which rows came."""
    return [order_of(F.col("status"), STATUS_ORDER), order_of(F.col("severity"), SEVERITIES), F.col("coord").asc_nulls_last(), F.col("symbol").asc_nulls_last(), F.col("path_id").asc_nulls_last(), F.col("seq")]


def _compatible(a: tuple, b: tuple) -> bool:
    return len(a) == len(b) and all(not x or not y or x == y for x, y in zip(a, b))


def count_variants(variants: list[tuple]) -> int:
    """The least number of groups of mutually compatible signatures (tuples; '' is unknown); see colouring."""
    return colouring(variants)[0]


def colouring(variants: list[tuple], steps: int = 500_000) -> tuple[int, bool]:
    """The least number of groups of mutually compatible signatures, a colouring of their conflicts, and whether it is proved to be the least.

    Signatures that conflict with no more than another one they agree with take its group, and those with fewer conflicts than a set of mutual conflicts has members always
    find one: both are left out, again and again. What remains is solved part by part by branch and bound; only if that takes more than ``steps``
    steps is the best number found so far given, unproved.
    """
    nodes = sorted(set(variants))
    masks = [sum(1 << j for j, b in enumerate(nodes) if j != i and not _compatible(a, b)) for i, a in enumerate(nodes)]
    bits = lambda m: [k for k in range(m.bit_length()) if m >> k & 1]

    def clique(alive: int) -> int:
        most = 0
        for start in sorted(bits(alive), key=lambda k: -(masks[k] & alive).bit_count())[:20]:
            size, room = 1, masks[start] & alive
            while room:
                k = max(bits(room), key=lambda k: (masks[k] & room).bit_count())
                size, room = size + 1, room & masks[k]
            most = max(most, size)
        return most

    alive, least = (1 << len(nodes)) - 1, 0
    while True:
        least = max(least, clique(alive)) if alive else least
        before = alive
        for i in bits(alive):
            own = masks[i] & alive
            # The group of a signature with all its conflicts and more has room for it.
            others = alive & ~own & ~(1 << i)
            if own.bit_count() < least or any(own & ~masks[j] == 0 for j in bits(others)):
                alive &= ~(1 << i)
        if alive == before:
            break
    most, proved, left = max(least, 1 if nodes else 0), True, steps
    while alive:
        part = new = alive & -alive
        while new:
            near = 0
            for k in bits(new):
                near |= masks[k] & alive
            new, part = near & ~part, part | near
        alive &= ~part
        count, sure, left = _least_colours(bits(part), masks, part, most, left)
        if count > most:
            most, proved = count, sure
        elif not sure and count == most:
            proved = proved and most <= least
    return most, proved


def _least_colours(part: list[int], masks: list[int], alive: int, enough: int, steps: int) -> tuple[int, bool, int]:
    """The least number of colours of a part, or ``enough`` if it needs no more; whether that is proved; steps left."""
    def order(coloured: int, groups: list[int]) -> int:
        open_ = [k for k in part if not coloured >> k & 1]
        return max(open_, key=lambda k: (sum(1 for g in groups if masks[k] & g), (masks[k] & alive).bit_count(), -k))

    best = len(part) + 1
    stack: list[tuple[int, list[int]]] = [(0, [])]
    first = True
    while stack and best > enough:
        coloured, groups = stack.pop()
        if len(groups) >= best:
            continue
        if coloured == alive:
            best = len(groups)
            first = False
            continue
        steps -= not first  # the first descent always comes to a colouring
        if steps < 0:
            return best, False, 0
        k = order(coloured, groups)
        free = [g for g in range(len(groups)) if not masks[k] & groups[g]]
        if len(groups) + 1 < best:
            stack.append((coloured | 1 << k, [*groups, 1 << k]))
        for g in reversed(free):
            stack.append((coloured | 1 << k, [*groups[:g], groups[g] | 1 << k, *groups[g + 1 :]]))
    return max(best, enough), True, steps


def logical_paths(paths: DataFrame, key: str, skeleton: str, signatures: str, proved: str | None = None) -> DataFrame:
    """``key, paths``: how many paths a target has when paths of one skeleton whose signatures (array, '' unknown) may agree count as one.

    ``proved`` names a column that says whether the number is certain; it is unless a skeleton's conflicts are too many and too tangled (see colouring). Where all signatures of a skeleton are known, distinct ones are counted in the JVM; only skeletons with unknown ones go to Python, a skeleton's distinct variants at a time.
    """
    ship(paths.sparkSession)
    d = paths.select(key, skeleton, signatures).distinct()
    marked = d.groupBy(key, skeleton).agg(F.count("*").alias("n"), F.bool_or(F.exists(signatures, lambda x: x == "")).alias("open"))
    known = marked.where("NOT open OR n = 1").select(key, F.col("n").cast("bigint").alias("n"), F.lit(True).alias("_sure"))

    def count(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, sure = colouring([tuple(x) for x in pdf[signatures]])
        return pd.DataFrame({"_key": [name[0]], "n": [n], "_sure": [sure]})

    kind = paths.schema[key].dataType.simpleString()
    open_ = d.join(marked.where("open AND n > 1").select(key, skeleton), [key, skeleton], "left_semi").groupBy(key, skeleton).applyInPandas(count, f"_key {kind}, n bigint, _sure boolean").withColumnRenamed("_key", key)
    sure = [F.bool_and("_sure").alias(proved)] if proved else []
    return known.unionByName(open_).groupBy(key).agg(F.sum("n").alias("paths"), *sure)


def merged_chains(chains: DataFrame, key: str, skeleton: str, signatures: str, seq: str) -> DataFrame:
    """Chains of which equivalent ones (one skeleton, signatures that may agree) are given once, by the one with most signatures.

    In the order of ``seq`` a chain joins the first kept one that it agrees with, and takes its place if it is more precise; agreeing isn't transitive,
    so that order counts.
    """
    ship(chains.sparkSession)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        rows = [tuple(x) for x in pdf.sort_values(seq)[signatures]]
        ordered = pdf.sort_values(seq).reset_index(drop=True)
        for k, s in enumerate(rows):
            at = next((i for i, j in enumerate(kept) if _compatible(rows[j], s)), None)
            if at is None:
                kept.append(k)
            elif sum(map(bool, s)) > sum(map(bool, rows[kept[at]])):
                kept[at] = k
        return ordered.iloc[kept]

    return chains.groupBy(key, skeleton).applyInPandas(merge, chains.schema)
