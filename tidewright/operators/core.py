"""Relational operators of the evidence pipeline: snapshot diffs, merges, reference joins, reconciliation.

All are DataFrame programs without Python code on the executors. Every window and every "first" has a
total order given by the caller, so results don't depend on how rows are dealt to partitions.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows that dealt_join packs in one array, about: a few dozen times fewer than a page of Parquet has, so that a pack that is given again and again is compressed away. Rows of a block, about: as many times it is given at once.
PACK, BLOCK = 256, 128


def zip_join(base: DataFrame, current: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Pair the k-th row of ``base`` with the k-th of ``current`` within a key; leftovers have a null side (columns base, current)."""
    def ranked(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).select(*keys, "k", F.struct(*rest).alias(name))

    return ranked(base, "base").join(ranked(current, "current"), [*keys, "k"], "full")


def snapshot_diff(base: DataFrame, current: DataFrame, full_key: str, artifact_key: str, order: list[str]) -> DataFrame:
    """Two-stage snapshot diff.

    First rows of equal, non-blank full key are zipped in order; what is left is paired by artifact key if exactly one
    row remains on either side, and labelled base_only, current_only or unpaired_ambiguous otherwise.
    """
    names = base.columns

    def numbered(df: DataFrame) -> DataFrame:
        keyed = F.coalesce(F.col(full_key), F.lit("")) != ""
        k = F.row_number().over(Window.partitionBy(full_key).orderBy(*order))
        # Rows without a key aren't numbered, so that they don't meet in one partition.
        return df.where(keyed).withColumn("k", k).unionByName(df.where(~keyed).withColumn("k", F.lit(None).cast("int")))

    b, c = numbered(base), numbered(current)
    left = b.select(full_key, "k", F.struct(*names).alias("base"))
    right = c.select(full_key, "k", F.struct(*names).alias("current"))
    exact = left.join(right, [full_key, "k"]).select("base", "current", F.lit("exact_coord").alias("pairing_status"))

    def rest(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
        left_over = df.join(other.where("k IS NOT NULL").select(full_key, "k"), [full_key, "k"], "left_anti")
        return left_over.select(F.col(artifact_key).alias("a"), F.struct(*names).alias(name))

    def counted(df: DataFrame, name: str) -> DataFrame:
        # A hot artifact is a count and a join that can be split, not a window in one task.
        return df.join(df.groupBy("a").agg(F.count("*").alias(f"n_{name}")), "a", "left")

    lb, lc = counted(cut(rest(b, c, "base")), "base"), counted(cut(rest(c, b, "current")), "current")
    one = lb.where("n_base = 1").join(lc.where("n_current = 1"), "a").select("base", "current", F.lit("unique_artifact_migration").alias("pairing_status"), "a")
    sides = [(lb, lc, "base"), (lc, lb, "current")]
    singles = []
    for mine, other, name in sides:
        met = other.groupBy("a").agg(F.lit(True).alias("met"))
        lone = mine.join(one.select("a"), "a", "left_anti").join(met, "a", "left")
        status = F.when(F.col("met"), "unpaired_ambiguous").otherwise(f"{name}_only")
        empty = F.lit(None).cast(mine.schema[name].dataType)
        cols = {"base": F.col("base") if name == "base" else empty, "current": F.col("current") if name == "current" else empty}
        singles.append(lone.select(cols["base"].alias("base"), cols["current"].alias("current"), status.alias("pairing_status")))
    return reduce(DataFrame.unionByName, [exact, one.drop("a"), *singles])


def set_replacements(old: DataFrame, new: DataFrame, group: str, owner: str, member: str, least: int = 2) -> DataFrame:
    """Owners of ``old`` whose members (``least`` or more) are all among those of exactly one owner of ``new``, mutually.

    Both sides: distinct (group, owner, member). Owners of equal members are one class; an equi-join of classes on the member and a count stand for containment. How many owners contain, or
    are contained in, one is a sum over classes, less itself; classes of more than two such owners (one of which may be the owner itself) can't be unique and are never expanded.
    """
    def sets_of(df: DataFrame, of: str) -> DataFrame:
        return df.where(F.col(group).isNotNull() & F.col(owner).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(owner).alias(of)).agg(F.array_sort(F.collect_set(member)).alias(f"_{of}"), F.count("*").alias("size"))

    # A null member is among those of no other owner.
    olds = cut(sets_of(old, "old").where((F.col("size") >= least) & (F.col("size") == F.size("_old"))).drop("size"))
    news = cut(sets_of(new, "new").drop("size"))
    old_classes = olds.groupBy("_g", "_old").agg(F.count("*").alias("n_old"))
    new_classes = news.groupBy("_g", "_new").agg(F.count("*").alias("n_new"))
    x, y = old_classes.withColumn("m", F.explode("_old")), new_classes.withColumn("m", F.explode("_new"))
    held = cut(x.join(y, ["_g", "m"]).groupBy("_g", "_old", "_new", "n_old", "n_new").agg(F.count("*").alias("overlap")).where(F.col("overlap") == F.size("_old")))
    # How many owners of the other side each class meets, and which owners meet themselves.
    above, below = held.groupBy("_g", "_old").agg(F.sum("n_new").alias("above")), held.groupBy("_g", "_new").agg(F.sum("n_old").alias("below"))
    self_met = olds.join(news.withColumnRenamed("new", "old"), ["_g", "old"]).where(F.size(F.array_except("_old", "_new")) == 0).select("_g", F.col("old").alias("own"))
    few = held.join(above.where("above <= 2"), ["_g", "_old"]).join(below.where("below <= 2"), ["_g", "_new"])
    pairs = few.join(olds, ["_g", "_old"]).join(news, ["_g", "_new"]).where("old != new")
    own = lambda side: self_met.select("_g", F.col("own").alias(side), F.lit(1).alias(f"self_{side}"))
    pairs = pairs.join(own("old"), ["_g", "old"], "left").join(own("new"), ["_g", "new"], "left")
    one = (F.col("above") - F.coalesce("self_old", F.lit(0)) == 1) & (F.col("below") - F.coalesce("self_new", F.lit(0)) == 1)
    return pairs.where(one).select(F.col("_g").alias(group), "old", "new", "overlap")


def best_row_merge(rows: DataFrame, keys: list[str], rank: list, seq: str, values: list[str]) -> DataFrame:
    """Merge the rows of a key: the best by ``rank`` (ties: least ``seq``) wins; later rows only fill its blanks.

    A value that the best row lacks (null) is that of the last row before it that has one, and else, like a blank one (''), that of the
    first later row whose value is neither. A blank of the best row hides what came before it. What nothing fills stays as it is.
    """
    best = F.first(seq).over(Window.partitionBy(*keys).orderBy(*rank, seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = rows.withColumn("best_seq", best)

    def value(v: str) -> Column:
        at, filled = F.col(seq), F.coalesce(F.col(v), F.lit("")) != ""
        own = F.max(F.when(at == F.col("best_seq"), F.col(v)))
        before = F.max_by(F.when((at < F.col("best_seq")) & F.col(v).isNotNull(), F.col(v)), F.when((at < F.col("best_seq")) & F.col(v).isNotNull(), at))
        later = F.min_by(F.when(filled & (at > F.col("best_seq")), F.col(v)), F.when(filled & (at > F.col("best_seq")), at))
        start = F.coalesce(own, before)
        return F.when(F.coalesce(start, F.lit("")) == "", F.coalesce(later, start)).otherwise(start).alias(v)

    return marked.groupBy(*keys).agg(F.first("best_seq").alias("best_seq"), *[value(v) for v in values])


def violations(checks: dict[str, Column]) -> Column:
    """The names of the checks that a row fails, as one string ('' if none); null counts as failed."""
    return F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])), "|")


def reference_join(targets: DataFrame, references: DataFrame, exact: list[str], candidate: list[str], target_id: str, reference_id: str) -> DataFrame:
    """References by exact key and by the weaker candidate key; a reference that is exact for a target is no candidate for it.

    ``targets`` that lack a value of ``exact`` can only be met as candidates.
    """
    hit = targets.join(references, exact).select(target_id, reference_id, F.lit("exact").alias("quality"))
    weak = targets.select(target_id, *candidate).join(references.select(reference_id, *candidate), candidate).select(target_id, reference_id)
    weak = weak.join(hit.select(target_id, reference_id), [target_id, reference_id], "left_anti")
    return hit.unionByName(weak.withColumn("quality", F.lit("candidate")))


def reference_numbers(targets: DataFrame, references: DataFrame, exact: list[str], candidate: list[str], target_id: str) -> DataFrame:
    """``target_id, exact, candidate``: how many references each target has by either key; what reference_join gives, counted without its pairs.

    ``candidate`` is part of ``exact``, so that each exact reference is taken off the candidates. Targets are distinct rows; references of equal exact keys count once; targets without any reference have zeros.
    """
    if not {*candidate} <= {*exact}:
        raise ValueError("the candidate key must be part of the exact one")
    # Dealt by the weaker key, which serves all three counts, so that references are shuffled once; a number of partitions that is told isn't made less, which keeps tasks small.
    parts = int(references.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = references.select(*exact).repartition(parts, *candidate).groupBy(*exact).agg(F.lit(1).cast("bigint").alias("_n"))
    sure = targets.join(n, exact).groupBy(target_id).agg(F.sum("_n").alias("_e"))
    weak = targets.select(target_id, *candidate).join(n.groupBy(*candidate).agg(F.sum("_n").alias("_w")), candidate, "left").groupBy(target_id).agg(F.sum("_w").alias("_w"))
    e, w = (F.coalesce(c, F.lit(0)) for c in ("_e", "_w"))
    return weak.join(sure, target_id, "left").select(target_id, e.alias("exact"), (w - e).alias("candidate"))


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join by equal ``keys`` where few keys have many rows on both sides, so that pairs are far more than rows (repeated rows give repeated pairs).

    Rows of ``left`` are dealt to blocks of about BLOCK; those of ``right`` go to every block, packed in arrays of about PACK. So each task makes an equal share of any key's pairs, and
    nothing but the two sides is shuffled or held. A pack is given for one row of its block after the other: pairs, where they are written, repeat within short runs and take a fraction of a byte each.
    """
    parts, packs = 4 * left.sparkSession.sparkContext.defaultParallelism, -(-right.count() // PACK) or 1
    blocks = max(parts, -(-left.count() // BLOCK))
    mine, other = ([c for c in df.columns if c not in keys] for df in (left, right))
    one = left.withColumn("_block", F.pmod(F.xxhash64(*mine), F.lit(blocks)))
    packed = right.withColumn("_pack", F.pmod(F.xxhash64(*other), F.lit(packs))).repartition(parts, "_pack").groupBy(*keys, "_pack").agg(F.collect_list(F.struct(*other)).alias("_rows"))
    every = packed.select(*keys, "_rows", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("_block"))
    by = lambda df: df.repartition(parts, "_block")
    return by(one).hint("shuffle_hash").join(by(every), [*keys, "_block"]).select(*keys, *mine, F.explode("_rows").alias("_row")).select(*keys, *mine, *[F.col("_row")[c].alias(c) for c in other])


def reconcile(analyzer: DataFrame, oracle: DataFrame, identity: list[str], relation: list[str], valid: Column | None = None, present: Column | None = None) -> DataFrame:
    """``relation, verdict, n`` for two multisets of edges, of which as many as possible are matched one by one.

    Verdicts, the first that holds: provenance_invalid (a row that isn't ``valid``), oracle_conflict (rows of an identity that say ``present`` and
    others that say it is absent), matched (equal identity on both sides; counts pairs), variant (equal relation only; counts pairs),
    analyzer_only, oracle_only. Both tables have the identity columns, which contain the relation's. Only counts are shuffled: a hot
    identity is one row for each partition. An identity that is absent on all its rows is not matched but left over.
    """
    valid, present = valid if valid is not None else F.lit(True), present if present is not None else F.lit(True)

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(*identity, F.coalesce(valid, F.lit(False)).alias("_valid"), F.coalesce(present, F.lit(False)).alias("_present"), F.lit(1 - n).cast("bigint").alias("_a"), F.lit(n).cast("bigint").alias("_o"))

    def total(mask: Column, name: str) -> list[Column]:
        return [F.sum(F.when(mask, F.col(c)).otherwise(0)).alias(f"{name}{c}") for c in ("_a", "_o")]

    here, gone = F.col("_valid") & F.col("_present"), F.col("_valid") & ~F.col("_present")
    counts = side(analyzer, 0).unionByName(side(oracle, 1)).groupBy(*identity).agg(*total(here, "_here"), *total(gone, "_gone"), F.count_if(~F.col("_valid")).alias("_invalid"))
    present_n, gone_n = F.col("_here_a") + F.col("_here_o"), F.col("_gone_a") + F.col("_gone_o")
    clash = (present_n > 0) & (gone_n > 0)
    calm = lambda c: F.when(clash, 0).otherwise(c)
    exact = calm(F.least("_here_a", "_here_o"))
    parts = {
        "_invalid": F.col("_invalid"), "_conflict": F.when(clash, present_n + gone_n).otherwise(0), "_exact": exact, "_left_a": calm(F.col("_here_a")) - exact, "_left_o": calm(F.col("_here_o")) - exact,
        "_absent_a": calm(F.col("_gone_a")), "_absent_o": calm(F.col("_gone_o")),
    }
    found = counts.select(*relation, *[c.alias(n) for n, c in parts.items()]).groupBy(*relation).agg(*[F.sum(n).alias(n) for n in parts])
    pairs = F.least("_left_a", "_left_o")
    verdicts = {
        "provenance_invalid": F.col("_invalid"), "oracle_conflict": F.col("_conflict"), "matched": F.col("_exact"), "variant": pairs,
        "analyzer_only": F.col("_left_a") - pairs + F.col("_absent_a"), "oracle_only": F.col("_left_o") - pairs + F.col("_absent_o"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), n.cast("bigint").alias("n")) for v, n in verdicts.items()])).alias("_v")
    return found.select(*relation, each).select(*relation, "_v.verdict", "_v.n").where("n > 0")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, value: str, span: str = "month") -> DataFrame:
    """``left`` with the ``value`` of the latest row of ``right`` not after ``at``, without a range join.

    Of rows of equal time the largest value counts; a row of ``left`` sees rows of its own time; null keys meet null keys, and null times null times alone. Rows are sorted within a key
    and a ``span`` of time, so that a hot key is many sorts; the last value of each span is carried over to the next ones, a row for each key and span.
    """
    kind = right.schema[value].dataType
    month = F.date_trunc(span, F.col("_t").cast("timestamp"))
    l = left.select(*left.columns, F.col(at).alias("_t"), F.lit(2).alias("_side"), F.lit(None).cast(kind).alias("_v")).withColumn("_span", month)
    fill = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in keys]
    r = right.select(*keys, F.col(since).alias("_t"), F.col(value).alias("_v")).withColumn("_span", month)
    # The last value of each span, and for each span of ``left`` the last one before it: a row for each key and span.
    ends = r.where("_v IS NOT NULL AND _span IS NOT NULL").groupBy(*keys, "_span").agg(F.max(F.struct("_t", "_v")).alias("_end"), F.lit(False).alias("_asked"))
    asked = l.select(*keys, "_span").distinct().select(*keys, "_span", F.lit(None).cast(ends.schema["_end"].dataType).alias("_end"), F.lit(True).alias("_asked"))
    spans = ends.unionByName(asked).groupBy(*keys, "_span").agg(F.max("_end").alias("_end"), F.bool_or("_asked").alias("_asked"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_v", F.last("_end", ignorenulls=True).over(before)["_v"]).where("_asked AND _v IS NOT NULL")
    # It goes ahead of the span's own rows, so that the large tables are dealt out and sorted once.
    ahead = carried.select(*keys, *fill, F.lit(None).cast(left.schema[at].dataType).alias("_t"), F.lit(0).alias("_side"), "_v", "_span")
    both = l.unionByName(r.select(*keys, *fill, "_t", F.lit(1).alias("_side"), "_v", "_span")).unionByName(ahead)
    inside = Window.partitionBy(*keys, "_span").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("as_of", F.last("_v", ignorenulls=True).over(inside)).where("_side = 2").select(*left.columns, "as_of")


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key by a total order, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def ordered_distinct(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Each combination of ``keys`` (nulls are equal) once, with the ``seq`` of its first row and its ``place`` among the others in the order of those, from 1."""
    first = rows.groupBy(*keys).agg(F.min(seq).alias(seq))
    return global_rank(first, [F.col(seq), *[F.col(k) for k in keys]], "place")


def first_rule(rows: DataFrame, rules: list[tuple[str, Column]], otherwise: str = "none") -> Column:
    """The name of the first rule that holds."""
    return reduce(lambda c, r: c.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0])).otherwise(otherwise)


def global_rank(df: DataFrame, order: list, rank: str = "rank") -> DataFrame:
    """``df`` with the place of each row in a total ``order``, from 1, without one task that sees all rows.

    Rows are dealt to ranges of the order, numbered there, and moved up by the sizes of the ranges before; a range's size is all that comes to the driver.
    """
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = cut(dealt)  # ranges are drawn from a sample, so they must be fixed before they are read twice
    sizes = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for k, n in sizes:
        starts.append((k, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "_range int, _before bigint")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    # One row for each partition.
    return dealt.join(F.broadcast(offsets), "_range").withColumn(rank, place.cast("bigint")).drop("_range", "_before")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder, so that lost executors and long lineages do no harm."""
    _folder(df)
    return df.checkpoint()


def _folder(df: DataFrame) -> str:
    """The application's checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="tidewright-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder as Parquet: for many rows, which take a fraction of the room that ``cut`` needs. How rows are dealt is not kept."""
    path = f"{_folder(df)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of frames that ``cut`` or ``stored`` has written and that nothing reads any more."""
    for df in frames:
        if (path := getattr(df, "stored_at", None)) is None:
            plan = df._jdf.queryExecution().analyzed()
            if plan.getClass().getSimpleName() != "LogicalRDD":
                continue
            held = plan.rdd().getCheckpointFile()
            if not held.isDefined():
                continue
            path = held.get()
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
