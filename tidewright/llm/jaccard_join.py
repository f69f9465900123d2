"""N-gram Jaccard join: all links of at least a given set similarity, and their components.

A document's set is its distinct word n-grams, as 64-bit hashes. Two sets of sizes a and b whose
similarity is at least s share enough that, in any one order of all n-grams, they meet within the
first ``size - ceil(s * size) + 1`` of each (its prefix). The order used here takes a fixed part of the
hash space first, rare n-grams before frequent ones, and the rest of the space after it, so that
document frequencies are needed for that part only. N-grams of one document alone fill up prefixes
but can't link anything, which leaves most documents without a key.

1. Documents with equal sets form a class; only one member of each goes on.
2. Classes of identical prefix, size and sketch (the n-grams of the first part) form a group; each group has one key for every
   prefix n-gram and size band (a link spans two neighbouring bands at most).
3. Two groups that meet under a key of at most ``FEW`` groups belong to one cluster if their sizes, the places of the key's
   n-gram in them and their sketches leave room for a link: n-grams that only one of two sets has are at most
   (100 - s) / (100 + s) of both sizes. So chance meetings don't tie a corpus together as it grows. A more frequent key is divided by a second
   n-gram, as linked sets share two within prefixes that are longer by one; where that is frequent too, each group is
   paired with the smallest one alone, so pairs stay as many as keys, however large a group of copies is.
4. Groups are expanded, and the classes of a cluster are verified on their whole sets: those of a
   cluster are dealt into chunks of bounded size and number, and every two chunks meet in a task of their own, which
   counts shared n-grams of all its pairs at once and returns a spanning forest of its links. Chunks whose
   classes are all connected already aren't compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import as_scan, batch_bytes, bounded, check_hash_seed, drop_rows, give_back, located, release, slices, spread, stage, staged, sweep, table
from .components import components

#: The part of the hash space whose n-grams come first, and have their document frequencies counted, is so many
#: times the part of a set that its prefix takes up.
ROOM = 2.0
#: Members of a chunk at most, and n-grams in it about.
CHUNK, CHUNK_GRAMS = 512, 600_000
#: Groups of a key of which all pairs are looked at.
FEW = 64
#: Bits of the map that tells n-grams of one class alone from others before they are shuffled.
MAP_BITS = 1 << 26
#: A class, its cluster, the cluster's number of chunks and the class's chunk.
_DEALT = ("class", "cluster", "chunks", "chunk")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _A
    x ^= x >> np.uint64(29)
    x *= _B
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; with fewer words, of the whole sequence as one."""
    words = text.lower().split()  # bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    size = min(n, len(h))
    x = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        x = _mix(x * _B + h[k : len(h) - size + 1 + k])
    return np.unique(x)


def first_part(percent: int) -> int:
    """The hash below which n-grams come first in the order."""
    return int(min(0.5, ROOM * (100 - percent) / 100 or 0.01) * 2**63) * 2 - 1


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _sets(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Row locator, identifier, size, digest of the set, and the n-grams that its prefix may hold."""
    check_hash_seed()
    import xxhash

    theta = np.uint64(first_part(percent))
    for b in slices(batches):
        sizes, digests, firsts = [], [], []
        for text in batch_bytes(b.column("text")):
            s = shingles(text, n)
            first = s[: max(int(np.searchsorted(s, theta)), int(prefix_size(np.array(len(s)), percent)) + 1)] if len(s) else s
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            # Sets of under ten can only reach a share of 0.9 if they are equal, and so on for other shares.
            alone = len(s) * (100 - percent) < percent and (len(s) + 1) * percent > 100 * len(s)
            firsts.append((first[:0] if alone else first).view(np.int64))
        grams = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32), np.concatenate(firsts or [np.empty(0, np.int64)]))
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("row"), b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), grams.cast(pa.list_(pa.int64()))], ["file", "row", "doc_id", "n", "digest", "first"])


def _whole(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    check_hash_seed()
    for b in slices(batches):
        grams = pa.array([shingles(t, n).tobytes() for t in batch_bytes(b.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in _DEALT], grams], [*_DEALT, "grams"])


def links_between(sets: list[np.ndarray], percent: int, label: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``; those of equal ``label`` count as connected."""
    size = np.array([len(s) for s in sets])
    grams, index = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(index)[index] > 1
    index, owner = index[shared], owner[shared]
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, min(8192, 8_000_000 // len(sets)))
    if len(index):
        index = np.cumsum(np.concatenate([[0], index[1:] != index[:-1]]))
        for low in range(0, int(index[-1]) + 1, width):
            i, j = np.searchsorted(index, [low, low + width])
            m = np.zeros((len(sets), width), np.float32)
            m[owner[i:j], index[i:j] - low] = 1
            overlap += m @ m.T  # exact: counts stay far below 2 ** 24
    overlap = overlap.astype(np.int64)
    union = size[:, None] + size[None, :] - overlap
    label = np.array(label)
    a, b = np.nonzero(np.triu((100 * overlap >= percent * union) & (overlap > 0) & (label[:, None] != label[None, :]), 1))
    parent = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(int(label[x])), find(int(label[y]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            found.append((x, y))
    return found


def _verify(key: tuple, pdf, percent: int):
    import pandas as pd

    sets = [np.frombuffer(x, np.uint64) for x in pdf["grams"]]
    ids = pdf["class"].tolist()
    labels = pd.factorize(pdf["label"])[0].tolist()
    found = links_between(sets, percent, labels) if len(set(labels)) > 1 else []
    give_back()
    return pd.DataFrame({"a": [ids[x] for x, _ in found], "b": [ids[y] for _, y in found]}, dtype="int64")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row for each row of ``docs``: ``file, row, doc_id, n_shingles, component_id``.

    Words are lower-cased (A-Z) runs of other than ASCII white space. ``component_id`` is the smallest
    identifier that links reach, the row's own included. Null and empty texts have no set and no links; null
    identifiers are passed over for ``component_id``, which is null only if a component has no other;
    repeated rows share a class. Other columns of ``docs`` are not read. ``percent`` is at least 50.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = docs.sparkSession
    rows = located(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "file", "row")
    made = spread(rows).mapInArrow(lambda it: _sets(it, n, percent), "file string, row bigint, doc_id bigint, n bigint, digest binary, first array<bigint>")
    mark = staged()
    sets = stage(made.withColumn("id", F.monotonically_increasing_id()), "join-sets")

    light = stage(sets.withColumn("set", F.xxhash64("digest", "n")).drop("first", "digest"), "join-rows")
    prefixes = _prefixes(sets, percent)
    sweep(spark, mark, [light, prefixes])
    release(spark)
    of_set = _components_of(rows, light, prefixes, n, percent)
    sweep(spark, mark, [light, of_set])
    release(spark)
    with_set = light.where("n > 0").join(of_set, "set").select("file", "row", "doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_set.unionByName(light.where("n = 0").select("file", "row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Staged ``class, n, alone, prefix, further, sketch, grp`` (alone: n-grams of the first part in no other class, which come before; further: the prefix and the n-gram after it; sketch: the first part's other n-grams) of the classes that share a prefix n-gram with another; a class is the number of the member that stands for it."""
    # Classes of equal sets; the member with the smallest number stands for each.
    held = sets.where("size(first) > 0")
    numbers = held.select(F.xxhash64("digest", "n").alias("set"), "id")
    others = numbers.join(numbers.groupBy("set").agg(F.min("id").alias("class")), "set").where("id != class").select("id")
    chosen = drop_rows(held, stage(others, "join-others"), ["id"])
    grams = chosen.select(F.col("id").alias("class"), "n", "first")
    ahead = lambda x: (x >= 0) & (x < F.lit(first_part(percent)))

    # Prefix keys: n-grams of one class alone come first and fill the prefix, the others follow by (part of the space, frequency, hash).
    each = grams.select(F.explode("first").alias("gram"))
    frequent = stage(each.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"), "join-frequent")
    each = _possibly(grams, frequent)
    later = F.when(ahead(F.col("gram")), 0).otherwise(1)
    shared = each.join(frequent, "gram").select("class", "df", "gram").repartition("class").groupBy("class").agg(F.array_sort(F.collect_list(F.struct(later.alias("later"), "df", "gram"))).alias("shared"))
    need = F.col("n") - F.floor((F.lit(percent) * F.col("n") + 99) / 100).cast("bigint") + 1
    # What a set is asked for beside its shared n-grams: the list of all itself isn't shuffled.
    about = grams.select("class", "n", F.size("first").alias("held"), F.size(F.filter("first", ahead)).alias("ahead"), F.element_at("first", -1).alias("last"))
    alone = F.col("ahead") - F.size(F.filter("shared", lambda x: x.later == 0))
    # Beyond the first part the order is that of hashes, and a set holds one n-gram more than its prefix has.
    last, room = F.col("last"), F.greatest(need - alone, F.lit(0)).cast("int")
    tail = (F.col("held") > need) & ~ahead(last)
    prefix = F.when(tail, F.filter("shared", lambda x: x.gram != last)).otherwise(F.slice("shared", F.lit(1), room))
    further = F.when(tail, F.col("shared")).otherwise(F.slice("shared", F.lit(1), room + 1))
    names = lambda c: F.transform(c, lambda x: x.gram)
    prefixes = about.join(shared, "class").where(F.size(prefix) > 0).select("class", "n", alone.alias("alone"), names(prefix).alias("prefix"), names(further).alias("further"), names(F.filter("shared", lambda x: x.later == 0)).alias("sketch"))
    return stage(prefixes.withColumn("grp", F.xxhash64("n", "alone", "prefix", "further", "sketch")), "join-prefixes")


def _met(prefixes: DataFrame, percent: int) -> DataFrame:
    """Staged ``a, b``: pairs of groups whose components are the clusters."""
    bands = F.floor(F.log(F.col("n").cast("double")) / -np.log(percent / 100.0 - 1e-9)).cast("bigint") if percent < 100 else F.col("n")
    groups = stage(prefixes.groupBy("grp").agg(*[F.first(c).alias(c) for c in ("n", "alone", "prefix", "further", "sketch")]), "join-groups")
    # Only what one set has and not the other, at most so many n-grams: of the first n-gram that two sets share, all before it.
    most = lambda n, m: F.floor((100 - percent) * (n + m) / (100 + percent))

    def under(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs of groups that may be near under keys of few groups, and the rows of the other keys."""
        several = stage(keys.groupBy("key").agg(F.min("grp").alias("least"), F.count("*").alias("many")).where("many > 1"), "join-keys")
        held = keys.join(several.where(F.col("many") <= FEW).select("key"), "key").groupBy("key").agg(F.collect_list(F.struct("grp", "n", "at")).alias("all"))
        x = {c: F.col(f"x.{c}") for c in ("grp", "n", "at")}
        may = lambda y: (x["grp"] < y["grp"]) & (x["at"] + y["at"] <= most(x["n"], y["n"])) & (F.abs(x["n"] - y["n"]) <= most(x["n"], y["n"]))
        pairs = held.select(F.explode("all").alias("x"), "all").select(x["grp"].alias("a"), F.explode(F.filter("all", may)).alias("y"))
        return pairs.select("a", F.col("y.grp").alias("b")).distinct(), keys.join(several.where(F.col("many") > FEW), "key")

    keys = groups.select("grp", "n", "alone", F.posexplode("prefix").alias("at", "gram"), bands.alias("band"))
    keys = keys.select("grp", "n", (F.col("alone") + F.col("at")).alias("at"), "gram", F.explode(F.array(F.xxhash64("gram", "band"), F.xxhash64("gram", F.col("band") + 1))).alias("key"))
    pairs, hot = under(keys)
    # Sets of which a link needs one n-gram alone have no second one.
    second = F.concat(F.array_except("further", F.array("gram")), F.when(F.col("n") * percent <= 100, F.array("gram")).otherwise(F.array().cast("array<bigint>")))
    twice = hot.select("grp", "n", "at", "gram", "key").join(groups.select("grp", "further"), "grp").select("grp", "n", "at", "key", F.explode(second).alias("second"))
    more, hot = under(stage(twice.select("grp", "n", "at", F.xxhash64("key", "second").alias("key")), "join-twice"))
    star = hot.where("grp != least").select(F.col("grp").alias("a"), F.col("least").alias("b")).distinct()
    pairs = pairs.unionByName(more).distinct()
    one = groups.select(F.col("grp").alias("a"), "n", "alone", "sketch")
    two = groups.select(F.col("grp").alias("b"), F.col("n").alias("m"), F.col("alone").alias("lone"), F.col("sketch").alias("line"))
    apart = F.col("alone") + F.col("lone") + F.size("sketch") + F.size("line") - 2 * F.size(F.array_intersect("sketch", "line"))
    near = stage(pairs, "join-pairs").join(one, "a").join(two, "b").where(apart <= most(F.col("n"), F.col("m"))).select("a", "b")
    return stage(star.unionByName(near), "join-met")


def _possibly(grams: DataFrame, frequent: DataFrame) -> DataFrame:
    """``class, gram`` of n-grams that may be in ``frequent``: the others are left out, by a bitmap of fixed size, before they are shuffled."""
    slot = F.pmod("gram", F.lit(MAP_BITS)) + 1
    parts = frequent.select(F.bitmap_bucket_number(slot).alias("part"), F.bitmap_bit_position(slot).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for r in parts.collect():  # MAP_BITS / 8 bytes in all, whatever the input
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[(r["part"] - 1) * len(part) : r["part"] * len(part)] = part
    held = grams.sparkSession.sparkContext.broadcast(bits)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = held.value
        for b in batches:
            first = b.column("first")
            gram = first.flatten().to_numpy()
            at = gram & (MAP_BITS - 1)  # pmod by a power of two
            there = (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            owner = np.repeat(b.column("class").to_numpy(), np.diff(first.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(owner[there]), pa.array(gram[there])], ["class", "gram"])

    return grams.select("class", "first").mapInArrow(kept, "class bigint, gram bigint")


def _components_of(rows: DataFrame, light: DataFrame, prefixes: DataFrame, n: int, percent: int) -> DataFrame:
    """Staged ``set, component_id`` of every set, from the prefixes of those that may have links."""
    of_group = stage(components(_met(prefixes, percent)), "join-clusters")

    # Classes of the clusters, with groups of several classes expanded, and their whole sets.
    several = prefixes.groupBy("grp").agg(F.count("*").alias("many")).where("many > 1").select("grp")
    in_play = of_group.select(F.col("node").alias("grp")).unionByName(several).distinct()
    members = prefixes.join(in_play, "grp").join(of_group.withColumnRenamed("node", "grp"), "grp", "left")
    members = stage(members.select("class", "n", F.coalesce("component", "grp").alias("cluster")), "join-members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("many"), F.sum("n").alias("total"))
    sizes = sizes.select("cluster", F.greatest(F.ceil(F.col("many") / CHUNK), F.ceil(F.col("total") / CHUNK_GRAMS)).cast("int").alias("chunks"))
    dealt = members.join(sizes, "cluster").select("class", "cluster", "chunks", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int").alias("chunk"))
    dealt = stage(dealt, "join-dealt")
    at = stage(light.select(F.col("id").alias("class"), "file", "row").join(bounded(dealt), "class"), "join-at")
    texts = rows.join(bounded(at), ["file", "row"]).select(*_DEALT, "text")
    whole = stage(texts.mapInArrow(lambda it: _whole(it, n), "class bigint, cluster bigint, chunks int, chunk int, grams binary"), "join-whole")

    def tiles(of: DataFrame, others) -> DataFrame:
        both = of.withColumn("other", F.explode(others)).select("class", "label", "grams", "cluster", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
        return both.groupBy("cluster", "i", "j").applyInPandas(lambda key, pdf: _verify(key, pdf, percent), "a bigint, b bigint")

    # First each chunk by itself and with chunk 0, then, where that leaves a cluster in parts, the other pairs of chunks.
    own = F.array_distinct(F.when(F.col("chunk") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.lit(0), F.col("chunk"))))
    edges = stage(tiles(whole.withColumn("label", F.col("class")), own), "join-links")
    large = dealt.where("chunks > 2")
    if not large.isEmpty():
        part = stage(components(edges), "join-parts")
        large = large.join(part.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("component", "class"))
        apart = large.groupBy("cluster").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l != h").select("cluster")
        rest = stage(large.join(apart, "cluster").where("chunk > 0").select("class", "label"), "join-rest")
        further = F.filter(F.sequence(F.lit(1), F.col("chunks") - 1), lambda x: x != F.col("chunk"))
        edges = stage(edges.unionByName(tiles(whole.where("chunks > 2 AND chunk > 0").join(bounded(rest), "class"), further)), "join-links")
    part = components(edges).withColumnRenamed("node", "class")

    # The smallest identifier of each component, given to all its sets.
    ids = light.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("least"), F.min("id").alias("class")).join(part, "class", "left").withColumn("component", F.coalesce("component", "class"))
    ids = stage(ids, "join-ids")
    several = ids.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("many")).where("many > 1").drop("many")
    return stage(ids.join(several, "component", "left").select("set", F.coalesce("component_id", "least").alias("component_id")), "join-of-set")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest identifier (nulls last, then first by locator).

    Rows without a set (null, empty or blank texts) are linked with nothing and stay.
    """
    docs = as_scan(docs)
    names = docs.columns
    file, row = "_join_file", "_join_row"
    while file in names or row in names:
        file, row = file + "_", row + "_"
    mark = staged()
    found = stage(linked(docs, id_col, text_col, n, percent), "join-found")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    several = found.where("n_shingles > 0").withColumn("key", F.struct("component_id", F.when(F.col("component_id").isNull(), F.struct("file", "row"))))
    first = several.groupBy("key").agg(F.min(key).alias("first"), F.count("*").alias("many")).where("many > 1")
    gone = several.join(first, several["key"].eqNullSafe(first["key"])).where("file != first.file OR row != first.row")
    gone = stage(gone.select(F.col("file").alias(file), F.col("row").alias(row)), "join-gone")
    sweep(docs.sparkSession, mark, [gone])
    return drop_rows(located(docs, file, row), gone, [file, row]).drop(file, row)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
