"""Ranked lexical search in shards of dual-sorted wavelet trees.

A shard indexes the postings of some megabytes of text. The lists of its terms, each in descending order of impact, stand one after the
other as a sequence of document numbers; a wavelet tree (in its matrix form) over this sequence keeps the order of impact within every
node, while its nodes are ranges of document numbers, which ascend with the identifiers. So the first entry of a list's range in a node is
the greatest impact that any document of the node has for that term, and the weighted sum of these bounds every score below. A search
opens the nodes with the greatest bounds first, intersects the lists' ranges with both halves by rank, and ends when no open node can reach the
k-th best leaf: its documents are the exact best k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import batch_bytes, give_back, remove, scratch, ship, slices, spread, stage, table
from .stretches import cut

#: Bytes of text of a shard, bytes of query text searched at once, and open nodes split together.
SHARD_BYTES, BLOCK_BYTES, SPLIT = 16 << 20, 1 << 20, 64
#: Bounds of inner nodes are held in bytes, as multiples of UNIT rounded up: impacts are below a million.
UNIT = 4096
_INDEX = "n_docs bigint, doc_ids binary, no_id binary, terms binary, starts binary, zeros binary, bits binary, impacts binary"
#: Bytes that separate terms become blanks, A-Z are lower-cased.
_FOLD = bytes(k if 48 <= k <= 57 or 97 <= k <= 122 or k >= 128 else k + 32 if 65 <= k <= 90 else 32 for k in range(256))


@dataclass
class Terms:
    """Terms of some texts: the ``distinct`` ones, which of them each occurrence ``is``, and how many each text has."""

    distinct: list[bytes]
    which: np.ndarray
    counts: np.ndarray


def terms_of(texts: list[bytes]) -> Terms:
    """All terms of whole texts in order; a term is a longest stretch of ASCII letters (lower-cased), digits and other than ASCII characters."""
    found = cut(texts, fold=_FOLD)
    names = found.texts()
    real = np.fromiter(map(len, names), np.int64, len(names)) > 0  # the other one is a blank that follows a blank
    which = found.which.to_numpy(zero_copy_only=False)
    there = real[which] if len(which) else np.zeros(0, bool)
    number = np.cumsum(real) - 1
    before = np.append(0, np.cumsum(there))
    return Terms([t for t in names if t], number[which[there]].astype(np.int64), np.diff(before[found.first]))


def impacts_of(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The part of a term's score that depends on the document: its occurrences there against the document's length."""
    m = 25 + 75 * n * documents // max(total, 1)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def build_shard(ids: list[int | None], texts: list[bytes], documents: int, total: int) -> dict:
    """A shard's row of the index; documents are numbered in ascending order of identifiers, nulls last."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    terms = terms_of([texts[k] for k in order])
    doc = np.repeat(np.arange(len(ids), dtype=np.int64), terms.counts)
    keys, tf = np.unique(terms.which * len(ids) + doc, return_counts=True)
    term, doc = keys // max(len(ids), 1), keys % max(len(ids), 1)
    impact = impacts_of(tf, terms.counts[doc], documents, total)
    by_impact = np.argsort((term << 20) - impact, kind="stable")
    values, impact = doc[by_impact], impact[by_impact].astype(np.uint32)
    starts = np.searchsorted(term, np.arange(len(terms.distinct) + 1))
    words = len(values) // 64 + 1
    bits, zeros = [], []
    for level in reversed(range(height(len(ids)))):
        ones = (values >> level & 1).astype(bool)
        packed = np.zeros(words * 8, np.uint8)
        packed[: (len(ones) + 7) // 8] = np.packbits(ones, bitorder="little")
        bits.append(packed.tobytes())
        zeros.append(len(ones) - int(ones.sum()))
        values, impact = (np.concatenate([v[~ones], v[ones]]) for v in (values, impact))
    sorted_ids = [ids[k] for k in order]
    return {
        "n_docs": len(ids), "doc_ids": np.array([i or 0 for i in sorted_ids], "<i8").tobytes(), "no_id": np.array([i is None for i in sorted_ids], bool).tobytes(),
        "terms": b" ".join(terms.distinct), "starts": starts.astype("<i8").tobytes(), "zeros": np.array(zeros, "<i8").tobytes(), "bits": b"".join(bits), "impacts": impact.astype("<u4").tobytes(),
    }


def height(documents: int) -> int:
    """Levels of a tree over so many documents."""
    return max(1, (documents - 1).bit_length())


class Shard:
    """A shard of the index, open for searches."""

    def __init__(self, row: dict):
        self.n_docs, self.height = row["n_docs"], height(row["n_docs"])
        self.terms = row["terms"].split(b" ") if row["terms"] else []
        self.starts = np.frombuffer(row["starts"], "<i8")
        self.zeros = np.frombuffer(row["zeros"], "<i8")
        self.words = np.frombuffer(row["bits"], "<u8").reshape(self.height, -1)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.ranks = (np.cumsum(counts, axis=1) - counts).astype(np.int32)
        self.leaves = np.frombuffer(row["impacts"], "<u4")
        # The impacts in the order of every level, from the leaves up: the bounds of the nodes.
        bounds, above = [], -(-self.leaves // UNIT)
        above = above.astype(np.uint8)
        for level in reversed(range(self.height)):
            bounds.append(above)
            ones = np.unpackbits(self.words[level].view(np.uint8), count=len(above), bitorder="little").astype(bool)
            above = np.empty_like(above)
            above[~ones], above[ones] = bounds[-1][: self.zeros[level]], bounds[-1][self.zeros[level] :]
        self.bounds = np.array([above, *reversed(bounds)])  # by level; the last is the leaves'

    def ones_before(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank: ones of a level before a position."""
        word = at >> 6
        rest = self.words[level, word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.ranks[level, word] + np.bitwise_count(rest)

    def search(self, lists: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> list[tuple[int, int]]:
        """``(score, document number)`` of the best ``k`` documents with a score of ``least`` or more, equal scores by number.

        ``lists`` are numbers of the shard's terms, ``weights`` positive integers.
        """
        level, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        low, high = self.starts[lists][None], self.starts[lists + 1][None]
        bound = np.array([np.iinfo(np.int64).max])
        best: list[tuple[int, int]] = []
        floor, floor_doc = least - 1, -1  # what a document must exceed, or equal with a smaller number
        while len(bound):
            if len(bound) > SPLIT:
                taken = np.argpartition(-bound, SPLIT)[:SPLIT]
                rest = np.ones(len(bound), bool)
                rest[taken] = False
            else:
                taken, rest = slice(None), np.zeros(len(bound), bool)
            at, lo, hi, pre = level[taken], low[taken], high[taken], prefix[taken]
            ones_lo, ones_hi = self.ones_before(at[:, None], lo), self.ones_before(at[:, None], hi)
            zeros = self.zeros[at][:, None]
            lo, hi = np.concatenate([lo - ones_lo, zeros + ones_lo]), np.concatenate([hi - ones_hi, zeros + ones_hi])
            at, pre = np.concatenate([at, at]) + 1, np.concatenate([pre * 2, pre * 2 + 1])
            there = hi > lo
            some = there.any(axis=1)
            at, pre, lo, hi, there = at[some], pre[some], lo[some], hi[some], there[some]
            leaf = at == self.height
            if leaf.any():
                scores = (np.where(there[leaf], self.leaves[np.where(there[leaf], lo[leaf], 0)], 0).astype(np.int64) * weights).sum(axis=1)
                best = sorted([*best, *zip(scores[scores >= least].tolist(), pre[leaf][scores >= least].tolist())], key=lambda r: (-r[0], r[1]))[:k]
                if len(best) == k:
                    floor, floor_doc = best[-1]
            inner = ~leaf
            at, pre, lo, hi, there = at[inner], pre[inner], lo[inner], hi[inner], there[inner]
            limits = (np.where(there, self.bounds[at[:, None], np.where(there, lo, 0)], 0).astype(np.int64) * (weights * UNIT)).sum(axis=1)
            level, prefix, low, high, bound = (np.concatenate([a[rest], b]) for a, b in ((level, at), (prefix, pre), (low, lo), (high, hi), (bound, limits)))
            stays = (bound > floor) | (bound == floor) & (prefix << (self.height - level) < floor_doc)
            level, prefix, low, high, bound = level[stays], prefix[stays], low[stays], high[stays], bound[stays]
        return best


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """A staged index of the whole texts of all rows, a row for each shard, and the number of documents that have a term.

    Null and empty texts have no terms; null identifiers come after all others; repeated rows are documents of their own; an empty table
    gives an empty index; other columns aren't read. Texts are read twice, first for the statistics that impacts depend on, and never shuffled.
    """
    rows = spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = total = 0
        for b in slices(batches):
            counts = terms_of(batch_bytes(b.column("text"))).counts
            documents, total = documents + int((counts > 0).sum()), total + int(counts.sum())
        yield pa.RecordBatch.from_pydict({"documents": pa.array([documents], pa.int64()), "total": pa.array([total], pa.int64())})

    sums = rows.select("text").mapInArrow(lengths, "documents bigint, total bigint").agg(F.sum("documents"), F.sum("total")).first()
    documents, total = (int(v or 0) for v in sums)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("n_docs", pa.int64()), *[(c.split()[0], pa.binary()) for c in _INDEX.split(", ")[1:]]])
        ids, texts, held = [], [], 0
        for b in slices(batches):
            new = batch_bytes(b.column("text"))
            size = sum(map(len, new))
            if texts and held + size > SHARD_BYTES:
                yield pa.RecordBatch.from_pylist([build_shard(ids, texts, documents, total)], schema)
                ids, texts, held = [], [], 0
            ids += b.column("doc_id").to_pylist()
            texts += new
            held += size
        if texts:
            yield pa.RecordBatch.from_pylist([build_shard(ids, texts, documents, total)], schema)
        give_back()

    path = scratch(docs.sparkSession, "wavelet-index")
    made = rows.mapInArrow(built, _INDEX)
    made.write.option("maxRecordsPerFile", 1).parquet(path)  # a shard is the unit of work of a search
    return docs.sparkSession.read.schema(made.schema).parquet(path), documents


def search(index: DataFrame, documents: int, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Staged ``item_id, rank, doc_id, score``: the ``k`` best documents of every item by score above 0, equal scores by ascending identifier.

    Every row of ``items`` is an item, repeated ones too, which have all their results again; null texts have no results. Items are searched in blocks of
    BLOCK_BYTES of text, of which one at a time is on the driver and with the workers; each block meets every shard.
    """
    spark = index.sparkSession
    ship(spark)
    kind = items.schema[id_col].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id bigint, score bigint"
    path, blocks, block, held = scratch(spark, "wavelet-found"), 0, [], 0
    spark.createDataFrame([], schema).write.parquet(path)

    def run() -> None:
        found = _search_block(index, documents, [t for _, t in block], k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"item int, item_id {kind}")
        found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)  # a block's items

    for row in items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).toLocalIterator():
        text = (row["text"] or "").encode()
        if block and held + len(text) > BLOCK_BYTES:
            run()
            block, held = [], 0
        block.append((row["item_id"], text))
        held += len(text) + 64
    if block:
        run()
    return spark.read.schema(schema).parquet(path)


def _search_block(index: DataFrame, documents: int, texts: list[bytes], k: int) -> DataFrame:
    """``item, rank, doc_id, score`` for items by number."""
    spark = index.sparkSession
    terms = terms_of(texts)
    ends = np.cumsum(terms.counts)
    of_item = [np.unique(terms.which[e - n : e], return_counts=True) for n, e in zip(terms.counts, ends)]
    sent = spark.sparkContext.broadcast((terms.distinct, of_item))  # a block: of bounded size

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(sent.value[0], pa.binary()), np.zeros(len(sent.value[0]), np.int64)
        for b in batches:
            for words, starts in zip(b.column("terms").to_pylist(), b.column("starts").to_pylist()):
                total += _sizes(wanted, words, np.frombuffer(starts, "<i8"))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int64()), "df": pa.array(total[at], pa.int64())})

    df = np.zeros(len(terms.distinct), np.int64)
    for r in index.select("terms", "starts").mapInArrow(frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():  # terms of a block
        df[r["term"]] = r["df"]
    weights = spark.sparkContext.broadcast(np.array([weight(int(d), documents) for d in df], np.int64))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, of = sent.value
        wanted = pa.array(names, pa.binary())
        best: list[list[tuple[int, bool, int | None]]] = [[] for _ in of]
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row)
                where = pc.index_in(wanted, value_set=pa.array(shard.terms, pa.binary())).fill_null(-1).to_numpy()
                ids, none = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["no_id"], bool)
                for item, (words, many) in enumerate(of):
                    lists, factor = where[words], many * weights.value[words]
                    use = (lists >= 0) & (factor > 0)
                    if use.any():
                        # A document of this shard must reach the k-th best score of the shards before; a tie may win by its identifier.
                        least = -best[item][-1][0] if len(best[item]) == k else 1
                        new = [(-score, bool(none[d]), int(ids[d])) for score, d in shard.search(lists[use], factor[use], k, least)]
                        best[item] = sorted([*best[item], *new])[:k]
        rows = [(item, None if none else i, -score) for item, found in enumerate(best) for score, none, i in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])
        give_back()

    found = index.mapInArrow(searched, "item int, doc_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def _sizes(wanted: pa.Array, words: bytes, starts: np.ndarray) -> np.ndarray:
    """Lengths of the lists of ``wanted`` terms in a shard."""
    at = pc.index_in(wanted, value_set=pa.array(words.split(b" ") if words else [], pa.binary())).fill_null(-1).to_numpy()
    return np.where(at >= 0, starts[np.where(at >= 0, at, 0) + 1] - starts[np.where(at >= 0, at, 0)], 0) if len(starts) > 1 else np.zeros(len(wanted), np.int64)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, documents = build_index(table(spark, sf_dir, "documents"))
    return search(index, documents, table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lens AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lens),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
df AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
part AS (SELECT tf.doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS part FROM tf JOIN df USING (term) JOIN lens USING (doc_id), total),
scored AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM q JOIN part USING (term) GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
