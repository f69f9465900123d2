"""Document fingerprints by context-triggered piecewise hashing, and how alike two of them are.

A rolling hash of the last bytes marks boundaries wherever its low bits are all ones, so a boundary depends on its
context alone and comes back when a passage moves. Every chunk between boundaries gives one symbol of a signature. The block size
is the smallest power of two that makes at most ``CHUNKS`` chunks, and a fingerprint holds the signatures for it and for
twice it: ``block:signature:signature``. Fingerprints are compared at the block sizes they share, by the edit distance of the signatures.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import ship, slices, spread, stage, table

#: Bytes of context of a boundary, most chunks of a signature, bits of the smallest block size, and bytes hashed at a time.
WINDOW, CHUNKS, LEAST_BITS, PIECE = 7, 64, 2, 4 << 20
_RADIX, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: A symbol is 12 bits of a chunk's hash, written as two digits.
_SYMBOLS = [a + b for a in _DIGITS for b in _DIGITS]


def _hashes(data: bytes, low: int, high: int) -> np.ndarray:
    """Rolling hash at the positions ``low`` to ``high``, of the WINDOW bytes that end there (zeros before the text)."""
    head = max(0, low - WINDOW + 1)
    raw = np.zeros(high - low + WINDOW - 1, np.uint8)
    own = np.frombuffer(data, np.uint8, high - head, head)
    raw[len(raw) - len(own) :] = own
    h = np.zeros(high - low, np.uint32)
    for k in range(WINDOW):
        h *= _RADIX
        h += raw[k : k + len(h)]
    h *= _MIX
    return h >> np.uint32(7)


def boundaries(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks at block size 2**bits, but for the end of the text, and the hashes there; found in pieces of bounded size."""
    mask = np.uint32((1 << bits) - 1)
    ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for low in range(0, len(data) - 1, PIECE):
        h = _hashes(data, low, min(low + PIECE, len(data) - 1))
        at = np.flatnonzero((h & mask) == mask)
        ends.append(at + low + 1)
        hashes.append(h[at])
    return np.concatenate(ends), np.concatenate(hashes)


def _signature(data: bytes, ends: np.ndarray) -> str:
    cuts = [0, *ends.tolist(), len(data)]
    # The multiplication spreads the checksum, whose low bits are linear in the bytes.
    return "".join([_SYMBOLS[(zlib.crc32(data[a:b]) * 0x9E3779B1 >> 20) & 0xFFF] for a, b in zip(cuts, cuts[1:])])


def fingerprint(data: bytes) -> str:
    """``block:signature:signature`` of the whole of ``data``; equal data have equal fingerprints, no data has '4::'."""
    if not data:
        return f"{1 << LEAST_BITS}::"
    bits = max(LEAST_BITS, (len(data) // CHUNKS).bit_length() - 2)
    ends, hashes = boundaries(data, bits)
    while bits > LEAST_BITS and len(ends) < CHUNKS:  # fewer than expected: smaller blocks may do
        bits -= 1
        ends, hashes = boundaries(data, bits)
    while len(ends) >= CHUNKS:  # blocks of twice the size end at some of the same places
        bits += 1
        ends, hashes = _further(ends, hashes, bits)
    return f"{1 << bits}:{_signature(data, ends)}:{_signature(data, _further(ends, hashes, bits + 1)[0])}"


def _further(ends: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of chunk ends those that are also ends at block size 2**bits."""
    mask = np.uint32((1 << bits) - 1)
    stay = (hashes & mask) == mask
    return ends[stay], hashes[stay]


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence of two signatures, all cells of a row at once as bits of an integer."""
    at: dict[str, int] = {}
    for i in range(0, len(a), 2):
        at[a[i : i + 2]] = at.get(a[i : i + 2], 0) | 1 << (i >> 1)
    full = (1 << (len(a) >> 1)) - 1
    row = full
    for i in range(0, len(b), 2):
        met = row & at.get(b[i : i + 2], 0)
        row = (row + met | row - met) & full
    return (len(a) >> 1) - row.bit_count()


def likeness(one: str, other: str) -> float:
    """From 0 to 1: 1 less the edit distance (insertions and deletions of symbols) over the length of both signatures, at the block size where they are most alike.

    Fingerprints without a block size in common have 0, equal ones 1, those of an empty and another text 0.
    """
    if one == other:
        return 1.0
    (m, *a), (n, *b) = one.split(":"), other.split(":")
    a, b = {int(m): a[0], 2 * int(m): a[1]}, {int(n): b[0], 2 * int(n): b[1]}
    return max([2 * _common(a[k], b[k]) / ((len(a[k]) + len(b[k])) >> 1) for k in a.keys() & b.keys() if a[k] and b[k]], default=0.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row's whole text.

    Null is empty; null, equal and repeated identifiers and rows are kept as they are; an empty table gives no rows; other columns
    aren't read. Nothing is shuffled.
    """
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array([fingerprint(t.encode()) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(made, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string("n_chars bigint, fingerprint string").fields]))


_EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Rows of a partition whose next document is in another one: its first and its last.
_ENDS = _EDITED + ", part int, place string, text string"


def _edited(doc_id: int | None, text: str, own: str, after: str, next_own: str) -> dict:
    """The row of a text with fingerprint ``own``, before a text that starts with ``after`` and has ``next_own``."""
    n = len(text)
    changed = (text[: n - n // 3] + after[: n // 3]).encode()
    of_changed = fingerprint(changed)
    return {"doc_id": doc_id, "n_chars": n, "edited_sha256": hashlib.sha256(changed).hexdigest(), "fingerprint": own, "edited_fingerprint": of_changed, "near_edited": likeness(own, of_changed), "near_next": likeness(own, next_own)}


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition, each finished when the next one is seen; the ends are given out as they are."""
    part, held, schema = TaskContext.get().partitionId(), None, _arrow(_ENDS)
    for b in slices(batches):
        out = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            text = text or ""
            own = fingerprint(text.encode())
            if held is None:
                out.append({"part": part, "place": "first", "text": text, "fingerprint": own})
            else:
                out.append(_edited(*held, text, own) | {"place": "row"})
            held = doc_id, text, own
        yield pa.RecordBatch.from_pylist(out, schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([{"part": part, "place": "last", "doc_id": held[0], "text": held[1], "fingerprint": held[2]}], schema)


def edited_by_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited one, and how alike they are; columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has its last third (rounded down, in code points) replaced by the first as many code points, or all, of the next
    document in descending order of identifiers; the first follows the last. Null identifiers come last; rows of one identifier
    are in the order of a hash of their texts; equal rows may trade places, which changes nothing. Null is an empty text; a single row is its own next one;
    an empty table gives no rows; other columns aren't read. Rows are dealt out by ranges of that order, so that a text is shuffled once and a hot
    identifier is many tasks; only rows at the ends of a partition, two each, meet in a second step.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("dealt", F.spark_partition_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("dealt")]
    found = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_in_order, _ENDS), "fingerprints")
    ends = found.where("place != 'row'")
    parts = sorted(r.part for r in ends.where("place = 'first'").select("part").collect())  # a number for each partition
    if not parts:
        return found.select(*[c.split()[0] for c in _EDITED.split(", ")])
    pairs = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    after = ends.where("place = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"), F.col("fingerprint").alias("next_own"))
    last = ends.where("place = 'last'").select("part", "doc_id", "text", "fingerprint").join(pairs, "part").join(after, "next").select("doc_id", "text", "fingerprint", "after", "next_own")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([_edited(*row) for row in zip(*(c.to_pylist() for c in b.columns))], _arrow(_EDITED))

    return found.where("place = 'row'").select(*[c.split()[0] for c in _EDITED.split(", ")]).unionByName(last.mapInArrow(finished, _EDITED))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_by_next(table(spark, sf_dir, "documents"))
