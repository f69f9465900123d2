"""Token ids in sorted-string-table shards, keyed by document identifier.

A shard is ``blocks, index, Bloom filter, footer``:

* A block holds entries in key order: varints of the bytes shared with the previous key, of the other key bytes and
  of the value's bytes, then those key bytes and the value. The first key of a block is whole. A block
  is compressed with zstd and ends once it holds BLOCK_BYTES or more.
* The sparse index has an entry for each block: first key, offset, size, CRC-32, entries and tokens before it.
* The Bloom filter has BLOOM_BITS bits for each key and BLOOM_HASHES probes by double hashing.
* The footer is of fixed size: offsets, counts, width of an id in bytes, and a magic number.

A key is the identifier's eight bytes, big-endian with the sign bit flipped, so that bytes sort as
numbers do; a null identifier is the empty key and comes first. A value is the ids as little-endian unsigned integers.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batch_bytes, bounded, filesystem, scratch, ship, stage, table
from .stretches import cut, portions

BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 64 * 1024, 10, 7
MAGIC = b"TWSST\x00\x00\x01"
_FOOTER = struct.Struct("<QQQQQQB7x8s")
_INDEX = struct.Struct("<QQIQQH")
#: Distinct words remembered by a Python worker in each of two generations.
REMEMBERED = 600_000
#: White space that becomes a blank before texts are cut, and marks that are words of their own after a letter.
_WHITE = bytes(32 if 9 <= k <= 13 else k for k in range(256))
MARKS = ".,;:!?"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id & (2**64 - 1)) ^ (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


class Writer:
    """Writes a shard to an open binary stream; entries must come in key order."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self.docs = self.tokens = 0
        self.block, self.first, self.last, self.held = bytearray(), b"", b"", 0
        self.index, self.keys, self.before = [], [], (0, 0)
        self.squeeze = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if self.held and key < self.last:
            raise ValueError("keys must be in order")
        shared = 0
        if self.held:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first, self.before = key, (self.docs, self.tokens)
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.held += 1
        self.docs += 1
        self.tokens += len(value) // self.width
        self.keys.append(xxhash.xxh3_128_digest(key))
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            data = self.squeeze.compress(bytes(self.block))
            self.index.append((self.first, self.at, len(data), zlib.crc32(data), *self.before))
            self.out.write(data)
            self.at += len(data)
            self.block, self.held = bytearray(), 0

    def close(self) -> None:
        self._flush()
        index = b"".join(_INDEX.pack(*rest, len(first)) + first for first, *rest in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys)) + 7 & ~7
        bloom = np.zeros(bits, np.uint8)
        if self.keys:
            h = np.frombuffer(b"".join(self.keys), ">u8").reshape(-1, 2)
            a, b = h[:, 1].astype(object), h[:, 0].astype(object) | 1
            for k in range(BLOOM_HASHES):
                bloom[((a + k * b) % bits).astype(np.int64)] = 1
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + packed + _FOOTER.pack(self.at, len(index), len(packed), len(self.index), self.docs, self.tokens, self.width, MAGIC))


class Reader:
    """Reads a shard from a random-access file."""

    def __init__(self, file):
        self.file = file
        size = file.size() if callable(getattr(file, "size", None)) else len(file)
        file.seek(size - _FOOTER.size)
        at, index, bloom, blocks, self.docs, self.tokens, self.width, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(at)
        data = file.read(index)
        self.bloom = file.read(bloom)
        self.index, at = [], 0
        for _ in range(blocks):
            *rest, n = _INDEX.unpack_from(data, at)
            at += _INDEX.size
            self.index.append((data[at : at + n], *rest))
            at += n
        self.firsts = [e[0] for e in self.index]
        self.expand = zstandard.ZstdDecompressor()

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, size, crc, _, _ = self.index[k]
        self.file.seek(offset)
        data = self.file.read(size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {k} is damaged")
        data, at, key = self.expand.decompress(data), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype(np.uint32)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all entries of an identifier (several if it repeats), by Bloom filter and binary search."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, 8 * len(self.bloom))):
            return []
        out = []
        for k in range(max(0, bisect_left(self.firsts, key) - 1), len(self.index)):
            if self.firsts[k] > key:
                break
            out += [self.ids(v) for found, v in self.block(k) if found == key]
        return out


class Words:
    """The tokenizers library behind a memory of the stretches between white space.

    Only for tokenizers that drop white space before they split words, as the default one does, may a text be cut there (two probes
    tell); others get whole texts. Of words that aren't remembered, those of letters alone are handed to the library in one text, whose ids
    are cut after the tokens that end a word; letters followed by one mark are those letters and the mark.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.width = self.kind.itemsize
        self.cuttable = self._ids("a. \n\tb 1") == [*self._ids("a."), *self._ids("b"), *self._ids("1")] and not self._ids(" \n\t\r")
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items() if suffix else ():
            self.ends[k] = token.endswith(suffix)
        self.mark = {m: self._bytes(m) for m in MARKS}
        self.young: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _bytes(self, text: str) -> bytes:
        return np.array(self._ids(text), self.kind).tobytes()

    def encode_all(self, texts: list[bytes], end: bytes) -> Iterator[bytes]:
        """The ids of every text (UTF-8) with ``end`` after them."""
        for low, high in portions(texts):
            if not self.cuttable:
                for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts[low:high]], add_special_tokens=False):
                    yield np.array(e.ids, self.kind).tobytes() + end
                continue
            found = cut(texts[low:high], fold=_WHITE)
            words = found.texts()
            values = list(map(self.young.get, words))
            missing = [w for w, v in zip(words, values) if v is None]
            if missing:
                known = self._learn(missing)
                values = [known[w] if v is None else v for w, v in zip(words, values)]
            data, begins = found.gather(pa.array(values, pa.large_binary()))
            bounds = begins.tolist()
            for a, b in zip(bounds, bounds[1:]):
                yield bytes(data[a:b]) + end

    def _learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """Ids of all ``missing`` words, which are remembered too."""
        if len(self.young) + len(missing) > REMEMBERED:
            self.old, self.young = self.young, {b"": b""}
        young, old = self.young, self.old
        plain, marked, other = {}, [], []
        for w in missing:
            if w in old:
                young[w] = old[w]
                continue
            text = w.decode()
            # A letter may fall apart into one and a mark when it is composed or lower-cased.
            seen = text if text.isascii() else unicodedata.normalize("NFC", text).lower()
            if seen.isalpha():
                plain[w] = text
            elif text[-1] in self.mark and seen[:-1].isalpha() and seen[-1] == text[-1]:
                marked.append(w)
                if (v := young.get(w[:-1]) or old.get(w[:-1])) is None:
                    plain[w[:-1]] = text[:-1]
                else:
                    young[w[:-1]] = v
            else:
                other.append(w)
        names = list(plain)
        for low in range(0, len(names), 2_000):
            part = names[low : low + 2_000]
            ids = np.array(self._ids(" ".join(plain[w] for w in part)), self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):  # not one word each, for this library
                other += part
                continue
            data, at = ids.tobytes(), 0
            for w, stop in zip(part, (ends * self.width).tolist()):
                young[w] = data[at:stop]
                at = stop
        for low in range(0, len(other), 2_000):
            part = other[low : low + 2_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                young[w] = np.array(e.ids, self.kind).tobytes()
        for w in marked:
            young[w] = young[w[:-1]] + self.mark[chr(w[-1])]
        return young


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A row for each shard; first_id and last_id are the least and largest identifiers in it (null where it holds none).
MANIFEST = "shard bigint, path string, docs bigint, tokens bigint, has_null boolean, first_id bigint, last_id bigint"


def write_shards(docs: DataFrame, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Encode ``docs`` and write shards to ``folder``; the written manifest: ``shard, path, docs, tokens, has_null, first_id, last_id``.

    Shards follow each other in ascending order of the identifier (null first; repeated identifiers in order of a
    hash of their texts). Null texts count as empty, and ``end_id`` is appended to every document. An empty table gives no shards.
    Other columns aren't read. A task writes to a name of its own and the manifest names only files
    of tasks that succeeded, so lost and repeated tasks do no harm.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    ship(spark)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, words, writer, has_null, first, last = TaskContext.get().partitionId(), _words(path), None, False, None, None
        end = np.array([end_id], words.kind).tobytes()
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), words.encode_all(batch_bytes(b.column("text")), end)):
                if writer is None:
                    uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.sst"
                    fs, fs_path = filesystem(uri)
                    fs.create_dir(fs_path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(fs_path)
                    writer = Writer(out, words.width)
                has_null |= doc_id is None
                first, last = doc_id if first is None else first, doc_id
                writer.add(key_of(doc_id), ids)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in [(shard, pa.int64()), (uri, pa.string()), (writer.docs, pa.int64()), (writer.tokens, pa.int64()), (has_null, pa.bool_()), (first, pa.int64()), (last, pa.int64())]],
                ["shard", "path", "docs", "tokens", "has_null", "first_id", "last_id"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    ordered.mapInArrow(written, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def look_up(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` for every entry of the identifiers in ``wanted`` (repeats count once; null finds null ones); none for those that no shard holds.

    The manifest's key ranges name the shards that can hold an identifier; in each of them its Bloom filter, the
    binary search over the block index and one block answer. Identifiers of one shard are dealt to several tasks.
    """
    spark = manifest.sparkSession
    ship(spark)
    ids = wanted.select(F.col(id_col).cast("bigint").alias("doc_id")).distinct()
    ranges = bounded(stage(manifest.select("path", "has_null", "first_id", "last_id"), "ranges"))
    asked = ids.join(ranges, F.col("doc_id").between(F.col("first_id"), F.col("last_id")) | (F.col("doc_id").isNull() & F.col("has_null"))).select("path", "doc_id")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f = None
        for b in batches:
            out: tuple[list, list] = ([], [])
            for uri, doc_id in zip(b.column("path").to_pylist(), b.column("doc_id").to_pylist()):
                if uri != path:
                    if f is not None:
                        f.close()
                    fs, fs_path = filesystem(uri)
                    path, f = uri, fs.open_input_file(fs_path)
                    shard = Reader(f)
                for value in shard.get(doc_id):
                    out[0].append(doc_id)
                    out[1].append(value.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32()))], ["doc_id", "ids"])
        if f is not None:
            f.close()

    dealt = asked.repartition("path", F.pmod(F.xxhash64("doc_id"), F.lit(16))).sortWithinPartitions("path", "doc_id")
    return dealt.mapInArrow(found, "doc_id bigint, ids array<int>")


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the shards, in no particular order.

    ``start`` counts the ids of all documents before it in all shards, ``ids_crc32`` is the unsigned crc32 of the ids as
    little-endian unsigned 32-bit integers.
    """
    spark = manifest.sparkSession
    ship(spark)
    before, listed = 0, []
    for r in manifest.orderBy("shard").collect():  # a row for each written file
        listed.append((r["path"], before))
        before += r["tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                fs, fs_path = filesystem(uri)
                with fs.open_input_file(fs_path) as f:
                    shard = Reader(f)
                    for k in range(len(shard.index)):
                        rows = []
                        for key, value in shard.block(k):
                            ids = shard.ids(value)
                            rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(listed, "path string, start bigint").repartition(max(1, len(listed)))
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents"), scratch(spark, "shards"), end_id=2))
