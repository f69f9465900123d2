"""SentencePiece encoding and decoding by a streaming Viterbi search.

Of all ways to cut a text into pieces of the model, the one with the largest sum of scores is taken. The search keeps
scores for one longest piece ahead and backpointers since the last committed boundary. Whatever a further piece can
start from is at most one longest piece away, so when the paths to all those positions run through one boundary, everything
before it is final: its ids are committed and forgotten. A stretch whose paths don't meet (a run of blanks, which whole pieces
tile in several ways) is held until they do, five bytes a character; nothing is committed early, as that would change ids.

In models whose pieces never cross from a word into the next white space (checked when a model is loaded), all paths
meet before every run of white space. What lies between two such boundaries is then searched once for all of its
repeats in a batch, a position at a time for all distinct stretches together.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batch_bytes, slices, spread, table
from .stretches import Stretches, binary, cut, portions

SPACE = "▁"
#: Longer stretches than this go through the search for one text.
SHORT = 64
#: Stretches searched together, and positions whose pieces are looked up together.
TOGETHER, BLOCK = 40_000, 4_096
_EMPTY = -1


class Trie:
    """Pieces by their characters. The steps from node to node are in an open-addressed hash table, for numpy look-ups.

    Node 0 is the root; ``score`` is -inf and ``piece`` -1 at nodes that are no piece. Characters that no piece has, and a
    literal U+2581, have code 0, which leads nowhere; a blank has the code of U+2581.
    """

    def __init__(self, pieces: dict[str, tuple[float, int]]):
        letters = sorted({c for p in pieces for c in p})
        code = {c: k + 1 for k, c in enumerate(letters)}
        self.codes = np.zeros(0x110000, np.int32)
        self.codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.codes[ord(" ")] = self.codes[ord(SPACE)]
        self.codes[ord(SPACE)] = 0
        self.width = len(letters) + 1
        steps: dict[int, int] = {}
        ends = []
        for p in pieces:
            at = 0
            for c in p:
                at = steps.setdefault(at * self.width + code[c], len(steps) + 1)
            ends.append(at)
        self.score, self.piece = np.full(len(steps) + 1, -np.inf), np.full(len(steps) + 1, -1, np.int32)
        self.score[ends] = [s for s, _ in pieces.values()]
        self.piece[ends] = [k for _, k in pieces.values()]
        bits = max(4, (4 * len(steps)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, _EMPTY, np.int64), np.full(1 << bits, -1, np.int32)
        keys, to = np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int32, len(steps))
        slot = self._slot(keys)
        while len(keys):  # each free slot takes one of those that want it, the others go on to the next
            wanted, first = np.unique(slot, return_index=True)
            free = self.keys[wanted] == _EMPTY
            first = first[free]
            self.keys[slot[first]], self.to[slot[first]] = keys[first], to[first]
            rest = np.delete(np.arange(len(keys)), first)
            keys, to, slot = keys[rest], to[rest], slot[rest] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Where each node's character leads, -1 where nowhere."""
        keys = nodes * np.int64(self.width) + codes
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.to[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found != _EMPTY))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (found != _EMPTY)]
        return out


class Pieces:
    """A SentencePiece model's vocabulary, for encoding by the streaming search and decoding.

    A blank is put before the text and blanks become the mark U+2581, as the models expect. Characters without a
    piece become byte pieces, and so does a literal U+2581, which keeps every text reversible.
    """

    def __init__(self, path: str):
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_id, self.scores, table_ = np.full(256, -1, np.int32), {}, []
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(p[3:-1], 16)] = i
                table_.append(bytes([int(p[3:-1], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                table_.append(b"")
            else:
                self.scores[p] = (m.get_score(i), i)
                table_.append(p.replace(SPACE, " ").encode())
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces, so not every text can be encoded")
        self.table = pa.array(table_, pa.large_binary())
        self.trie = Trie(self.scores)
        self.longest = max(map(len, self.scores))
        self.unknown = min(s for s, _ in self.scores.values()) - 10
        self.stretches = not any(SPACE in p.lstrip(SPACE) for p in self.scores)

    def _pieces_from(self, codes: np.ndarray, low: int, high: int) -> list[list[tuple[int, float, int]]]:
        """Length, score and id of every piece (or the unknown character) that starts at each of the positions ``low`` to ``high``."""
        out: list[list[tuple[int, float, int]]] = [[] for _ in range(high - low)]
        at, nodes = np.arange(low, high), np.zeros(high - low, np.int64)
        for length in range(1, self.longest + 1):
            inside = at + length <= len(codes)
            at, nodes = at[inside], nodes[inside]
            nodes = self.trie.step(nodes, codes[at + length - 1]) if len(at) else nodes
            if length == 1:
                no_piece = np.flatnonzero((nodes < 0) | (self.trie.piece[nodes] < 0))
                for k in no_piece.tolist():
                    out[k].append((1, self.unknown, -1))
            at, nodes = at[nodes >= 0], nodes[nodes >= 0]
            if not len(at):
                break
            hit = np.flatnonzero(self.trie.piece[nodes] >= 0)
            for k, s, i in zip((at[hit] - low).tolist(), self.trie.score[nodes[hit]].tolist(), self.trie.piece[nodes[hit]].tolist()):
                out[k].append((length, s, i))
        return out

    def search(self, text: str) -> Iterator[int]:
        """Ids of the best path over ``text`` as it stands (no blank put before it), as they become final.

        Of paths with equal sums the one whose last piece starts first wins, at every position. Time is linear in the text: a test
        whether the paths have met walks over all that is held, so after one that fails the next waits until twice as much is.
        """
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        codes, n = self.trie.codes[points], len(points)
        ring = self.longest + 1
        score = [-np.inf] * ring  # of the positions that pieces in reach end at
        score[0] = 0.0
        base, wait = 0, 2 * self.longest
        sizes, ids = bytearray(1), array("i", [0])  # length and id of the best last piece at each position from base on
        lacking: list[list[tuple[int, float, int]]] = []
        for i in range(n):
            if i % BLOCK == 0:
                lacking = self._pieces_from(codes, i, min(i + BLOCK, n))
            here = score[i % ring]
            score[i % ring] = -np.inf
            for length, s, piece in lacking[i % BLOCK]:
                j, s = (i + length) % ring, here + s
                if s > score[j]:
                    score[j] = s
                    k = i + length - base
                    if k >= len(sizes):
                        more = k + 1 - len(sizes)
                        sizes.extend(bytes(more))
                        ids.extend([0] * more)
                    sizes[k], ids[k] = length, piece
            if i + 1 - base >= wait:
                met = self._meeting(sizes, i + 1 - base)
                if met:
                    yield from self._path(points, base, met, sizes, ids)
                    del sizes[:met], ids[:met]
                    base, wait = base + met, 2 * self.longest
                else:
                    wait = 2 * (i + 1 - base)
        yield from self._path(points, base, n - base, sizes, ids)

    @staticmethod
    def _meeting(sizes: bytearray, done: int) -> int:
        """The last boundary that all paths share of which one can go on, 0 if there is none but the first. Positions up to ``done`` are final."""
        live = {done} | {k - sizes[k] for k in range(done + 1, len(sizes)) if sizes[k] and k - sizes[k] < done}
        while len(live) > 1:
            k = max(live)
            live.discard(k)
            live.add(k - sizes[k])
        return live.pop()

    def _path(self, points: np.ndarray, base: int, high: int, sizes: bytearray, ids: array) -> list[int]:
        steps = []
        while high > 0:
            steps.append((high, ids[high]))
            high -= sizes[high]
        out: list[int] = []
        for end, piece in reversed(steps):
            if piece >= 0:
                out.append(piece)
            else:
                out += self.byte_id[list(chr(points[base + end - 1]).encode())].tolist()
        return out

    def _together(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches (characters one after another, and how many each has), by the same rule; and how many ids each has."""
        order = np.argsort(-sizes, kind="stable")
        starts = np.cumsum(sizes) - sizes
        begin, size = starts[order], sizes[order]
        codes = self.trie.codes[points]
        base = begin + order  # every stretch has a position more than characters
        total = int(sizes.sum()) + len(sizes)
        best, length_of, piece_of = np.full(total, -np.inf), np.zeros(total, np.int16), np.zeros(total, np.int32)
        best[base] = 0.0
        for i in range(int(size[0]) if len(size) else 0):
            alive = np.arange(np.searchsorted(-size, -i, side="left"))  # those with more than i characters
            nodes = np.zeros(len(alive), np.int64)
            for length in range(1, self.longest + 1):
                if length > 1:
                    inside = size[alive] >= i + length
                    alive, nodes = alive[inside], nodes[inside]
                nodes = self.trie.step(nodes, codes[begin[alive] + (i + length - 1)])
                gain = self.trie.score[nodes]
                piece = self.trie.piece[nodes]
                if length == 1:
                    none = (nodes < 0) | (piece < 0)
                    gain, piece = np.where(none, self.unknown, gain), np.where(none, -1, piece)
                    hit = np.arange(len(alive))
                else:
                    hit = np.flatnonzero((nodes >= 0) & (piece >= 0))
                at = base[alive[hit]] + i
                s = best[at] + gain[hit]
                better = s > best[at + length]
                to = at[better] + length
                best[to], length_of[to], piece_of[to] = s[better], length, piece[hit[better]]
                go = nodes >= 0
                alive, nodes = alive[go], nodes[go]
                if not len(alive):
                    break
        whose, at, steps = np.arange(len(order)), size.copy(), []
        while len(whose):
            whose, at = whose[at > 0], at[at > 0]
            p = base[whose] + at
            steps.append((order[whose], piece_of[p], starts[order[whose]] + at - 1))
            at = at - length_of[p]
        counts = np.zeros(len(sizes), np.int64)
        for who, _, _ in steps:
            counts[who] += 1
        ends = np.cumsum(counts)
        ids, last = np.empty(int(ends[-1]) if len(ends) else 0, np.int64), np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (who, piece, char) in enumerate(steps):
            ids[ends[who] - 1 - k], last[ends[who] - 1 - k] = piece, char
        if (ids < 0).any():
            ids, counts = self._with_bytes(ids, points[last], counts)
        return ids.astype(np.uint32), counts

    def _with_bytes(self, ids: np.ndarray, points: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` with -1 replaced by the byte pieces of its character, and how many each stretch has then."""
        unknown = np.flatnonzero(ids < 0)
        chars, which = np.unique(points[unknown], return_inverse=True)
        coded = [chr(c).encode() for c in chars.tolist()]
        many = np.ones(len(ids), np.int64)
        many[unknown] = np.array([len(c) for c in coded])[which]
        begin = np.cumsum(many) - many
        out = np.repeat(ids, many)
        for k in range(4):
            has = many[unknown] > k
            column = np.array([self.byte_id[c[k]] if len(c) > k else -1 for c in coded])
            out[begin[unknown[has]] + k] = column[which[has]]
        whose = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(whose, weights=many, minlength=len(counts)).astype(np.int64)

    def _ids_of(self, found: Stretches) -> pa.LargeBinaryArray:
        """Ids (uint32) of every distinct stretch."""
        data, offsets = bytes(found.distinct.buffers()[2] or b""), np.frombuffer(found.distinct.buffers()[1], np.int64)[: len(found.distinct) + 1]
        raw = np.frombuffer(data, np.uint8)
        # A character begins at every byte that isn't a continuation.
        before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
        points, sizes = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32), np.diff(before)
        parts, counts = [], np.zeros(len(sizes), np.int64)
        low = 0
        long_ = np.flatnonzero(sizes > SHORT)
        for stop in [*long_.tolist(), len(sizes)]:
            while low < stop:
                high = min(stop, low + TOGETHER)
                ids, counts[low:high] = self._together(points[before[low] : before[high]], sizes[low:high])
                parts.append(ids)
                low = high
            if stop < len(sizes):
                ids = np.fromiter(self.search(data[offsets[stop] : offsets[stop + 1]].decode()), np.uint32)
                parts.append(ids)
                counts[stop] = len(ids)
                low = stop + 1
        return binary(np.concatenate(parts or [np.empty(0, np.uint32)]), counts)

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts (UTF-8) one after another, none for empty ones, and where each text's begin (one more at the end)."""
        flat, begins, at = [], [np.zeros(1, np.int64)], 0
        for low, high in portions(texts):
            full = [k for k in range(low, high) if texts[k]]
            if self.stretches:
                found = cut([texts[k] for k in full], runs=True)
                data, begin = found.gather(self._ids_of(found))
                ids, counts = np.frombuffer(data, np.uint32), np.diff(begin) // 4
            else:
                each = [np.fromiter(self.search(" " + texts[k].decode()), np.uint32) for k in full]
                ids, counts = np.concatenate(each or [np.empty(0, np.uint32)]), np.array([len(x) for x in each], np.int64)
            many = np.zeros(high - low, np.int64)
            many[np.array(full, np.int64) - low] = counts
            flat.append(ids)
            begins.append(at + np.cumsum(many))
            at += len(ids)
        return np.concatenate(flat or [np.empty(0, np.uint32)]), np.concatenate(begins)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids (uint32) of a text; none for null or empty."""
        return self.encode_all([(text or "").encode()])[0]

    def decode_all(self, ids: np.ndarray, begins: np.ndarray) -> Iterator[bytes]:
        """The UTF-8 of each of several texts from their ids one after another."""
        taken = self.table.take(pa.array(ids.view(np.int32)))
        data, offsets = memoryview(taken.buffers()[2] or b""), np.frombuffer(taken.buffers()[1], np.int64)
        bounds = offsets[begins].tolist()
        for low, high in zip(bounds, bounds[1:]):
            yield bytes(data[low + 1 : high])

    def decode(self, ids: np.ndarray) -> str:
        return next(self.decode_all(ids, np.array([0, len(ids)]))).decode()


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``doc_id, ids, n_tokens, ids_crc32, restored`` for each row of ``docs``.

    ``ids`` are those of the whole text (none for null and empty ones), ``ids_crc32`` the crc32 of them as
    little-endian 32-bit integers, ``restored`` whether decoding them gave exactly the text (null counting as empty). Repeated rows and null
    identifiers are passed on, an empty table gives no rows; other columns aren't read. ``model`` is the path of a SentencePiece model on every machine.
    """
    path = model or default_model()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for b in slices(batches):
            texts = batch_bytes(b.column("text"))
            ids, begins = pieces.encode_all(texts)
            restored = [t == back for t, back in zip(texts, pieces.decode_all(ids, begins))]
            bounds, raw = begins.tolist(), memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            sums = pa.array([zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(bounds, bounds[1:])], pa.int64())
            lists = pa.ListArray.from_arrays(begins.astype(np.int32), ids.view(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(np.diff(begins)), sums, pa.array(restored, pa.bool_())], ["doc_id", "ids", "n_tokens", "ids_crc32", "restored"])

    source = spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    return source.mapInArrow(encoded, "doc_id bigint, ids array<int>, n_tokens bigint, ids_crc32 bigint, restored boolean")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents")).drop("ids")
