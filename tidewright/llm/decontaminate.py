"""Benchmark decontamination by SimHash over item-sized windows.

For every benchmark item, windows of the item's size slide over the documents. A window's 128-bit
SimHash comes from prefix sums of its shingles' sign vectors. A multi-index over the items'
fingerprints, by blocks of bits with a bounded number of flips looked up in each, finds every item
within the radius (if at most R of 128 bits differ, then one of B blocks differs in at most R // B).
Candidates are verified by the weighted Jaccard similarity of window and item: shingles weigh as often as they occur.

Each item has a radius of its own, from its counts: the widest angle at which a window can still be similar enough, given where the item's
weight lies, tells how many bits such a window is expected to differ in, and MARGIN standard deviations come on top. An item
with a shingle that is repeated many times has a wide radius, up to all bits.

A window without a single shingle of the item has similarity zero, so only windows that hold one are
fingerprinted. That loses no result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import as_scan, check_hash_seed, drop_rows, located, slices, spread, stage, table
from .jaccard_join import _A, _B, _mix

#: Bits of a fingerprint, standard deviations of the radius, bits that may differ in a block, candidate pairs looked at together.
BITS, MARGIN, FLIPS, PAIRS = 128, 4.5, 2, 2_000_000
#: Text of benchmark items that is broadcast at once; a larger benchmark is matched block by block.
BLOCK_BYTES = 4_000_000
_WORD = re.compile(r"\w+")


def word_hashes(text: str | None) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of ``size`` words, in their order."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    x = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        x = _mix(x * _B + words[k : len(words) - size + 1 + k])
    return x


def signs(grams: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of BITS bits of each shingle."""
    halves = np.stack([_mix(grams * _A), _mix(grams ^ _B)], 1)
    return np.unpackbits(halves.view(np.uint8).reshape(len(grams), -1), axis=1).astype(np.int32) * 2 - 1


def fingerprints(grams: np.ndarray, size: int) -> np.ndarray:
    """SimHash bits (one row each) of all windows of ``size`` shingles, by prefix sums."""
    sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(grams), 0, dtype=np.int32)])
    return (sums[size:] - sums[:-size] > 0).astype(np.uint8)


def weighted_similarity(a: np.ndarray, b: Counter) -> float:
    """Sum of smaller over sum of larger counts."""
    c = Counter(a.tolist())
    both = sum(min(v, b[k]) for k, v in c.items() if k in b)
    return both / (sum(c.values()) + sum(b.values()) - both)


def radius(counts: list[int], threshold: float) -> int:
    """Bits in which the fingerprint of a window as similar as ``threshold`` may differ from that of an item with shingles of these counts.

    The window lacks what makes the angle widest, the heaviest shingles, and has one other shingle as often as it can.
    """
    heavy = np.sort(np.array(counts, np.float64))[::-1]
    n, length = heavy.sum(), (heavy**2).sum()
    ends, squares = np.append(0, np.cumsum(heavy)), np.append(0, np.cumsum(heavy**2))
    most = 0.0
    for lost in range(int(n * (1 - threshold) + 1e-9) + 1):
        whole = int(np.searchsorted(ends, lost, side="right")) - 1
        part = lost - ends[whole]
        over = heavy[whole] if whole < len(heavy) else 0
        inner, square = squares[whole] + part * over, squares[whole] + part * part
        new = max(0, min(lost, int((n - lost) / threshold - n + 1e-9)))
        rest = length - 2 * inner + square + new * new
        most = max(most, np.arccos(np.clip((length - inner) / np.sqrt(length * rest), -1, 1)) if rest > 0 else np.pi)
    p = most / np.pi
    return min(BITS, int(np.ceil(BITS * p + MARGIN * np.sqrt(BITS * p * (1 - p)))))


def best_of(starts: np.ndarray, at: list[int], grams: np.ndarray, item: Counter, width: int) -> tuple[float, int]:
    """(-similarity, start) of the first best of the windows of ``width`` shingles at ``starts`` (ascending), by sliding over the places ``at`` of the item's shingles."""
    size, held, both = sum(item.values()), Counter(), 0
    best, enter, leave = (0.0, 0), 0, 0
    found = [int(grams[p]) for p in at]
    for start in starts.tolist():
        while enter < len(at) and at[enter] < start + width:
            g = found[enter]
            held[g] += 1
            both += held[g] <= item[g]
            enter += 1
        while leave < enter and at[leave] < start:
            g = found[leave]
            both -= held[g] <= item[g]
            held[g] -= 1
            leave += 1
        best = min(best, (-both / (size + width - both), start))
    return best


class HammingIndex:
    """All fingerprints within ``radius`` of a query, by blocks of which one differs in at most FLIPS bits. An index holds a number for each fingerprint and block; flips are made in the queries."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.packed, self.radius = self.pack(prints), radius
        self.edges = np.linspace(0, BITS, min(BITS // 4, max(BITS // 16, radius // (FLIPS + 1) + 1)) + 1).astype(int)
        self.tables = []
        for values, width in zip(self.blocks(prints).T, np.diff(self.edges)):
            order = np.argsort(values, kind="stable").astype(np.int32)
            flips = [sum(1 << b for b in c) for k in range(min(width, radius // (len(self.edges) - 1)) + 1) for c in combinations(range(width), k)]
            self.tables.append((order, values[order], np.array(flips, np.int64)))

    @staticmethod
    def pack(prints: np.ndarray) -> np.ndarray:
        return np.packbits(prints, axis=1).view(np.uint64)

    def blocks(self, prints: np.ndarray) -> np.ndarray:
        return np.stack([prints[:, a:b].astype(np.int64) @ (1 << np.arange(b - a)) for a, b in zip(self.edges[:-1], self.edges[1:])], 1)

    def search(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays of (query, fingerprint, distance) of all pairs within the radius, some queries at a time."""
        many = len(self.packed)
        packed, blocks = self.pack(prints), self.blocks(prints)
        step = max(1, PAIRS // (many * len(self.tables)))
        for low in range(0, len(prints), step):
            met = []
            for (order, keys, flips), values in zip(self.tables, blocks[low : low + step].T):
                probes = (values[:, None] ^ flips).ravel()
                first = np.searchsorted(keys, probes)
                counts = np.searchsorted(keys, probes, side="right") - first
                at = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                met.append(np.repeat(np.arange(len(probes)) // len(flips), counts) * many + order[at])
            pairs = np.unique(np.concatenate(met))
            q, i = pairs // many + low, pairs % many
            distance = np.bitwise_count(packed[q] ^ self.packed[i]).sum(axis=1)
            near = distance <= self.radius
            if near.any():
                yield q[near], i[near], distance[near]


class Benchmark:
    """Items prepared for matching: their shingles, and a Hamming index for the items of each window size and radius."""

    def __init__(self, items: list[tuple], size: int, threshold: float):
        self.threshold = threshold
        self.items, same = [], defaultdict(list)
        owners: dict[int, list] = defaultdict(list)  # shingle size: its items' distinct shingles
        for item_id, text in items:
            words = word_hashes(text)
            if len(words):
                n = min(size, len(words))  # an item of fewer words is one shingle
                grams = gram_hashes(words, n)
                k = len(self.items)
                counts = Counter(grams.tolist())
                self.items.append((item_id, n, counts, fingerprints(grams, len(grams))))
                same[n, len(grams), radius(list(counts.values()), threshold)].append(k)
                own = np.unique(grams)
                owners[n].append((own, np.full(len(own), k, np.int32)))
        self.index: dict[tuple[int, int], list] = defaultdict(list)
        for (n, width, reach), ks in same.items():
            self.index[n, width].append((np.array(ks), HammingIndex(np.concatenate([self.items[k][3] for k in ks]), reach)))
        self.filters = {}
        for n, parts in owners.items():
            grams, of = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(grams, kind="stable")
            keys, first = np.unique(grams[order], return_index=True)
            bits = max(12, int(np.ceil(np.log2(len(keys)))) + 7)
            near = np.zeros(1 << bits, bool)
            near[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.filters[n] = (np.uint64(64 - bits), near, keys, np.append(first, len(of)), of[order])

    def match(self, text: str | None) -> list[tuple]:
        """(item, start word, words, distance, similarity) of the best window for each item that the text holds."""
        words = word_hashes(text)
        best: dict[int, tuple] = {}
        for n, (shift, near, keys, first, owners) in self.filters.items():
            grams = gram_hashes(words, n)
            hits = np.flatnonzero(near[(grams >> shift).astype(np.int64)])
            which = np.minimum(np.searchsorted(keys, grams[hits]), len(keys) - 1)
            same = keys[which] == grams[hits]
            places: dict[int, list] = defaultdict(list)  # of each item's shingles
            for p, w in zip(hits[same].tolist(), which[same].tolist()):
                for k in owners[first[w] : first[w + 1]].tolist():
                    places[k].append(p)
            by_size: dict[int, list] = defaultdict(list)
            for k in places:
                by_size[sum(self.items[k][2].values())].append(k)
            for size, ks in by_size.items():
                width = min(size, len(grams))  # a shorter document is one window
                at = sorted({p for k in ks for p in places[k]})
                wanted = np.unique(np.clip(np.concatenate([np.arange(p - width + 1, p + 1) for p in at]), 0, len(grams) - width))
                starts: dict[int, list] = defaultdict(list)
                for run in np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1):
                    low, high = int(run[0]), int(run[-1])
                    prints = fingerprints(grams[low : high + width], width)
                    for of, index in self.index[n, size]:
                        for q, i, distance in index.search(prints):
                            found = of[i]
                            for k in np.unique(found).tolist():
                                if k in places:
                                    starts[k].append((q[found == k] + low, distance[found == k]))
                for k, parts in starts.items():
                    windows, distances = (np.concatenate(x) for x in zip(*parts))
                    score, start = best_of(windows, places[k], grams, self.items[k][2], width)
                    if -score >= self.threshold:
                        best[k] = (score, start, width + n - 1, int(distances[np.searchsorted(windows, start)]))
        return [(self.items[k][0], start, size, distance, -s) for k, (s, start, size, distance) in sorted(best.items())]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[tuple], bool]]:
    """Blocks of items, and whether there are several."""
    items = benchmark.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))
    many = max(1, -(-int(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES))
    for k in range(many):
        block = items if many == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(many)) == k)
        yield [tuple(r) for r in block.orderBy("i", "t").collect()], many > 1


_LEAKS = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, distance bigint, similarity double"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, distance, similarity``: for each row of ``docs`` and item found in it the best window.

    Words are runs of letters, digits and underscores in lower case. Ties go to the first window. Items of fewer words
    than ``size`` count as one shingle; null and empty texts hold nothing and are found nowhere. Repeated
    rows on either side give repeated results; null identifiers are passed on. Clean documents have no row.
    A benchmark of several blocks is matched one after the other, each into a staged table.
    """
    source = spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    out = None
    for items, more in _blocks(benchmark, item_col, item_text):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def found(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            check_hash_seed()
            prepared = Benchmark(held.value, size, threshold)
            for b in slices(batches):
                rows = [(d, *m) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for m in prepared.match(t)]
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 5 else pa.int64()) for k, c in enumerate(cols)], ["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"])

        part = source.mapInArrow(found, _LEAKS)
        if more:  # let go of the block
            part = stage(part, "leaks")
            held.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows that hold an item of ``benchmark`` (see leaks); all columns are kept. With a benchmark of several blocks, rows to drop are staged by locator."""
    at, schema, out = docs.columns.index(text_col), docs.schema, docs
    for items, more in _blocks(benchmark, item_col, item_text):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            check_hash_seed()
            prepared = Benchmark(held.value, size, threshold)
            for b in slices(batches, at):
                yield b.filter(pa.array([not prepared.match(t) for t in b.column(at).to_pylist()], pa.bool_()))

        def hit(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            check_hash_seed()
            prepared = Benchmark(held.value, size, threshold)
            for b in slices(batches):
                yield b.select([1, 2]).filter(pa.array([bool(prepared.match(t)) for t in b.column("text").to_pylist()], pa.bool_()))

        if not more:
            return spread(docs).mapInArrow(clean, schema)
        if out is docs:
            out = docs = as_scan(docs)
            names = ["_held_file", "_held_row"]
            while set(names) & set(docs.columns):
                names = [n + "_" for n in names]
        gone = stage(spread(located(docs, *names).select(F.col(text_col).alias("text"), *names)).mapInArrow(hit, f"{names[0]} string, {names[1]} bigint"), "held")
        held.destroy()
        out = drop_rows(located(docs, *names) if out is docs else out, gone, names)
    return out.drop(*names)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))
