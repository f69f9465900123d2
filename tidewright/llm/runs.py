"""Runs of repeated words: maximal repetitions from Lyndon arrays, in the manner of Ellert and Fischer.

A word sequence is a string over the ordered alphabet of its words' numbers, which are only ever compared.
For the order and for its reverse every position gets the edge to its next smaller suffix, with the length of the
match along that edge. Whatever has been matched once isn't matched again: a match (p, j) makes what follows j a
copy of what follows p, so that edges inside the copy take their lengths from the edges there, and comparisons go
on only beyond the rightmost position seen. No suffix array, tree or hash is built. The edges from Lyndon
roots give all runs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batch_bytes, slices, spread, table
from .stretches import cut

_BLANKS = bytes(32 if 9 <= k <= 13 else k for k in range(256))
_SEVERAL = re.compile(rb"  +")
#: How often stretches are cut again at words that have become rare in them. Only saves work: what is left is searched in full.
_ROUNDS = 4
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon_edges(x: list[int]) -> tuple[list[int], list[int]]:
    """For each position that of the next smaller suffix (the length if none), and how far the two suffixes agree.

    The empty suffix is the smallest. Linear: every comparison that succeeds moves ``seen``, and one that fails ends an edge.
    """
    n = len(x)
    following, reach = [n] * n, [0] * n
    before, back = [-1] * n, [0] * n
    seen, copy, shift = 0, 0, 0  # x[copy:seen] equals what is ``shift`` to the left of it
    for j in range(1, n):
        p, same = j - 1, 0
        while p >= 0:
            # The suffixes at p and j agree on ``same`` symbols at least; every suffix between them is larger than both.
            known = -1
            if p >= copy and j + same < seen:
                a, b = p - shift, j - shift
                if following[a] == b:
                    known = reach[a]
                elif before[b] == a:
                    known = back[b]
                if known >= seen - j:
                    same, known = seen - j, -1
            if known >= 0:
                same = known
            else:
                while j + same < n and x[p + same] == x[j + same]:
                    same += 1
                if j + same >= seen:
                    seen, copy, shift = j + same, j, j - p
            if j + same < n and x[p + same] < x[j + same]:
                before[j], back[j] = p, same
                break
            following[p], reach[p] = j, same
            agree, p = back[p], before[p]
            while p >= 0 and agree > same:  # p agrees with the suffix just passed beyond the place where that differs from j
                following[p], reach[p] = j, same
                agree, p = back[p], before[p]
            if p >= 0 and agree < same:  # ... or differs from it, and so from j, before that place
                before[j], back[j] = p, agree
                break
    return following, reach


def runs(x: list[int], times: int = 2, least: int = 2) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of at least ``times`` (2 or more) periods and ``least`` symbols, in order.

    A run reaches to the right of its leftmost Lyndon root by the match of that root's edge under one of the two orders. To its left it
    goes on for less than a period, so these comparisons are fewer than a run has symbols.
    """
    n, found = len(x), set()
    for y in (x, [-v for v in x]):
        following, reach = lyndon_edges(y)
        for i, j in enumerate(following):
            period = j - i
            if j == n or reach[i] <= (times - 2) * period or i >= period and following[i - period] == i and reach[i - period] == reach[i] + period:
                continue  # not a root with such a run, or the root before it is of the same run
            start = i
            while start and y[start - 1] == y[start - 1 + period]:
                start -= 1
            length = j + reach[i] - start
            if length >= max(least, times * period):
                found.add((start, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches_with_runs(names: np.ndarray, doc: np.ndarray, times: int, least: int) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches outside of which no run can lie: a run has each of its words ``times`` times, so words that are rarer in their stretch are cut out."""
    part, at = doc.astype(np.int64), np.arange(len(names))
    for _ in range(_ROUNDS):
        if not len(at):
            return
        _, which, many = np.unique(part * (int(names.max()) + 1) + names[at], return_inverse=True, return_counts=True)
        stays = many[which] >= times
        at, part = at[stays], part[stays]
        new = np.append(True, (np.diff(at) > 1) | (np.diff(part) > 0))[: len(at)]
        part = np.cumsum(new) - 1
        long = np.bincount(part, minlength=1)[part] >= least if len(at) else np.zeros(0, bool)
        if stays.all() and long.all():
            break
        at, part = at[long], part[long]
    bounds = np.flatnonzero(np.append(True, np.diff(part) > 0)) if len(at) else []
    for low, high in zip(bounds, [*bounds[1:], len(at)]):
        yield int(at[low]), int(at[high - 1]) + 1


def runs_of_texts(texts: list[bytes], times: int, least: int, repeat: Callable[[int, int], tuple[int, int] | None]) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Number of words, runs and collapsed text of each text. If ``repeat`` gives (a, p) for a text's place and number of words, the words from number a on repeat the first p of them."""
    plain = [_SEVERAL.sub(b" ", t.translate(_BLANKS)).strip(b" ") for t in texts]
    found = cut(plain)
    names, first = found.which.to_numpy().astype(np.int64), found.first.copy()
    counts = np.where([not t for t in plain], 0, np.diff(first))  # cut() gives an empty text one stretch
    changed = [repeat(k, n) if n else None for k, n in enumerate(counts.tolist())]
    for k, how in enumerate(changed):
        if how:
            a, p = how
            own = names[first[k] : first[k + 1]]
            own[a:] = own[a + np.arange(len(own) - a) % p]
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    of: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for low, high in _stretches_with_runs(names, doc, times, least):
        k = int(doc[low])
        of[k] += [(start + low - int(first[k]), length, period) for start, length, period in runs(names[low:high].tolist(), times, least)]
    for k, t in enumerate(plain):
        if of[k] or changed[k]:
            change = np.zeros(counts[k] + 1, np.int64)
            for start, length, period in of[k]:
                change[start + period] += 1
                change[start + length] -= 1
            left = found.distinct.take(pa.array(names[first[k] : first[k + 1]][np.cumsum(change[:-1]) == 0]))
            ends = np.frombuffer(left.buffers()[1], np.int64)
            t = bytes(memoryview(left.buffers()[2] or b"")[ends[0] + 1 : ends[len(left)]])
        yield int(counts[k]), of[k], t


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = 4, least: int = 6, rewrite: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: its runs (array of start, length, period by start, then period) and its words without the repeats.

    Words are runs of other than ASCII white space, numbered from 0. A run is a stretch of words with smallest period q, of at
    least ``times`` q (3 or more) and ``least`` words, that can't be made longer. ``collapsed`` joins by a blank the words
    that no run holds after its first period. ``rewrite`` gives for an identifier and a number of words where to repeat what, or None.
    Null, empty and blank texts have no words, no runs and the collapsed text ''. Rows are handled one by one, so null, equal or repeated
    identifiers and rows are kept as they are; an empty table gives none; other columns aren't read, whatever their names. Nothing is shuffled.
    """
    if times < 3:
        raise ValueError("times must be 3 at least")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, ids = batch_bytes(b.column("text")), b.column("doc_id").to_pylist()
            rows = list(runs_of_texts(texts, times, least, lambda k, n: rewrite(ids[k], n) if rewrite else None))  # noqa: B023
            spans = [[{"start": s, "length": n, "period": p} for s, n, p in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array(spans, pa.list_(_RUN)), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return spread(rows).mapInArrow(search, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The query's rule for texts whose last words repeat: by the crc32 of the identifier; none for a null one."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % n
    return (a, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    # Runs are in the order of ties, so that only a greater exponent takes the place of an earlier one.
    greater = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.reduce("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda best, r: F.when(greater(best, r), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
