import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from tidewright.llm import runs


def brute(x, times, least):
    """All runs by comparing every period at every position."""
    out, n = [], len(x)
    for p in range(1, n // times + 1):
        i = 0
        while i < n - p:
            if x[i] != x[i + p]:
                i += 1
                continue
            s = i
            while i < n - p and x[i] == x[i + p]:
                i += 1
            length = i + p - s
            if length >= max(least, times * p) and not any(length > d and all(x[k] == x[k + d] for k in range(s, s + length - d)) for d in range(1, p)):
                out.append((s, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def suffixes(x):
    """Next smaller suffixes and matches by definition."""
    n = len(x)
    following, reach = [], []
    for i in range(n):
        j = next((j for j in range(i + 1, n) if x[j:] < x[i:]), n)
        following.append(j)
        reach.append(next((k for k in range(n - j) if x[i + k] != x[j + k]), n - j) if j < n else 0)
    return following, reach


def texts_of(seed):
    rng = random.Random(seed)
    for _ in range(300):
        x = [rng.randrange(rng.choice((1, 2, 3, 5))) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            at, n = rng.randrange(len(x) + 1), rng.randrange(1, 6)
            x[at:at] = x[at : at + n] * rng.randrange(6)
        yield x


def test_lyndon_edges_equal_the_definition():
    for x in texts_of(1):
        assert runs.lyndon_edges(x) == suffixes(x)


@pytest.mark.parametrize("times, least", [(2, 2), (3, 2), (4, 6)])
def test_runs_equal_brute_force(times, least):
    for x in texts_of(2):
        assert runs.runs(x, times, least) == brute(x, times, least)


def test_edges_take_linear_time():
    class Symbol(int):
        compared = 0

        def __eq__(self, other):
            Symbol.compared += 1
            return int(self) == int(other)

        def __lt__(self, other):
            Symbol.compared += 1
            return int(self) < int(other)

    fibonacci = [[1], [1, 0]]
    while len(fibonacci[-1]) < 5000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    thue = [0]
    while len(thue) < 5000:
        thue += [1 - v for v in thue]
    nested = [0]
    for k in range(1, 8):
        nested = nested * 3 + [k]
    shapes = [[0] * 5000, list(range(5000)), list(range(5000, 0, -1)), fibonacci[-1], thue, nested, ([0] * 70 + [1]) * 70, [k for m in range(100) for k in [0] * m + [1]], [k for m in range(100, 0, -1) for k in [0] * m + [1]]]
    for x in shapes:
        for sign in (1, -1):
            Symbol.compared = 0
            runs.lyndon_edges([Symbol(sign * v) for v in x])
            assert Symbol.compared <= 6 * len(x)


def expected(doc_id, text):
    """The contract of the query, by brute force."""
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words, 4, 6)
    dropped = {i for s, length, p in found for i in range(s + p, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "a a a a a a"), (3, "a a a a a a"), (4, "x " * 400), (5, "ä b ä b\tä b\r\nä b"), (6, "a b a b a b a b c c c c c c d")]
    for doc_id in range(7, 160):
        words = [f"w{rng.randrange(rng.choice((3, 8, 60)))}" for _ in range(rng.randrange(120))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = words[at : at + rng.randrange(1, 5)] * rng.randrange(9)
        rows.append((doc_id, rng.choice((" ", "  ", "\n")).join(words)))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, runs string, best string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(*r) for r in rows), key=str)


def test_null_identifiers_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a a a a a a a b")], "doc_id bigint, text string")
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(df, rewrite=runs.planted).collect()] == [(8, [(0, 7, 1)], "a b")]
    assert runs.periodic_runs(df.limit(0)).count() == 0
