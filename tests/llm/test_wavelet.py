import math
import random
import re

import numpy as np
import pytest

from tidewright.llm import wavelet

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def expected(docs, items, k=10):
    """Scores of all documents by the contract."""
    held = [(doc_id, terms(t)) for doc_id, t in docs]
    n_docs, total = sum(1 for _, t in held if t), sum(len(t) for _, t in held)
    out = []
    for item_id, text in items:
        scored = []
        words = terms(text)
        weights = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(w in t for _, t in held) + 1))) for w in set(words)}
        for doc_id, t in held:
            m = 25 + 75 * len(t) * n_docs // total if total else 0
            score = sum(weights[w] * (1_000_000_000 * t.count(w) // (1000 * t.count(w) + 8 * m)) for w in words if w in t)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(scored, key=lambda r: r[:2] + (r[2] or 0,))[:k], 1)]
    return sorted(out, key=str)


def prose(rng, n):
    return "".join(rng.choice(["the", "The", "é", "Éa", "w1", "42", "x_y", *(f"v{int(rng.paretovariate(0.7)) % 300}" for _ in range(6))]) + rng.choice([" ", ", ", "\n", "--", "\x7f"]) for _ in range(n))


def test_terms_of_texts():
    texts = ["", "  ", "Aé-b_c9 ÀB", "\x00a\x7fb", "x", "日本 語。z"]
    found = wavelet.terms_of([t.encode() for t in texts])
    names = [t.decode() for t in found.distinct]
    got, at = [], 0
    for n in found.counts:
        got.append([names[k] for k in found.which[at : at + n]])
        at += n
    assert got == [terms(t) for t in texts] and len(set(names)) == len(names)
    assert list(wavelet.terms_of([]).counts) == [] and list(wavelet.terms_of([b""]).counts) == [0]


@pytest.mark.parametrize("split, unit", [(64, 4096), (1, 4096), (3, 70_000)])
def test_search_of_a_shard_is_exact(monkeypatch, split, unit):
    monkeypatch.setattr(wavelet, "SPLIT", split)
    monkeypatch.setattr(wavelet, "UNIT", unit)
    rng = random.Random(5)
    for n in (1, 2, 3, 64, 65, 200):
        docs = [(k, prose(rng, rng.choice((0, 3, 40)))) for k in range(n)]
        docs += docs[: n // 3]  # ties
        docs = [(k, t) for k, (_, t) in enumerate(docs)]
        total = sum(len(terms(t)) for _, t in docs)
        some = sum(1 for _, t in docs if terms(t))
        shard = wavelet.Shard(wavelet.build_shard([d for d, _ in docs], [t.encode() for _, t in docs], some, total))
        item = prose(rng, 12)
        words = sorted({w for w in terms(item) if w.encode() in shard.terms})
        lists = np.array([shard.terms.index(w.encode()) for w in words], np.int64)
        weights = np.array([terms(item).count(w) * wavelet.weight(sum(w in terms(t) for _, t in docs), some) for w in words], np.int64)
        if not (weights > 0).any():
            continue
        got = shard.search(lists[weights > 0], weights[weights > 0], 10)
        assert [(item, r, d, s) for r, (s, d) in enumerate(got, 1)] == sorted(expected(docs, [(item, item)]), key=lambda r: r[1])


def test_lists_are_in_the_order_of_impact_in_every_node():
    rng = random.Random(6)
    docs = [prose(rng, rng.randrange(1, 50)).encode() for _ in range(70)]
    shard = wavelet.Shard(wavelet.build_shard(list(range(70)), docs, 70, 900))
    for t in range(len(shard.terms)):
        nodes = [(shard.starts[t], shard.starts[t + 1])]
        for level in range(shard.height):
            after = []
            for lo, hi in nodes:
                ones = [int(shard.ones_before(np.array(level), np.array(p))) for p in (lo, hi)]
                z = shard.zeros[level]
                after += [(lo - ones[0], hi - ones[1]), (z + ones[0], z + ones[1])]
            nodes = [(lo, hi) for lo, hi in after if hi > lo]
            assert all((np.diff(shard.bounds[level + 1][lo:hi].astype(int)) <= 0).all() for lo, hi in nodes)
        assert all(hi == lo + 1 for lo, hi in nodes)


def run(spark, docs, items, tmp_path=None):
    index, n = wavelet.build_index(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
    return sorted(map(tuple, wavelet.search(index, n, spark.createDataFrame(items, "item_id bigint, text string")).collect()), key=str)


def test_operator_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK_BYTES", 500)  # several blocks
    rng = random.Random(7)
    docs = [(k, prose(rng, rng.choice((0, 2, 30, 90)))) for k in range(90)]
    docs += [(k + 100, docs[k % 7][1]) for k in range(60)] + [(200, None), (201, ""), (None, docs[3][1]), (3, docs[3][1])]
    rng.shuffle(docs)
    items = [(k, prose(rng, rng.randrange(14))) for k in range(25)] + [(90, None), (91, "nowhere"), (92, docs[0][1]), (None, "the w1 v2")]
    assert run(spark, docs, items) == expected(docs, items)


def test_empty_tables_and_terms_that_all_documents_have(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a b")], []) == [] and run(spark, [(1, None)], [(1, "a")]) == []
    assert run(spark, [(k, "a") for k in range(1000)], [(1, "a")]) == []  # a weight of 0
    assert run(spark, [(k, "a") for k in range(30)], [(1, "a a")]) == expected([(k, "a") for k in range(30)], [(1, "a a")])


def test_columns_with_other_names_are_left_alone(spark, tmp_path):
    spark.createDataFrame([(1, "a b c", "x", 2), (2, "d", "y", 3), (3, "e", "y", 3)], "doc_id bigint, text string, item string, rank int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "b", "x", 1)], "item_id bigint, text string, term string, score int").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = wavelet.op11_lexical_search(spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and [tuple(r)[:3] for r in got.collect()] == [(7, 1, 1)]
