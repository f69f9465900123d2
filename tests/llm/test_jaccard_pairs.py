"""Which documents a Jaccard join compares, and its links under frequent keys against all pairs."""

import random

from tidewright.llm import jaccard_join

WORDS = [f"w{k}" for k in range(5000)]


def sets(text):
    w = text.lower().split()
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}


def test_chance_meetings_make_no_cluster(spark, monkeypatch):
    rng = random.Random(1)
    block = {(i, j): rng.choices(WORDS, k=40) for i in range(10) for j in range(i)}
    docs = [(i, " ".join(w for j in range(10) if j != i for w in block[max(i, j), min(i, j)])) for i in range(10)]
    docs += [(20, docs[3][1] + " end"), (21, "")]
    compared = []
    keep = jaccard_join.stage
    monkeypatch.setattr(jaccard_join, "stage", lambda df, name: (out := keep(df, name), name == "join-members" and compared.append(out.count()))[0])
    got = {r.doc_id: r.component_id for r in jaccard_join.linked(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {i: i for i in range(10)} | {20: 3, 21: 21}
    assert compared == [2]  # any two share a block, but only one pair can be linked


def test_links_under_frequent_keys_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    rng = random.Random(2)
    for percent in (90, 50):
        docs = [" ".join(rng.choices("abc", k=rng.randrange(6))) for _ in range(30)]
        for _ in range(6):
            base = rng.choices(WORDS, k=rng.randrange(8, 90))
            for _ in range(9):
                text = list(base)
                for _ in range(rng.randrange(4)):
                    text[rng.randrange(len(text))] = rng.choice(WORDS)
                docs.append(" ".join(text))
        of = [sets(x) if x else set() for x in docs]
        least = list(range(len(docs)))
        for _ in docs:
            for a in range(len(docs)):
                for b in range(a):
                    if of[a] and of[b] and 100 * len(of[a] & of[b]) >= percent * len(of[a] | of[b]):
                        least[a] = least[b] = min(least[a], least[b])
        got = jaccard_join.linked(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), percent=percent)
        assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(least))


def test_little_is_shuffled_beside_keys(spark, monkeypatch):
    """Neither the n-grams of whole first parts, nor the members of a key twice."""
    joined = {}
    keep = jaccard_join.stage

    def nodes(plan):
        yield plan
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    def staged(df, name):
        inner = [x for x in nodes(df._jdf.queryExecution().optimizedPlan()) if x.nodeName() == "Join" and x.joinType().toString() == "Inner"]
        joined[name] = [[x.children().apply(k).output().mkString(" ") for k in (0, 1)] for x in inner]
        return keep(df, name)

    monkeypatch.setattr(jaccard_join, "stage", staged)
    rng = random.Random(3)
    base = " ".join(rng.choices(WORDS, k=200))
    got = jaccard_join.linked(spark.createDataFrame([(1, base), (2, base + " end"), (3, "end of " + base)], "doc_id bigint, text string"))
    assert [r.component_id for r in got.collect()] == [1, 1, 1]
    assert joined["join-prefixes"] and not any("first" in side for pair in joined["join-prefixes"] for side in pair)
    assert not any("grp" in one and "b#" in two for one, two in joined["join-pairs"]) and len(joined["join-pairs"]) == 2
    assert joined["join-links"] == []  # the sets know their cluster and chunk
