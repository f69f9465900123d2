"""Least numbers of groups of compatible signatures, against trying all groupings and known cases."""

import random

from tidewright.operators import reports


def brute(nodes):
    """The least number of groups by trying each signature in every group."""
    nodes = sorted(set(nodes))
    agree = lambda a, b: len(a) == len(b) and all(not x or not y or x == y for x, y in zip(a, b))

    def rest(k, groups):
        if k == len(nodes):
            return len(groups)
        found = [rest(k + 1, [*groups, [nodes[k]]])] if len(groups) < 8 else [99]
        for i, g in enumerate(groups):
            if all(agree(nodes[k], x) for x in g):
                found.append(rest(k + 1, [*groups[:i], [*g, nodes[k]], *groups[i + 1 :]]))
        return min(found)

    return rest(0, [])


def test_small_groups_equal_all_groupings():
    rng = random.Random(1)
    for _ in range(400):
        nodes = [tuple(rng.choice(["", "", "a", "b", "c"]) for _ in range(rng.choice((2, 3, 4)))) for _ in range(rng.randrange(8))]
        assert reports.colouring(nodes) == (brute(nodes), True)


def test_large_groups_are_exact_too():
    assert reports.colouring([(str(k), "") for k in range(300)]) == (300, True)
    assert reports.colouring([("", str(k)) for k in range(50)] + [(str(k), "") for k in range(50)]) == (50, True)
    # Hidden groups: each signature is one of seven with half of its types unknown.
    rng = random.Random(2)
    full = [tuple(f"{g}{k}" for k in range(10)) for g in range(7)]
    nodes = full + [tuple(x if rng.random() < 0.5 else "" for x in rng.choice(full)) for _ in range(400)]
    assert reports.colouring(nodes) == (7, True)


def test_what_is_not_proved_is_said(spark):
    rng = random.Random(3)
    nodes = list({tuple(rng.choice(["", "", "", "a", "b", "c"]) for _ in range(12)) for _ in range(200)})
    count, proved = reports.colouring(nodes, steps=5)
    assert not proved and count >= reports.colouring(nodes, steps=20_000)[0]
    df = spark.createDataFrame([("t", "s", ["a", ""]), ("t", "s", ["", "b"]), ("t", "s", ["c", ""]), ("u", "s", ["a"])], "target string, skeleton string, signatures array<string>")
    assert sorted(map(tuple, reports.logical_paths(df, "target", "skeleton", "signatures", "proved").collect())) == [("t", 2, True), ("u", 1, True)]
