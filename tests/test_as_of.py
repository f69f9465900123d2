"""As-of joins and snapshot diffs against brute force."""

import datetime
import random

from pyspark.sql import functions as F

from tidewright.operators import core

DAY = datetime.datetime(2024, 1, 1)


def test_as_of_equals_brute_force(spark):
    rng = random.Random(1)
    when = lambda: None if rng.random() < 0.05 else DAY + datetime.timedelta(hours=rng.randrange(3000))
    left = [(k, rng.choice(["a", "b", None]), when()) for k in range(150)]
    right = [(rng.choice(["a", "b", "c", None]), when(), rng.choice([None, *range(9)])) for _ in range(60)]
    want = {}
    for k, key, at in left:
        seen = [(since, v) for other, since, v in right if other == key and v is not None and (since is None) == (at is None) and (at is None or since <= at)]
        want[k] = max(seen, key=lambda x: (x[0] or DAY, x[1]), default=(None, None))[1]
    l, r = spark.createDataFrame(left, "id int, key string, at timestamp_ntz"), spark.createDataFrame(right, "key string, since timestamp_ntz, v int")
    for span in ("month", "day"):
        got = core.as_of(l, r, ["key"], "at", "since", "v", span)
        assert got.columns == ["id", "key", "at", "as_of"] and {x.id: x.as_of for x in got.collect()} == want
    assert core.as_of(l, r.limit(0), ["key"], "at", "since", "v").where("as_of IS NOT NULL").count() == 0 and core.as_of(l.limit(0), r, ["key"], "at", "since", "v").count() == 0


def test_snapshots_are_paired_in_two_stages(spark):
    rng = random.Random(2)
    rows = lambda n: [(k, rng.choice(["f1", "f2", "f3", "f4", "", None]), rng.choice("abcdefg")) for k in range(n)]
    base, current = rows(14), rows(12)
    schema = "id int, full string, artifact string"
    want, left = set(), {}
    for key in {r[1] for r in base + current if r[1]}:
        sides = [[r for r in x if r[1] == key] for x in (base, current)]
        want |= {(a[0], b[0], "exact_coord") for a, b in zip(*sides)}
        n = min(map(len, sides))
        for name, rest in zip(("base", "current"), sides):
            left.setdefault(name, []).extend(rest[n:])
    for name, x in (("base", base), ("current", current)):
        left.setdefault(name, []).extend(r for r in x if not r[1])
    for artifact in {r[2] for x in left.values() for r in x}:
        b, c = ([r[0] for r in left[n] if r[2] == artifact] for n in ("base", "current"))
        if len(b) == len(c) == 1:
            want.add((b[0], c[0], "unique_artifact_migration"))
        else:
            want |= {(k, None, "unpaired_ambiguous" if c else "base_only") for k in b} | {(None, k, "unpaired_ambiguous" if b else "current_only") for k in c}
    got = core.snapshot_diff(spark.createDataFrame(base, schema), spark.createDataFrame(current, schema), "full", "artifact", ["id"])
    found = got.select(F.col("base.id").alias("b"), F.col("current.id").alias("c"), "pairing_status").collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)
