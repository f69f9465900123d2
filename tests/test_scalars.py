import random

from pyspark.sql import functions as F

from tidewright.functions import scalars, text
from tidewright.operators import core


def test_ratios_round_half_to_even(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(2000), rng.randrange(1, 2000)) for _ in range(500)] + [(1, 2_000_000), (3, 2_000_000), (5, 0), (None, 3), (3, None)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a bigint, b bigint")
    got = {r.k: r.r for r in df.select("k", scalars.ratio(F.col("a"), F.col("b")).alias("r")).collect()}
    assert got == {k: round(a / b, 6) if a is not None and b else None for k, (a, b) in enumerate(pairs)}
    halves = spark.createDataFrame([(2.675,), (0.125,), (-0.375,), (1.005,), (float("inf"),)], "x double")
    assert [r.r for r in halves.select(scalars.half_even(F.col("x"), 2).alias("r")).collect()] == [2.67, 0.12, -0.38, 1.0, float("inf")]


def test_descriptors_as_columns(spark):
    df = spark.createDataFrame([("(I[[Ljava/lang/String;J)V",), ("()Z",), ("(Q)V",), ("(L",), (None,)], "d string")
    assert [r.t for r in df.select(scalars.descriptor_types(F.col("d")).alias("t")).collect()] == [["int", "java.lang.String[][]", "long", "void"], ["boolean"], None, None, None]


def test_reasons_and_versions_from_their_rules(spark):
    reasons = {"HTTPServer2Name": "HTTP_SERVER2_NAME", "already_DONE": "ALREADY_DONE", "  a--b  ": "A_B", "": "UNKNOWN", None: "UNKNOWN", "ABC1Def": "ABC1_DEF", "XMLHttpRequest": "XML_HTTP_REQUEST", "éa B": "A_B", "SpringPackagedClassAmbiguous": "SPRING_RUNTIME_CLASS_AMBIGUOUS", "A1b": "A1B", "aB": "A_B", "_x_": "X"}
    df = spark.createDataFrame([(k,) for k in reasons], "r string")
    assert {r.r: r.c for r in df.select("r", text.canonical_reason(F.col("r")).alias("c")).collect()} == reasons
    versions = {"v1.0.Final": "1.0", "31.1-jre": "31.1", "1.0+build.7": "1.0", "2.RELEASE": "2", "1.0RELEASE": "1.0", " VV3_GA ": "3", "-1.2-": "1.2", "android": "", None: "", "1.0.Final.GA": "1.0.Final", "1.0-rc1": "1.0-rc1"}
    df = spark.createDataFrame([(k,) for k in versions], "v string")
    assert {r.v: r.c for r in df.select("v", text.normal_version(F.col("v")).alias("c")).collect()} == versions


def test_distinct_in_the_order_of_first_rows(spark):
    df = spark.createDataFrame([("b", 3), ("a", 5), ("b", 1), (None, 2), ("a", 4), (None, 9)], "x string, seq int").repartition(3)
    assert [(r.x, r.seq, r.place) for r in core.ordered_distinct(df, ["x"], "seq").orderBy("place").collect()] == [("b", 1, 1), (None, 2, 2), ("a", 4, 3)]
