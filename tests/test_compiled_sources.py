"""Readers of source text and of tools' text against what the compiler and the disassembler really make of the same sources."""

import re
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from tidewright.operators import propagation
from tidewright.sources import classfile, javatext, textual

SOURCE = '''package port;
import java.util.*;
import java.util.function.*;
@Deprecated(since = "1{")
public class Yard<T extends Comparable<T>> extends Object implements Runnable {
  static final Map<String, List<int[]>> M = new HashMap<>();
  final String name = String.valueOf('{').trim(), other = String.valueOf("}");
  static Supplier<String> lazy = () -> Integer.toString(7);
  Function<String, Integer> length = s -> { return s.length(); };
  static { M.put("a", new ArrayList<int[]>()); init("static"); }
  { init(this.name); }
  Runnable job = new Runnable() {
    int k = Math.abs(-1);
    @Override public void run() { init("job"); other(); Collections.<String>emptyList().size(); }
    void other() { new Object() { void deep() { System.nanoTime(); } }.hashCode(); }
  };
  enum Tide {
    HIGH(Math.max(1, 2)) { @Override int level() { return Math.min(3, 4); } },
    LOW(5);
    final int n;
    Tide(int n) { this.n = n; }
    int level() { return Integer.signum(n); }
  }
  record Point(int x, int y) { Point { Objects.hash(x, y); } static Point at(int v) { return new Point(v, v); } }
  interface Lamp { String OIL = String.join(",", "a", "b"); default void light() { String.valueOf(1.0); } }
  @interface Mark { String value() default "f()"; }
  public Yard() { super(); }
  public Yard(int... sizes) throws RuntimeException { this(); init("x"); }
  static void init(String s) { s.isEmpty(); /* s.strip(); */ }
  <U> U twice(U u, Function<? super U, ? extends U> f) { return f.andThen(f::apply).apply(u); }
  public void run() {
    class Local { void go() { init("local"); } }
    new Local().go();
    String text = """
      init("no"); "quoted" {
      """.strip();
    switch (text) { case "a" -> init("b"); default -> { init(text); } }
    if (text instanceof String && !text.isBlank()) synchronized (this) { for (String s : List.of("p")) init(s); }
    super.toString().length();
    new int[] { "z".length() }.clone();
    Supplier<Yard<T>> made = Yard::new;
    made.get().job.run();
  }
  static void sink(String prefix, String type) throws Exception { Class.forName(type); }
  static void sink(String prefix, Object type) throws Exception { Class.forName(String.valueOf(type)); }
  static Class<?> load(String type) throws Exception { return Class.forName(type); }
  static Class<?> pass(int k, String type) throws Exception { return k > 0 ? pass(k - 1, type) : load(type); }
  static final String HIDDEN = "sea.Hidden";
  void uses() throws Exception { load("sea.One"); pass(3, "sea.Two"); pass(1, HIDDEN); String v = "sea.Three"; load(v); load(v + "x"); sink("a", "sea.Four"); Class.forName("sea.Own"); }
}
'''


@pytest.fixture(scope="module")
def compiled(spark, tmp_path_factory):
    if not shutil.which("javac") or not shutil.which("javap"):
        pytest.skip("needs a compiler")
    folder = tmp_path_factory.mktemp("yard")
    (folder / "Yard.java").write_text(SOURCE)
    subprocess.run(["javac", "-nowarn", "-parameters", "-d", str(folder), str(folder / "Yard.java")], check=True, timeout=120, capture_output=True)
    found = sorted((folder / "port").glob("*.class"))
    classes = spark.createDataFrame([("y.jar", f"port.{p.stem}", bytearray(p.read_bytes())) for p in found], "archive string, class string, content binary")
    text = subprocess.run(["javap", "-p", "-c", *map(str, found)], check=True, timeout=120, capture_output=True, text=True).stdout
    return classes, text


#: What the compiler adds by itself.
SYNTHETIC = {"values", "$values", "valueOf", "ordinal", "equals", "hashCode", "toString", "requireNonNull", "iterator", "hasNext", "next", "intValue", "invoke", "makeConcatWithConstants", "clone"}


def test_calls_of_a_source_are_those_of_its_bytecode(spark, compiled):
    real = classfile.calls(compiled[0]).where("kind IN ('method_invocation', 'constructor_invocation')").select("class", "method", "member", "owner").collect()
    bytecode = set()
    for r in real:
        m = re.fullmatch(r"lambda\$(\w+)\$\d+", r.method)
        method = {"new": "<instance>", "static": "<clinit>"}.get(m[1], m[1]) if m else r.method
        if r.member not in SYNTHETIC and not (r.method in SYNTHETIC and r["class"] == "port.Yard$Tide"):
            bytecode.add((r["class"], "<init>" if method == "<instance>" else method, r.member))
    got = javatext.calls(spark.createDataFrame([("Yard.java", SOURCE)], "path string, text string")).where("kind != 'method_reference'").collect()
    source = {(r.type, "<init>" if r.method == "<instance>" else r.method, r.member) for r in got if r.member not in SYNTHETIC}
    assert source - bytecode == set()
    implied = {x for x in bytecode - source if x[2] == "<init>"}  # constructors that call that of Object, of a record or an enum by themselves, and constants
    assert bytecode - source - implied == set()
    assert {(c, m) for c, m, _ in implied} <= {(c, m) for c, m, _ in bytecode if m in ("<init>", "<clinit>")}


def test_sources_have_no_problems_and_parts_not_understood_do(spark):
    df = spark.createDataFrame([("Yard.java", SOURCE), ("odd.java", "class A { int x { f(); } void g() { h(); } }"), ("cut.java", 'class A { String s = "x; }'), ("mix.java", "class A { void f( { ) } }")], "path string, text string")
    m = javatext.methods(df, inner=True)
    assert {r.path for r in m.where("problem IS NOT NULL").collect()} == {"odd.java", "cut.java", "mix.java"}
    assert {(r.type, r.method, r.params) for r in m.where("path = 'Yard.java'").collect()} >= {
        ("port.Yard", "<init>", "(int[])"), ("port.Yard", "twice", "(U,Function)"), ("port.Yard$1", "run", "()"), ("port.Yard$1$1", "deep", "()"), ("port.Yard$Tide$1", "level", "()"), ("port.Yard$1Local", "go", "()"),
        ("port.Yard$Point", "<init>", "()"), ("port.Yard$Point", "at", "(int)"), ("port.Yard$Lamp", "light", "()"), ("port.Yard$Mark", "value", "()"),
    }


def test_strings_from_sources_reach_lookups(spark):
    df = spark.createDataFrame([("Yard.java", SOURCE)], "path string, text string")
    arguments, overloads = javatext.arguments(df).cache(), javatext.overloads(df)
    direct = arguments.where((F.col("callee") == javatext.LOOKUP) & F.col("passes").isNotNull()).select(F.col("caller").alias("method"), F.col("passes").alias("position"))
    sinks = propagation.sink_parameters(arguments.where(F.col("callee") != javatext.LOOKUP), direct, overloads)
    assert {tuple(r) for r in sinks.collect()} == {("port.Yard.load(String)", 0), ("port.Yard.pass(int,String)", 1), ("port.Yard.sink(String,String)", 1)}
    # A group's position counts if all its overloads look up by it: sink/2 has one that doesn't.
    groups = overloads.join(sinks, "method", "left").groupBy("callee").agg(F.count("*").alias("n"), F.count("position").alias("have"), F.max("position").alias("position")).where("n = have")
    lookups = groups.select("callee", "position").unionByName(spark.createDataFrame([(javatext.LOOKUP, 0)], "callee string, position int"))
    uses = arguments.where("literal IS NOT NULL").join(lookups, ["callee", "position"], "left_semi")
    assert {r.literal for r in uses.collect()} == {"sea.One", "sea.Two", "sea.Hidden", "sea.Three", "sea.Own"}


def test_disassembled_text_equals_the_class_files(spark, compiled):
    classes, text = compiled
    got = textual.disassembled_calls(spark.createDataFrame([("yard.txt", text)], "path string, text string")).cache()
    kinds = ["method_invocation", "constructor_invocation", "field_access", "invokedynamic"]
    a = got.where(F.col("kind").isin(kinds)).groupBy("class", "method", "kind", "owner", "member", "descriptor").count()
    b = classfile.calls(classes).where(F.col("kind").isin(kinds)).groupBy("class", "method", "kind", "owner", "member", F.col("target_descriptor").alias("descriptor")).count()
    # The text writes array owners as descriptors too.
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    assert {r.params for r in got.where("class = 'port.Yard' AND method = 'sink'").select("params").distinct().collect()} == {"(java.lang.String,java.lang.String)", "(java.lang.String,java.lang.Object)"}
    assert got.where("method = '<clinit>'").count() > 0 and got.where("method IS NULL").count() == 0


def test_comparison_text_with_interfaces_and_remarks(spark):
    report = """***! MODIFIED CLASS: PUBLIC FINAL (<- NOT_FINAL) ABSTRACT com.x.A  (not serializable)
\t***  CLASS FILE FORMAT VERSION: 52.0 <- 50.0
\t+++  NEW INTERFACE: java.lang.Runnable
\t===  UNCHANGED SUPERCLASS: java.lang.Object (<- java.lang.Object)
\t---! REMOVED METHOD: PUBLIC(-) com.x.B[] quack(int, java.util.List)
---! REMOVED INTERFACE: PUBLIC(-) ABSTRACT(-) com.x.C  (compatible)
\t---! REMOVED FIELD: PUBLIC(-) STATIC(-) FINAL(-) int N
+++  NEW ENUM: PUBLIC(+) FINAL(+) STATIC(+) com.x.D$E
\t+++  NEW CONSTRUCTOR: PRIVATE(+) D$E()
=== UNCHANGED CLASS: PUBLIC ABC
"""
    got = textual.compared_members(spark.createDataFrame([("r", report)], "path string, text string"))
    assert sorted((r.owner, r.kind, r.status, r.incompatible) for r in got.collect()) == sorted([
        ("com.x.A", "class", "MODIFIED", True), ("com.x.A", "interface", "NEW", False), ("com.x.A", "superclass", "UNCHANGED", False), ("com.x.A", "method", "REMOVED", True), ("com.x.C", "interface", "REMOVED", True), ("com.x.C", "field", "REMOVED", True),
        ("com.x.D$E", "enum", "NEW", False), ("com.x.D$E", "constructor", "NEW", False), ("ABC", "class", "UNCHANGED", False),
    ])
