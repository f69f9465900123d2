import json

import pytest
from pyspark.sql import functions as F

from tidewright.sources import javatext, resources, store, textual
from tidewright.streaming import events

SHIP = '''package port.dock;
import java.util.*;
/* class Fake { void no() { x.y(); } } */
@Component
@FeignClient("a{b")
public class Ship extends Hull implements Floats {
  private final Engine engine = new Engine("v{1");
  private Map<String, List<Crew>> crews;

  public Ship(Engine e, int... sizes) { super(e); this.engine.start(); }

  @Transactional
  @EventListener(classes = {Storm.class})
  public <T extends Cargo> void sail(final Map<String, List<T>> load, @Nullable String[] ports) throws IOException {
    if (load.isEmpty()) { return; } // engine.stop();
    String s = "engine.burn(";
    load.values().forEach(Cargo::check);
    Crew crew = crews.get("mate").get(0);
    crew.wake(1, f(2, 3));
    Class.forName("port.Secret");
    Class.forName(s);
    ServiceLoader<Pilot> pilots = ServiceLoader.load(Pilot.class);
    Runnable r = new Runnable() { public void run() { engine.stop(); } };
  }
  abstract int weigh();
  static class Anchor { void drop() { Ship.sink(); } }
  enum Flag { RED, BLUE; String hex() { return name(); } }
}
'''


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/"), v) for k, v in texts.items()], "path string, text string")


def test_java_methods_and_calls(spark):
    src = spark.createDataFrame([("Ship.java", SHIP), ("bad.java", "class A { void f() {"), ("empty.java", ""), ("null.java", None)], "path string, text string")
    m = javatext.methods(src)
    assert rows(m.where("problem IS NULL").select("type", "method", "params", "first_line")) == sorted([
        ("port.dock.Ship", "<init>", "(Engine,int[])", 10), ("port.dock.Ship", "sail", "(Map,String[])", 14), ("port.dock.Ship", "weigh", "()", 25), ("port.dock.Ship$Anchor", "drop", "()", 26), ("port.dock.Ship$Flag", "hex", "()", 27),
    ], key=repr)
    assert [r.path for r in m.where("problem IS NOT NULL").collect()] == ["bad.java"]
    assert rows(m.where("method = 'sail'").select(F.array_join("annotations", ","), F.array_join("type_annotations", ","))) == [("Transactional,EventListener", "Component,FeignClient")]
    c = javatext.calls(src)
    got = {(r.method, r.kind, r.receiver, r.receiver_type, r.member, r.arguments) for r in c.collect()}
    assert {
        ("<init>", "method_invocation", "this.engine", "Engine", "start", 0), ("sail", "method_invocation", "load", "Map", "isEmpty", 0), ("sail", "method_reference", "Cargo", "Cargo", "check", None),
        ("sail", "method_invocation", "crew", "Crew", "wake", 2), ("sail", "method_invocation", "this", "port.dock.Ship", "f", 2), ("sail", "constructor_invocation", None, "Runnable", "<init>", 0), ("drop", "method_invocation", "Ship", "Ship", "sink", 0),
    } <= got
    assert not any(r[4] in ("burn", "y") for r in got)
    assert rows(resources.reflection(c).select("owner", "kind", "reason")) == [("port.Secret", "reflection_class_lookup", None), (None, "reflection_class_lookup", "DYNAMIC_CLASS_NAME")] or rows(resources.reflection(c).select("owner", "reason")) == sorted([("port.Secret", None), (None, "DYNAMIC_CLASS_NAME")], key=repr)
    assert rows(resources.load_points(c).select("caller", "kind")) == [("port.dock.Ship.sail", "java_spi_load_point")]
    assert {r.kind for r in resources.annotated(m).where("callee LIKE '%sail%'").collect()} == {"spring_transaction_proxy_dispatch", "spring_event_listener", "declarative_http_client_outbound"}


def test_parameter_types():
    assert [javatext.parameter_types(t) for t in ("", "int a", "final Map<K, List<V>> m, String... s", "@A(x = 1) int[] a, b.C c")] == ["()", "(int)", "(Map,String[])", "(int[],b.C)"]


def test_registrations(spark):
    f = files(spark, **{"a.jar!__META-INF__services__p.Pilot": "# c\np.One # x\n\np.Two", "META-INF__dubbo__q.Filter": "f1=q.F1", "x__META-INF__spring.factories": "k.Key=a.A,\\\n  a.B\nk.Other=c.C", "META-INF__spring__k.Auto.imports": "a.Conf", "readme": "p.No=1"})
    assert rows(resources.registrations(f).select("caller", "callee", "kind")) == sorted([
        ("p.Pilot", "p.One", "java_spi_registration"), ("p.Pilot", "p.Two", "java_spi_registration"), ("q.Filter", "q.F1", "dubbo_spi_registration"), ("k.Key", "a.A", "spring_factories_registration"), ("k.Key", "a.B", "spring_factories_registration"),
        ("k.Other", "c.C", "spring_factories_registration"), ("k.Auto", "a.Conf", "spring_autoconfiguration_registration"),
    ], key=repr)


def test_mapper_and_bean_files(spark):
    mapper = '<!DOCTYPE mapper PUBLIC "x" "y"><mapper namespace="p.Dao"><!-- <select id="no"/> --><select id="all" resultType="p.Row">SELECT 1</select><update parameterType="int" id=\'up\'/><result typeHandler="p.H"/></mapper>'
    f = files(spark, a=mapper, evil='<!DOCTYPE m [<!ENTITY x "y">]><mapper namespace="q"><select id="s"/></mapper>', none="<mapper/>")
    assert rows(resources.mybatis_bindings(f).select("caller", "callee", "kind")) == sorted([("p.Dao.all", "sql:p.Dao.all", "mybatis_mapper_binding"), ("p.Dao.up", "sql:p.Dao.up", "mybatis_mapper_binding"), ("p.Dao.all", "p.Row", "mybatis_type_reference"), ("p.Dao.up", "int", "mybatis_type_reference"), ("p.Dao", "p.H", "mybatis_type_handler_binding")], key=repr)
    beans = files(spark, b='<beans><bean id="a" class="p.A"><property name="x" ref="b"/></bean>\n<bean class="p.B" name="b"/></beans>')
    assert rows(resources.spring_xml(beans).select("caller", "callee", "kind")) == sorted([("a", "p.A", "spring_bean_dispatch"), ("b", "p.B", "spring_bean_dispatch"), ("a", "b", "spring_xml_property_injection")], key=repr)


def test_disassembler_and_comparison_text(spark):
    text = """Compiled from "A.java"
public class p.A extends p.B {
  public p.A();
    Code:
       1: invokespecial #1   // Method p/B."<init>":()V
  int run(java.lang.String, int) throws java.io.IOException;
    Code:
       1: invokevirtual #2   // Method java/lang/String.length:()I
       4: invokevirtual #3   // Method help:(I)V
       7: getfield      #4   // Field count:I
       9: new           #5   // class p/C
"""
    got = textual.disassembled_calls(files(spark, a=text, b=""))
    assert rows(got.select("method", "kind", "owner", "member", "descriptor")) == sorted([
        ("<init>", "constructor_invocation", "p.B", "<init>", "()V"), ("run", "method_invocation", "java.lang.String", "length", "()I"), ("run", "method_invocation", "p.A", "help", "(I)V"), ("run", "field_access", "p.A", "count", "I"), ("run", "type_reference", "p.C", None, None),
    ], key=repr)
    report = "***! MODIFIED CLASS: PUBLIC p.Duck  (not serializable)\n\t---! REMOVED METHOD: PUBLIC(-) void quack(int)\n\t+++  NEW FIELD: PUBLIC(+) int legs\n---! REMOVED CLASS: PUBLIC p.Owl\nnoise\n"
    got = textual.compared_members(files(spark, r=report))
    assert rows(got.where("kind <> 'class'").select("kind", "status", "incompatible", "declaration")) == [("field", "NEW", False, "PUBLIC(+) int legs"), ("method", "REMOVED", True, "PUBLIC(-) void quack(int)")]
    assert got.where("kind = 'class'").count() == 2
    assert rows(got.select("owner", "kind")) == [("p.Duck", "class"), ("p.Duck", "field"), ("p.Duck", "method"), ("p.Owl", "class")]


def test_stores(spark, tmp_path):
    e = spark.createDataFrame([("a", "b"), ("c", "b")], "caller string, callee string")
    store.write_index(e, e.select(F.col("caller").alias("m")), e.select(F.col("callee").alias("t")), f"{tmp_path}/i")
    assert store.load_index(spark, f"{tmp_path}/i")["edges"].count() == 2
    spark.createDataFrame([(0,)], "version int").write.mode("overwrite").parquet(f"{tmp_path}/i/version")
    with pytest.raises(ValueError):
        store.load_index(spark, f"{tmp_path}/i")
    seen = []

    def work(df):
        seen.append(sorted(r.sha256 for r in df.select("sha256").collect()))
        return df.where("content != ''").select("sha256", F.length("content").alias("size"))

    for names in (["x", "y"], ["y", "zz"], ["x", "zz"]):
        inputs = spark.createDataFrame([("s" + n, n if n != "y" else "") for n in names], "sha256 string, content string")
        got = rows(store.through_cache(inputs, f"{tmp_path}/c", "v1", work, "size int"))
        assert got == sorted([("s" + n, len(n)) for n in names if n != "y"], key=repr)
    assert seen == [["sx", "sy"], ["szz"]]
    pack = {"id": "jdk", "version": 2, "rules": [{"id": "a", "pattern": "x", "risk": "high", "since": 9}, {"id": "b", "pattern": "y", "risk": "low"}]}
    assert rows(store.rule_pack(spark, json.dumps(pack)).select("pack", "version", "rule", "since")) == [("jdk", "2", "a", 9), ("jdk", "2", "b", None)]
    for wrong in ({"id": "x"}, {"id": "x", "rules": [{"id": "a", "pattern": " ", "risk": "r"}]}, {"id": "x", "rules": pack["rules"][:1] * 2}):
        with pytest.raises(ValueError):
            store.rule_pack(spark, json.dumps(wrong))
    wanted = spark.createDataFrame([("g:a", "base", "1"), ("g:a", "current", "2")], "coord string, side string, sha256 string")
    have, lacking = store.materialised(wanted, spark.createDataFrame([("w.war", "lib/b.jar", "1"), ("w.war", "lib/a.jar", "1")], "archive string, entry string, sha256 string"))
    assert rows(have.select("coord", "entry")) == [("g:a", "lib/a.jar")] and rows(lacking.select("side")) == [("current",)]


def test_streams_and_steps(spark, tmp_path):
    schema = "k string, at timestamp_ntz"
    e = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ'2024-01-01 00:00:10'), ('a', TIMESTAMP_NTZ'2024-01-01 00:00:50'), ('b', TIMESTAMP_NTZ'2024-01-01 00:03:00'), ('a', TIMESTAMP_NTZ'2024-01-01 00:01:05') AS t(k, at)")
    assert rows(events.windowed_counts(e, "at", ["k"], "1 minute", "10 minutes").select("k", F.minute("start"), "n")) == [("a", 0, 2), ("a", 1, 1), ("b", 3, 1)]
    assert rows(events.session_counts(e, "at", "k", "30 seconds", "10 minutes").select("k", "n")) == [("a", 1), ("a", 2), ("b", 1)]
    folder = f"{tmp_path}/in"
    stream = lambda: events.append_diagnostics(spark, folder, schema, f"{tmp_path}/out", f"{tmp_path}/ck", lambda b: b.where("k = 'a'").select("k"))
    e.coalesce(1).write.parquet(folder)
    assert stream() == 1 and stream() == 0
    e.limit(1).write.mode("append").parquet(folder)
    assert stream() == 1 and spark.read.parquet(f"{tmp_path}/out").count() == 4
    ran = []

    def step(name, of):
        def work(done):
            ran.append(name)
            return of(done)

        return name, work

    steps = [step("one", lambda d: spark.range(3)), step("two", lambda d: d["one"].where("id > 0")), step("three", lambda d: d["two"].selectExpr("sum(id) AS s"))]
    for again in (None, None, "two"):
        assert events.run_steps(spark, steps, f"{tmp_path}/run", "r1", again)["three"].first()[0] == 3
    assert ran == ["one", "two", "three", "two", "three"]
    with pytest.raises(ValueError):
        events.run_steps(spark, steps, f"{tmp_path}/run", "r1", "four")
