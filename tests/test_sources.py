import glob
import io
import os
import zipfile

import pyspark
from pyspark.sql import functions as F

from tidewright.sources import archives, classfile, files, reports


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_csv_with_mark_quotes_and_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffname,note\nx,"a ""b""\nc"\ny,\n', encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), ["note", "name", "more"], ["name"])
    assert rows(got) == [('a "b"\nc', "x", None), (None, "y", None)]
    try:
        files.read_csv(spark, str(tmp_path / "a.csv"), ["name"], ["absent"])
        raise AssertionError("a missing required column must fail")
    except ValueError as e:
        assert "absent" in str(e)


def test_json_is_read_tolerantly(spark):
    df = spark.createDataFrame([(1, '{"a": 5}'), (2, "{"), (3, None)], "id int, j string")
    good, bad = files.parse_json(df, "j", "a int", "facts")
    assert rows(good.select("id", "parsed.a")) == [(1, 5), (2, None), (3, None)]
    assert rows(bad) == [("facts", "INPUT_MALFORMED", "{"), ("facts", "INPUT_MISSING", None)]


def test_source_tree_and_lines(spark, tmp_path):
    for name, text in {"src/A.java": "x\n// Thread t\nnew THREAD();\nthread", "build/B.java": "thread", "src/test/C.java": "thread", "src/d.txt": "thread"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.source_files(spark, str(tmp_path), [".java"])
    assert [r.line_no for r in files.scan_lines(found, "thread").orderBy("line_no").collect()] == [3, 4]
    assert files.scan_lines(found, "thread", per_file=1).count() == 1
    assert files.source_files(spark, str(tmp_path), [".java"], tests=True).count() == 2


def test_configuration_becomes_dotted_keys(spark):
    p = spark.createDataFrame([("a", "# c\nx.y = 1\nlong: a\\\n  b\n\nalone\n"), ("b", ""), ("c", None)], "path string, text string")
    assert rows(files.flatten_properties(p).select("key", "value")) == [("alone", ""), ("long", "ab"), ("x.y", "1")]
    y = spark.createDataFrame([("a", "a:\n  b: 1\n  c:\n    d: 'x: y' # note\ne: {f: 1}\n\tg: 1\nh: 2\n")], "path string, text string")
    assert rows(files.flatten_yaml(y).select("line_no", "key", "value", "incomplete").where("NOT incomplete")) == [(2, "a.b", "1", False), (4, "a.c.d", "x: y", False), (7, "h", "2", False)]
    assert [r.line_no for r in files.flatten_yaml(y).where("incomplete").orderBy("line_no").collect()] == [5, 6]


def test_archives_are_opened_within_limits(spark):
    inner = zipped([("p/A.class", b"1"), ("META-INF/versions/11/p/A.class", b"2"), ("META-INF/versions/21/p/A.class", b"3")])
    outer = zipped([("lib/in.jar", inner), ("../up", b"x"), ("q/B.class", b"4")])
    df = spark.createDataFrame([("good", bytearray(inner)), ("odd", bytearray(outer)), ("bad", bytearray(b"nothing")), ("none", None)], "archive string, content binary")
    found = archives.entries(df, (".class",))
    assert {r.archive: (r.n_entries, r.reasons) for r in archives.verdicts(found).collect()} == {"good": (3, []), "odd": (6, ["ARCHIVE_ENTRY_PATH_UNSAFE"]), "bad": (1, ["ARCHIVE_FORMAT_INVALID"]), "none": (1, ["ARCHIVE_FORMAT_INVALID"])}
    assert rows(archives.effective(found, 17).select("archive", "place", "class", "version")) == [("good", "", "p.A", 11), ("odd", "", "q.B", 0), ("odd", "lib/in.jar", "p.A", 11)]
    deep = archives.entries(df, (), archives.Limits(depth=0, entries=5))
    assert "ARCHIVE_NESTED_DEPTH_EXCEEDED" in {r.reason for r in deep.collect()}
    assert "ARCHIVE_ENTRY_COUNT_EXCEEDED" in {r.reason for r in archives.entries(df, (), archives.Limits(entries=2)).collect()}


def test_packaged_archives_say_what_they_are(spark):
    pom = lambda g, a, v: f"#x\ngroupId={g}\nartifactId={a}\nversion = {v}\n".encode()
    one = zipped([("META-INF/maven/g/gull/pom.properties", pom("g", "gull", "1.0"))])
    two = zipped([("META-INF/maven/g/tern/pom.properties", pom("g", "tern", "2")), ("META-INF/maven/h/shaded/pom.properties", pom("h", "shaded", "3"))])
    outer = zipped([("lib/gull-1.0.jar", one), ("lib/tern-2.jar", two), ("lib/other.jar", two), ("lib/bare.jar", zipped([("A.class", b"1")]))])
    found = archives.entries(spark.createDataFrame([("w", bytearray(outer))], "archive string, content binary"), ("pom.properties",))
    got = rows(archives.packaged(found).select("entry", "coord", "version", "status"))
    assert got == [("lib/bare.jar", None, None, "unresolved"), ("lib/gull-1.0.jar", "g:gull", "1.0", "resolved"), ("lib/other.jar", None, None, "ambiguous"), ("lib/tern-2.jar", "g:tern", "2", "resolved")] or [tuple(x or None for x in g) for g in got] == [("lib/bare.jar", None, None, "unresolved"), ("lib/gull-1.0.jar", "g:gull", "1.0", "resolved"), ("lib/other.jar", None, None, "ambiguous"), ("lib/tern-2.jar", "g:tern", "2", "resolved")]


def test_consumer_links(spark):
    refs = spark.createDataFrame([("j", "A", "m", "()V", "field_access", "p.C", "X", "I", None), ("j", "A", "m", "()V", "field_access", "p.C", "X", "I", None), ("j", "B", "n", "()V", "method_invocation", "p.C", "X", "()V", None), ("j", "B", None, None, None, None, None, None, "bad")], classfile.CALLS)
    fields = spark.createDataFrame([("p.C", "X"), ("p.C", "Y")], "owner string, field string")
    assert rows(classfile.consumer_links(refs, fields)) == [("p.C", "X", 1, 2)]


def test_class_changes(spark):
    o = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "class string, sha256 string")
    n = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "class string, sha256 string")
    assert rows(archives.class_changes(o, n)) == [("b", "modified"), ("c", "removed"), ("d", "added")]


def test_class_files_of_a_public_jar(spark):
    jar = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "slf4j-api-*.jar"))[0]
    found = archives.entries(spark.createDataFrame([(jar, bytearray(open(jar, "rb").read()))], "archive string, content binary"), (".class",))
    classes = archives.effective(found, 17)
    calls = classfile.calls(classes).cache()
    assert calls.where("problem IS NOT NULL").count() == 0
    kinds = {r.kind for r in calls.select("kind").distinct().collect()}
    assert {"method_invocation", "constructor_invocation", "field_access", "type_reference", "exception_handler"} <= kinds
    assert calls.where("class = 'org.slf4j.LoggerFactory' AND method = 'getLogger' AND owner = 'org.slf4j.ILoggerFactory' AND member = 'getLogger'").count() > 0
    shapes = classfile.field_shapes(classes)
    assert rows(shapes.where("class = 'org.slf4j.Logger' AND field = 'ROOT_LOGGER_NAME'").select("type", "constant")) == [("java.lang.String", "ROOT")]
    broken = spark.createDataFrame([("a", "x.Y", bytearray(b"\xca\xfe\xba\xbe\x00")), ("a", "z", None)], "archive string, class string, content binary")
    assert classfile.calls(broken).where("problem IS NOT NULL").count() == 2


def test_descriptors():
    assert classfile.source_types("(I[[Ljava/lang/String;J)V") == ["int", "java.lang.String[][]", "long", "void"]


def test_maven_lines(spark):
    want = {
        "net.sea:gull:jar:3.1:compile": ("net.sea:gull", "jar", "3.1", "compile", ""),
        "[INFO]    net.sea:gull::3.1:TEST -- module net.sea (auto)": ("net.sea:gull", "jar", "3.1", "test", ""),
        "net.sea:tern:zip:win-x64:1.0~rc1:provided (optional)": ("net.sea:tern:win-x64", "zip", "1.0~rc1", "provided", ""),
        "net.sea:tern:2+b.7:plugin-only": ("net.sea:tern", "jar", "2+b.7", "plugin-only", ""),
        "[INFO] net.sea:auk:jar:5:runtime:/opt/lib dir/auk-5.jar": ("net.sea:auk", "jar", "5", "runtime", "/opt/lib dir/auk-5.jar"),
        "net.sea:auk:jar:nat:5:runtime:D:\\lib\\auk.jar -- module a.k": ("net.sea:auk:nat", "jar", "5", "runtime", "D:\\lib\\auk.jar"),
    }
    none = ["net.sea:parent:pom:1:import", "[INFO] Finished at: 12:30", "a:b:c", "one two:three:four:five", ":b:jar:1:compile", "", "   ", None]
    lines = spark.createDataFrame([(t,) for t in [*want, *none]], "line string")
    got = reports.maven_dependencies(lines).select("key", "type", "version", "scope", "path")
    assert rows(got) == sorted(want.values(), key=repr)


def test_gradle_lines(spark):
    texts = ["runtimeClasspath - x", "+--- a.b:c:1.0 -> 1.2 (*)", "|    \\--- d:e:2.0", "\\--- project :core", "     +--- f:g -> 3"]
    got = reports.gradle_dependencies(spark.createDataFrame([(t,) for t in texts], "line string"))
    assert rows(got.select("group_id", "artifact_id", "version", "depth", "project")) == [("", "", "", 0, ":core"), ("a.b", "c", "1.2", 0, ""), ("d", "e", "2.0", 1, ""), ("f", "g", "3", 1, "")]


def test_comparison_reports(spark):
    text = """<report><classes>
      <class fullyQualifiedName="p.Duck" changeStatus="MODIFIED" binaryCompatible="false" sourceCompatible="false">
        <interfaces><interface fullyQualifiedName="p.Swims" changeStatus="UNCHANGED"/></interfaces>
        <methods><method name="quack" changeStatus="REMOVED"><parameters><parameter type="int"/><parameter type="long[]"/></parameters><compatibilityChanges><compatibilityChange type="METHOD_REMOVED"/></compatibilityChanges></method>
          <method name="dive" changeStatus="NEW" binaryCompatible="true"/><method name="swim" changeStatus="MODIFIED" binaryCompatible="true" sourceCompatible="false"/><method name="walk" changeStatus="MODIFIED" binaryCompatible="true" sourceCompatible="true"/></methods>
        <fields><field name="LEGS" changeStatus="MODIFIED" oldValue="2" newValue="3"/><field name="EYES" changeStatus="REMOVED"><oldValue>2</oldValue></field></fields></class>
      <interface fullyQualifiedName="p.Flies" changeStatus="REMOVED"/><enum fullyQualifiedName="p.Colour" changeStatus="MODIFIED" binaryCompatible="false"><compatibilityChanges><compatibilityChange>CLASS_NOW_FINAL</compatibilityChange></compatibilityChanges></enum>
      <record name="p.Egg" changeStatus="MODIFIED"><interfaces><interface fullyQualifiedName="p.Round" changeStatus="REMOVED"/></interfaces></record>
      <annotation fullyQualifiedName="p.Wet" changeStatus="UNCHANGED"/><class fullyQualifiedName="java.util.Pond" changeStatus="REMOVED"/></classes></report>"""
    texts = {"ok": text, "none": "<report><classes/></report>", "other": "<html/>", "dtd": "<!DOCTYPE a><a><classes/></a>", "cut": "<report><classes>", "null": None, "nameless": "<r><classes><class/></classes></r>"}
    facts = reports.comparison_facts(spark.createDataFrame(list(texts.items()), "report string, text string"))
    assert [r.report for r in facts.where("problem IS NOT NULL").orderBy("report").collect()] == ["cut", "dtd", "nameless", "null", "other"]
    got = reports.changed_apis(facts).select("owner", "kind", "name", "parameters", "change_type", F.array_join("flags", ","))
    assert rows(got) == sorted([
        ("p.Duck", "method", "quack", "int,long[]", "REMOVED", "METHOD_REMOVED"), ("p.Duck", "method", "swim", "", "SOURCE_INCOMPATIBLE", ""), ("p.Duck", "field", "LEGS", "", "CONSTANT_VALUE_CHANGED", ""),
        ("p.Duck", "field", "EYES", "", "REMOVED", "CONSTANT_REMOVED"), ("p.Flies", "interface", "", "", "REMOVED", ""), ("p.Colour", "enum", "", "", "SIGNATURE_CHANGED", "CLASS_NOW_FINAL"), ("p.Egg", "record", "", "", "SIGNATURE_CHANGED", ""),
    ], key=repr)


def test_diffs(spark):
    text = "--- a/X.java\n+++ b/X.java\n@@ -1,4 +1,4 @@\n keep\n-  public int gone(int a) {\n---- odd\n-  public void f(int a) {\n+  public void f(long a) {\n+  protected String fresh() {\n+x\n"
    lines = reports.changed_lines(spark.createDataFrame([("d", text), ("e", ""), ("n", None)], "diff string, text string"))
    assert rows(lines.select("sign", "line_no", "line").where("sign = '-'"))[1] == ("-", 3, "--- odd")
    assert rows(reports.changed_declarations(lines).select("name", "change_type")) == [("f", "SIGNATURE_CHANGED"), ("gone", "REMOVED")]


def test_sinks(spark, tmp_path):
    files.write_parts(spark.range(10).coalesce(1), str(tmp_path / "p"), rows=4)
    assert len(list((tmp_path / "p").glob("*.parquet"))) == 3
    for k in range(2):
        files.append_ledger(spark.range(2).select(F.col("id") + k), str(tmp_path / "l"), f"s{k}")
    assert rows(spark.read.parquet(str(tmp_path / "l")).groupBy("step").count()) == [("s0", 2), ("s1", 2)]
    files.write_csv(spark.createDataFrame([('a "q"\nb', "")], "x string, y string"), str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), ["x"]).first()[0] == 'a "q"\nb'
