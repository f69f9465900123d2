"""Members that diffs change in two languages, and technologies by coordinates."""

from tidewright.operators import rules
from tidewright.sources import reports

JAVA = """--- a/p/X.java
+++ b/p/X.java
@@ -1,20 +1,20 @@
-  public int gone(int a) {
-  public void f(int a) {
+  public void f(long a) throws IOException {
-  protected static final Map<String, int[]> LIMITS = Map.of();
+  protected static final Map<String, int[]> LIMITS = null;
-  public int[] sizes;
+  @Deprecated public <T> List<T> made(Class<T> of) {
-    return x;
+  private int hidden;
-  public   void same( ) {
+  public void same( ) { // moved
-  public void g(int a) {
-  public void g(String a) {
+  public void g(byte a) {
+  int packaged() {
"""
KOTLIN = """--- a/p/Y.kt
+++ b/p/Y.kt
@@ -1,9 +1,9 @@
-fun top(a: Int): String {
+fun top(a: Long): String {
-    private fun secret() {
+    override suspend fun work() = 1
-    val size: Int = 1
+    val size: Long = 1
+        val local = 2
-    internal var inner = 1
-    const val NAME = "x"
"""


def test_members_of_diffs(spark):
    lines = reports.changed_lines(spark.createDataFrame([("j", JAVA), ("k", KOTLIN), ("e", None)], "diff string, text string"))
    got = {(r.path, r.kind, r.name, r.change_type) for r in reports.changed_members(lines).collect()}
    assert got == {
        ("p/X.java", "method", "gone", "REMOVED"), ("p/X.java", "method", "f", "METHOD_SIGNATURE_CHANGED"), ("p/X.java", "field", "LIMITS", "FIELD_CHANGED"), ("p/X.java", "field", "sizes", "REMOVED"), ("p/X.java", "method", "made", "ADDED"),
        ("p/X.java", "method", "g", "METHOD_SIGNATURE_CHANGED"), ("p/X.java", "method", "g", "REMOVED"), ("p/Y.kt", "method", "top", "METHOD_SIGNATURE_CHANGED"), ("p/Y.kt", "method", "work", "ADDED"), ("p/Y.kt", "field", "size", "FIELD_CHANGED"), ("p/Y.kt", "field", "NAME", "REMOVED"),
    }
    f = reports.changed_members(lines).where("name = 'LIMITS'").first()
    assert (f.old, f.new) == ("protected static final Map<String, int[]> LIMITS = Map.of();", "protected static final Map<String, int[]> LIMITS = null;")


def test_technologies_and_framework_versions(spark):
    deps = spark.createDataFrame([("m", "io.netty:netty-common", "1", "2"), ("m", "org.springframework.boot:spring-boot-starter", "2.7", "3.0"), ("m", "org.springframework.boot:spring-boot", "2.6", "-"), ("n", "org.springframework.cloud:anything", "1", "1"), ("n", None, None, None)], "module string, coord string, old string, new string")
    flags = {r.module: {k for k, v in r.asDict().items() if v is True} for r in rules.technologies(deps, ["module"], "coord").collect()}
    assert flags == {"m": {"netty"}, "n": {"spring_cloud"}} and len(rules.TECHNOLOGIES) == 18
    assert sorted(map(tuple, rules.framework_versions(deps, ["module"], "coord", "old", "new").collect())) == [("m", "2.6", None, "dependency_scope"), ("n", None, None, "not_found")]
