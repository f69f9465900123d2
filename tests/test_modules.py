"""Modules of a repository with inheritance, properties and both build tools."""

from tidewright.sources import modules

POM = "<project xmlns=\"http://maven.apache.org/POM/4.0.0\"><!-- <groupId>no</groupId> -->{}</project>"
FILES = {
    "r/pom.xml": POM.format("<groupId>sea.${team}</groupId><artifactId>fleet</artifactId><version>${revision}</version><properties><team>port</team><revision>${major}.2</revision><major>4</major></properties><modules><module>a</module></modules>"),
    "r/a/pom.xml": POM.format("<parent><groupId>sea.${team}</groupId><artifactId>fleet</artifactId><version>4.2</version></parent><artifactId>${project.groupId}-a</artifactId><dependencies><dependency><groupId>x</groupId><artifactId>y</artifactId></dependency></dependencies>"),
    "r/a/deep/pom.xml": POM.format("<parent><groupId>sea.${team}</groupId><artifactId>${project.groupId}-a</artifactId></parent><artifactId>deep</artifactId><properties><team>dock</team></properties>"),
    "r/else/pom.xml": POM.format("<parent><groupId>sea.${team}</groupId><artifactId>fleet</artifactId><relativePath/></parent><artifactId>else</artifactId>"),
    "r/ring/pom.xml": POM.format("<parent><groupId>q</groupId><artifactId>ring2</artifactId><relativePath>../ring2</relativePath></parent><groupId>q</groupId><artifactId>ring</artifactId><version>${none}</version>"),
    "r/ring2/pom.xml": POM.format("<parent><groupId>q</groupId><artifactId>ring</artifactId><relativePath>../ring/pom.xml</relativePath></parent><groupId>q</groupId><artifactId>ring2</artifactId>"),
    "r/evil/pom.xml": "<!DOCTYPE project [<!ENTITY x 'y'>]>" + POM.format("<groupId>e</groupId><artifactId>v</artifactId>"), "r/target/pom.xml": POM.format("<groupId>built</groupId><artifactId>b</artifactId>"),
    "g/build.gradle": "// group = 'no'\ngroup = 'sky.air'\nversion '1.5'\n", "g/settings.gradle.kts": 'rootProject.name = "wing"', "g/lib/tip/build.gradle.kts": 'plugins { java }\n', "g/lib/own/build.gradle": "group 'own.group'\n", "h/build.gradle": "apply plugin: 'java'",
    "r/else2/pom.xml": POM.format("<groupId>sea.port</groupId><artifactId>else</artifactId>"),
}
SOURCES = {
    "r/a/src/main/java/sea/A.java": "package sea;\nclass A {}", "r/a/src/main/kotlin/sea/B.kt": "package sea", "r/a/src/test/java/sea/T.java": "package sea;", "r/a/deep/odd/place/q/C.java": "/* package no; */\npackage q;", "r/a/deep/odd/place/q/D.java": "package q;", "r/a/deep/few/q/E.java": "package q;",
    "r/else/src/Wrong.java": "package not.here;", "g/lib/tip/src/main/java/t/F.java": "package t;", "r/top/q/G.java": "package q;",
}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def test_coordinates_with_what_they_inherit(spark):
    got = {r.folder: (r.group_id, r.artifact, r.version) for r in modules.inherited(modules.poms(frame(spark, FILES))).collect()}
    assert got == {
        "r": ("sea.port", "fleet", "4.2"), "r/a": ("sea.port", "sea.port-a", "4.2"), "r/a/deep": ("sea.dock", "deep", "4.2"), "r/else": ("sea.port", "else", "4.2"), "r/else2": ("sea.port", "else", None),
        "r/ring": ("q", "ring", "${none}"), "r/ring2": ("q", "ring2", "${none}"),
    }
    assert modules.inherited(modules.poms(frame(spark, FILES).limit(0))).count() == 0


def test_gradle_groups_come_from_above(spark):
    got = {r.folder: (r.group_id, r.artifact, r.version) for r in modules.gradle_modules(frame(spark, FILES)).collect()}
    assert got == {"g": ("sky.air", "wing", "1.5"), "g/lib/tip": ("sky.air", "tip", "1.5"), "g/lib/own": ("own.group", "own", "1.5")}


def test_sources_are_found_for_unique_coordinates(spark):
    f = frame(spark, FILES)
    every = modules.inherited(modules.poms(f)).select("folder", "group_id", "artifact").unionByName(modules.gradle_modules(f).select("folder", "group_id", "artifact"))
    wanted = spark.createDataFrame([(w,) for w in ("sea.port:sea.port-a", "sea.dock:deep", "sea.port:else", "sky.air", "no:where", "q:ring ")], "wanted string")
    got = sorted(map(tuple, modules.discovered(every, frame(spark, SOURCES), wanted).collect()), key=str)
    assert got == sorted([
        ("sea.port:sea.port-a", "sea.port:sea.port-a", "r/a/src/main/java", "matched"), ("sea.port:sea.port-a", "sea.port:sea.port-a", "r/a/src/main/kotlin", "matched"), ("sea.dock:deep", "sea.dock:deep", "r/a/deep/odd/place", "matched"),
        ("sea.port:else", "sea.port:else", None, "ambiguous"), ("sea.port:else", "sea.port:else", None, "ambiguous"), ("sky.air", "sky.air:tip", "g/lib/tip/src/main/java", "matched"), ("sky.air", "sky.air:wing", None, "no_sources"),
        ("no:where", None, None, "not_found"), ("q:ring", "q:ring", None, "no_sources"),
    ], key=str)
